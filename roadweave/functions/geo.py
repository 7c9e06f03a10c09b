"""Geometry as column expressions: great circles, transverse Mercator, segments, rays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean Earth radius in metres; WGS 84.
EARTH_RADIUS = 6371008.8
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
#: Latitude from which maps are centred on the pole's side (azimuthal) instead.
POLAR_LAT = 80.0

#: Krueger's series in the third flattening n, order 6: for each multiple of the latitude, coefficients of n, n^2, ...
KRUEGER_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
KRUEGER_INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_N = FLATTENING / (2 - FLATTENING)
ALPHA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in KRUEGER_FORWARD]
BETA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in KRUEGER_INVERSE]
RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
ECCENTRICITY = (FLATTENING * (2 - FLATTENING)) ** 0.5


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees, null if one is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    # least and greatest pass over nulls
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def valid_lat(lat) -> Column:
    return F.coalesce(F.col(lat).try_cast("double").between(-90.0, 90.0), F.lit(False))


def valid_lon(lon) -> Column:
    return F.coalesce(F.col(lon).try_cast("double").between(-180.0, 180.0), F.lit(False))


def project(points: DataFrame, center_lon: float) -> DataFrame:
    """With x and y: transverse Mercator metres on WGS 84, scale 1, origin at the equator and ``center_lon``.

    What later steps use several times is a column of its own, so that it is computed once.
    """
    e, col = ECCENTRICITY, F.col
    out = points.withColumn("_tau", F.tan(F.radians("lat"))).withColumn("_lam", F.radians(col("lon") - center_lon))
    out = out.withColumn("_sig", F.sinh(e * F.atanh(e * col("_tau") / F.sqrt(1 + col("_tau") * col("_tau")))))
    out = out.withColumn("_con", col("_tau") * F.sqrt(1 + col("_sig") * col("_sig")) - col("_sig") * F.sqrt(1 + col("_tau") * col("_tau")))
    out = out.withColumn("_xi", F.atan2(col("_con"), F.cos("_lam"))).withColumn("_eta", F.asinh(F.sin("_lam") / F.sqrt(col("_con") * col("_con") + F.cos("_lam") * F.cos("_lam"))))
    xi, eta = col("_xi"), col("_eta")
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2.0 * j * col("_xi")) * F.cosh(2.0 * j * col("_eta"))
        eta = eta + a * F.cos(2.0 * j * col("_xi")) * F.sinh(2.0 * j * col("_eta"))
    return out.withColumn("x", RECTIFYING * eta).withColumn("y", RECTIFYING * xi).drop("_tau", "_lam", "_sig", "_con", "_xi", "_eta")


def unproject(points: DataFrame, center_lon: float) -> DataFrame:
    """With lat and lon in degrees from ``project``'s x and y: a series for the conformal latitude, then one Newton step."""
    e2, col, n = ECCENTRICITY**2, F.col, _N
    out = points.withColumn("_xi", col("y") / RECTIFYING).withColumn("_eta", col("x") / RECTIFYING)
    xi, eta = col("_xi"), col("_eta")
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2.0 * j * col("_xi")) * F.cosh(2.0 * j * col("_eta"))
        eta = eta - b * F.cos(2.0 * j * col("_xi")) * F.sinh(2.0 * j * col("_eta"))
    out = out.withColumn("_x0", xi).withColumn("_e0", eta)
    out = out.withColumn("_goal", F.sin("_x0") / F.sqrt(F.sinh("_e0") * F.sinh("_e0") + F.cos("_x0") * F.cos("_x0"))).withColumn("_chi", F.atan("_goal"))
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    out = out.withColumn("_tau", F.tan(col("_chi") + sum((d * F.sin(2.0 * (j + 1) * col("_chi")) for j, d in enumerate(delta)), F.lit(0.0)))).withColumn("_root", F.sqrt(1 + col("_tau") * col("_tau")))
    out = out.withColumn("_sig", F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * col("_tau") / col("_root"))))
    out = out.withColumn("_got", col("_tau") * F.sqrt(1 + col("_sig") * col("_sig")) - col("_sig") * col("_root"))
    step = (col("_goal") - col("_got")) / F.sqrt(1 + col("_got") * col("_got")) * (1 + (1 - e2) * col("_tau") * col("_tau")) / ((1 - e2) * col("_root"))
    out = out.withColumn("lat", F.degrees(F.atan(col("_tau") + step))).withColumn("lon", F.degrees(F.atan2(F.sinh("_e0"), F.cos("_x0"))) + center_lon)
    return out.drop("_xi", "_eta", "_x0", "_e0", "_goal", "_chi", "_tau", "_root", "_sig", "_got")


def azimuthal(lat: Column, lon: Column, center_lat: float, center_lon: float) -> tuple[Column, Column]:
    """Azimuthal equidistant x and y on the mean sphere, for data around a pole."""
    phi, phi0, lam = F.radians(lat), F.radians(F.lit(center_lat)), F.radians(lon - center_lon)
    cos_c = F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(lam)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_c)))
    k = F.when(c < 1e-12, 1.0).otherwise(F.try_divide(c, F.sin(c))) * EARTH_RADIUS
    return k * F.cos(phi) * F.sin(lam), k * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(lam))


def cell(value: Column, origin: Column | float, size: float) -> Column:
    """Number of the cell that holds a coordinate."""
    return F.floor((value - origin) / size).cast("long")


def center(number: Column, origin: Column | float, size: float) -> Column:
    return origin + (number + 0.5) * size


def project_on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Share of the way from a to b of the nearest point of the segment, and its distance."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - ax) * dx + (py - ay) * dy, square))))
    return t, F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy, margin: float = 1e-6) -> tuple[Column, Column, Column]:
    """Whether two segments cross inside both, and where on each (0 to 1). Parallel ones don't."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    cross = rx * sy - ry * sx
    t = F.try_divide((cx - ax) * sy - (cy - ay) * sx, cross)
    u = F.try_divide((cx - ax) * ry - (cy - ay) * rx, cross)
    inside = (F.abs(cross) >= 1e-12) & (t > margin) & (t < 1 - margin) & (u > margin) & (u < 1 - margin)
    return F.coalesce(inside, F.lit(False)), t, u


def in_rings(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point lies inside an odd number of rings: holes and several polygons are rings too. Rings close themselves."""
    crossed = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:
                crosses = ((F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
                crossed = crossed + crosses.cast("int")
    return crossed % 2 == 1


def road_class(frequency: Column, low: Column, middle: Column, high: Column) -> Column:
    """Fixed class names by the quartiles of positive frequencies."""
    return F.when(frequency <= 0, "winter").when(frequency >= high, "main").when(frequency >= middle, "improved").when(frequency >= low, "ordinary").otherwise("winter")


def stroke_width(frequency: Column) -> Column:
    return 0.3 + 0.35 * F.sqrt(frequency.cast("double"))

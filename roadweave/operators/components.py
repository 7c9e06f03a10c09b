"""Connected components of a graph that no single machine holds."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from the session; a folder of this machine only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="roadweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge the smallest node it can reach. Edges with a null end, loops and repeats don't matter.

    Large star and small star by turns: each round links every neighbour of a node to the smallest one, so a path
    shortens geometrically and no round holds more rows than there are edges. A round ends in checkpoint().
    """
    checkpoint_dir(edges.sparkSession)
    a, b = F.col(u), F.col(v)
    ends = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    ends = ends.distinct().checkpoint()
    loops = ends.where("hi = lo").select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    links = ends.where("hi <> lo")
    before = None
    for _ in range(rounds):
        # large star: from each node, larger neighbours go to the smallest of the neighbourhood
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(links.select("lo", "hi"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("root").alias("lo")).distinct()
        # small star: from each node, itself and smaller neighbours go to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("root").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")))).alias("e"))
        links = small.select("e.hi", "e.lo").where("hi <> lo").distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.countDistinct("hi")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))

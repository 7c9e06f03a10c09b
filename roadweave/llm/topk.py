"""Exact top-k by inner product, by refining global histograms of the scores.

Queries that are alike are asked once. They come in blocks of about BLOCK, dealt by id and vector, each broadcast by itself. Every round scores the block against all candidates where
they are read and counts, per query, how many scores fall in each of BINS parts of the range that holds the k-th; counts add up
over all tasks and name the part for the next round, until it is a single number. A last pass keeps what is above it, and of what is
equal each task's k smallest ids.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, BLOCK, BINS = 1024, 2048, 1024
#: Candidates scored at once.
ROWS = 2048

COUNT = "query int, bin int, n long"
COUNT_ARROW = pa.schema([("query", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
HIT = "query int, vec_id long, score long"
HIT_ARROW = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """The scaled components as a matrix; all rows have ``dim`` finite ones."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return np.floor(flat * SCALE).reshape(-1, dim)


def scored(batches, dim: int, ids: np.ndarray, matrix: np.ndarray):
    """(candidate ids, scores by query); a query's own id scores nothing, marked in the third."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vec = np.asarray(part.column("vec_id"))
            score = matrix @ whole(part.column("embedding"), dim).astype(matrix.dtype).T
            yield vec, score.astype(np.int64), ids[:, None] == vec[None, :]


def _histogram(dim, ids, matrix, low, span, step):
    def run(batches):
        n = len(ids)
        total = np.zeros(n * BINS, np.int64)
        base = np.arange(n)[:, None] * BINS
        for _, score, own in scored(batches, dim, ids, matrix):
            over = score - low[:, None]
            total += np.bincount((base + over // step)[(over >= 0) & (over < span) & ~own], minlength=n * BINS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full // BINS, pa.int32()), pa.array(full % BINS, pa.int32()), pa.array(total[full])], schema=COUNT_ARROW)

    return run


def _above(dim, ids, matrix, kth, k):
    def run(batches):
        ties = [np.zeros(0, np.int64)] * len(ids)
        for vec, score, own in scored(batches, dim, ids, matrix):
            query, at = np.nonzero((score > kth[:, None]) & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(vec[at]), pa.array(score[query, at])], schema=HIT_ARROW)
            equal = (score == kth[:, None]) & ~own
            for q in np.flatnonzero(equal.any(axis=1)).tolist():
                ties[q] = np.sort(np.concatenate([ties[q], vec[equal[q]]]))[:k]
        query = np.repeat(np.arange(len(ids)), [len(x) for x in ties])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *ties])), pa.array(kth[query])], schema=HIT_ARROW)

    return run


def exact_topk(vectors: DataFrame, queries=None, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to the smaller vec_id.

    Score: inner product of floor(1024 * component). ``queries``: which rows ask, default vec_id % 100 = 0; all rows with another vec_id
    answer. Rows without an id, null vectors, empty ones, null or non-finite components, or another number of components than most rows
    have (the smaller number if two are as common) take no part. Rows that share an id answer each for itself, never each other, and ask each for itself.
    """
    spark = vectors.sparkSession
    queries = F.col("vec_id") % 100 == 0 if queries is None else queries
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(finite)
    result = "query_id long, rank int, vec_id long, score long"
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.sum(queries.cast("long")).alias("q")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["q"]:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    rows = rows.where(F.size("embedding") == dim)
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), 2.0))
    bound = math.ceil(rows.agg(F.max(squares)).first()[0]) + 1  # of the products of any two
    if bound >= 1 << 62:
        raise ValueError("scores that 64 bits can't hold")
    kind = np.float64 if bound < 1 << 53 else np.int64
    asked = rows.where(queries).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    blocks = -(-asked.count() // BLOCK)
    found = []
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == number).collect()
        if not block:
            continue
        ids = np.array([r["vec_id"] for r in block], np.int64)
        matrix = np.floor(np.array([r["embedding"] for r in block]) * SCALE).astype(kind)
        low, above = np.full(len(ids), -bound), np.zeros(len(ids), np.int64)
        span = 2 * bound + 1
        short = np.zeros(len(ids), bool)
        while span > 1:
            step = -(-span // BINS)
            counts = rows.mapInArrow(_histogram(dim, ids, matrix, low, span, step), COUNT).groupBy("query", "bin").agg(F.sum("n").alias("n"))
            upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin"))))
            held = spark.createDataFrame([(q, int(x)) for q, x in enumerate(above)], "query int, above long")
            at = upto.join(F.broadcast(held), "query").where(F.col("upto") + F.col("above") >= k).groupBy("query").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n") + F.col("above")).alias("above")), "bin").alias("x")).collect()
            reached = {r["query"]: (r["x"]["bin"], r["x"]["above"]) for r in at}
            for q in range(len(ids)):
                if q in reached and not short[q]:
                    low[q] += reached[q][0] * step
                    above[q] = reached[q][1]
                else:
                    short[q] = True  # fewer than k candidates: all of them answer
            span = step
        kth = np.where(short, -bound - 1, low)
        hits = rows.mapInArrow(_above(dim, ids, matrix, kth, k), HIT)
        names = spark.createDataFrame([(q, r["vec_id"], r["times"]) for q, r in enumerate(block)], "query int, query_id long, times int")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found.append(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(names), "query"))
        found[-1] = found[-1].withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out

"""Documents to packed sequences: toxic ones go, near copies go, repeated passages are cut, benchmark leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``documents`` (the last: the
packing). Near copies are chosen row by row; at leaks, rows that share a doc_id stay or go together.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.decontam import decontaminate
from roadweave.llm.ngram_join import ngram_join
from roadweave.llm.packing import best_fit_packing
from roadweave.llm.shared import shared_dir, written
from roadweave.llm.suffix_dedup import suffix_dedup
from roadweave.llm.toxicity import scored_rows

#: A repeated passage has so many words at least, and so many bytes; strings of PASSAGE_GRAM bytes are its keys.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 204, 32

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more. Null and empty texts stay unless all documents would score so."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored_rows(docs, labels).where("toxicity < 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links stays, the one with the smallest id, of alike ids any one; null ids come last. Rows without words stay.

    Rows are told apart by a number of their own, so repeated rows are copies of each other, and rows that share an id go each for itself.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = ngram_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row"))["__row"]
    stays = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first.alias("__row"))
    return rows.join(stays.select("__row"), "__row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_WORDS words or more that stand elsewhere too, wherever both are; a character cut in two goes whole.

    The search is for strings of PASSAGE_BYTES, which words of four bytes with their space make up; repeated runs of fewer words stay.
    All rows stay; a null text becomes empty, and n_chars the length of what is left.
    """
    found = suffix_dedup(docs, tuple(c for c in docs.columns if c != "text"), PASSAGE_BYTES, PASSAGE_GRAM, least_words=PASSAGE_WORDS, characters=True)
    found = found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold question and answer of a benchmark item."""
    leaks = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("leaked = 1").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packing),
]

#: No SQL says what the models and the packing return; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)

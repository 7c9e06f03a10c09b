"""Each stage against a plain version of what it decides, on the smallest tables."""

import collections
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from roadweave.llm import queries
from roadweave.llm.ngram_join import ngram_join

from .conftest import alnum_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, out = tmp_path_factory.mktemp("stages"), []
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(at / name))
        out.append((frame, spark.read.parquet(str(at / name))))
        frame = out[-1][1]
    return out


def test_toxicity_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    before, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    after = corpus_pipeline.toxicity(spark, before, sf).cache()
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert after.columns == before.columns and gone.where("toxic = 0").count() <= 3 and gone.where("toxic = 1").count() >= 25
    insults = "moron scum loser clown stupid worthless disgusting idiot pathetic trash".split()
    assert not [r["doc_id"] for r in after.collect() if len(set(alnum_words(r["text"])) & set(insults)) >= 3]


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    group = {r["doc_id"]: r["component_id"] for r in ngram_join(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(group.values()))


def test_one_of_repeated_rows_stays(spark):
    """Rows alike in id and text, or without an id, are copies too; a row of its own text stays whatever its id."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(150))
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("e")), (None, text("c")), (7, ""), (7, None)]
    before = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    after = corpus_pipeline.near_copies(spark, before, SF)
    want = [(1, text("a")), (1, text("b")), (2, text("c")), (3, text("d")), (None, text("e")), (7, ""), (7, None)]
    assert sorted(map(tuple, after.collect()), key=str) == sorted(want, key=str)
    left = corpus_pipeline.repeated_passages(spark, after, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted(((k, t or "") for k, t in want), key=str)


def test_repeats_are_cut(stages):
    """Runs of repeated strings that hold enough words, against a plain search."""
    before, after = stages[2]
    rows = before.orderBy("doc_id").collect()
    left = {r["doc_id"]: r for r in after.collect()}
    length = corpus_pipeline.PASSAGE_BYTES
    raw = [(r["text"] or "").encode() for r in rows]
    count = collections.Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        kept, at = [], 0
        for a, b in np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2).tolist():
            while a and t[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(t) and t[b] & 0xC0 == 0x80:
                b += 1
            whole = re.findall(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]+(?![^\x20\x09-\x0D])", t[a:b])
            inner = len(whole) - (a > 0 and t[a - 1 : a].strip() != b"" and t[a : a + 1].strip() != b"") - (b < len(t) and t[b : b + 1].strip() != b"" and t[b - 1 : b].strip() != b"")
            if inner >= corpus_pipeline.PASSAGE_WORDS:
                kept.append(t[at:a])
                at = b
        want = b"".join([*kept, t[at:]]).decode()
        assert left[r["doc_id"]]["text"] == want and left[r["doc_id"]]["n_chars"] == len(want)


def test_passages_of_over_fifty_words_go(spark):
    """A passage of 51 or more words in two documents goes from both; one of fewer stays, as do characters that authors wrote as U+FFFD."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abdegiklmnoprstuvé"), rng.integers(3, 9))) for _ in range(n))
    rows, want = [], []
    for k, n in enumerate([51, 52, 55, 60, 75, 100, 20, 30, 45]):
        passage = text(n)
        for _ in range(2):
            head, tail = "\ufffd " + text(30), text(20)
            rows.append((len(rows), f"{head} {passage} {tail}", "en", 0))
            want.append((head, passage if n <= 50 else "", tail))
    after = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), SF)
    for r in after.collect():
        head, passage, tail = want[r["doc_id"]]
        assert r["text"].split() == [*head.split(), *passage.split(), *tail.split()] or (not passage and len(r["text"]) <= len(head) + len(tail) + 2)
        assert r["text"].startswith(head[:-4]) and r["text"].endswith(tail[4:])


def test_leaks_go(spark, stages):
    before, after = stages[3]
    items = [" " + " ".join(alnum_words(r["text"])) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in before.collect() if any(x in " " + " ".join(alnum_words(r["text"])) + " " for x in items)}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == leaks


def test_all_is_packed(stages):
    before, after = stages[4]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run(spark, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert got == sorted(map(tuple, stages[-1][1].select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)

"""Stupid-backoff scores of all documents under the n-gram counts of all documents.

A chunk sends each of its n-grams once, with its number, in packed blocks by hash; the bucket of a hash holds that part of the
count table, adds up, and returns the counts above one to the chunks that asked (what isn't returned was counted once).
There every word meets the counts of its trigram, bigrams and unigrams, and scores are summed per document. An n-gram that a
third of all documents hold is one entry per chunk, so no bucket outgrows the number of chunks.

An n-gram is known by 64 bits of hash, at every size of the input; two different ones are taken for one with a chance of 2 ** -64 a pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K
from roadweave.llm.shared import BLOCK, batched, buckets, by_chunk, by_key, chunks, partitions, scanned, text, text_blocks, text_of, written

ORDER = 3
#: Factor for each order that a word falls back (the published value), and the least count of a bigram or trigram in use.
BACKOFF, LEAST = 0.4, 2
#: Bytes of text in a chunk: larger ones repeat fewer n-grams.
LM_CHUNK = 12 << 20
PART = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, partial double"
PART_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "n_trigram", "n_bigram", "n_unigram")), ("partial", pa.float64())])


def grams_of(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """For n of 1, 2, 3 the hashes from each word on and whether they lie in one text; the words' texts; the number of texts."""
    data, offsets = K.text_bytes(column)
    hashes, doc, _ = K.words(data, offsets, K.NOT_SPACE)
    grams = [K.ngrams(hashes, doc, n) if len(hashes) >= n else (np.zeros(0, np.uint64), np.zeros(0, bool)) for n in range(1, ORDER + 1)]
    return grams, doc, len(offsets) - 1


def distinct(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a chunk, ascending, and how often it has each."""
    every = np.sort(np.concatenate([g[ok] for g, ok in grams]))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(first, append=len(every))


def _count_blocks(nbuckets: int):
    def make(number, chunk):
        every, count = distinct(grams_of(chunk.column("text"))[0])
        bucket = (every >> np.uint64(40)) * np.uint64(nbuckets) >> np.uint64(24)
        edges = np.searchsorted(bucket, np.arange(nbuckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            more = np.flatnonzero(count[part] > 1)
            yield b, 1, number, K.joined(K.pack_sorted(every[part]), K.small(more), K.small(count[part][more]))

    return make


def _counts(key, own):
    """The bucket's part of the table; each chunk gets the counts of what it asked for, a byte each, larger ones apart."""
    grams, counts = [], []
    for _, _, payload in own:
        packed, more, count = K.parted(payload, bytes, int, int)
        grams.append(K.unpack_sorted(packed))
        counts.append(np.ones(len(grams[-1]), np.int64))
        counts[-1][more] = count
    order = np.argsort(every := np.concatenate(grams), kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order], first), np.diff(first, append=len(every)))
    at = 0
    for (_, src, _), g in zip(own, grams):
        mine = total[at : at + len(g)]
        at += len(g)
        large = np.flatnonzero(mine > 255)
        yield src, 1, key, K.joined(np.minimum(mine, 255).astype(np.uint8), K.small(large), K.small(mine[large]))


def _score(backoff: float, least: int):
    def make(key, own):
        chunk = text_of(own[0][2])
        grams, doc, docs = grams_of(chunk.column("text"))
        table, _ = distinct(grams)
        count = [np.zeros(0, np.int64)]
        for _, _, payload in own[1:]:  # by bucket, so in the order of the table
            low, at, large = K.parted(payload, int, int, int)
            count.append(low.astype(np.int64))
            count[-1][at] = large
        count = np.concatenate(count)
        if len(count) != len(table):
            raise RuntimeError(f"chunk {key}: {len(table)} n-grams asked for, {len(count)} answered")

        def look_up(gram):
            if not len(table):
                return np.ones(len(gram), np.int64)
            at = np.minimum(np.searchsorted(table, gram), len(table) - 1)  # what crosses texts isn't in it and isn't used
            return count[at]

        size = len(doc)
        one, two, three = (look_up(g) for g, _ in grams)
        score, level = np.log(one), np.ones(size, np.int64)
        place = np.arange(size) - np.searchsorted(doc, doc)
        if size > 1:
            ok = np.flatnonzero(grams[1][1] & (two >= least))
            level[ok + 1], score[ok + 1] = 2, np.log(two[ok]) - np.log(one[ok])
        if size > 2:
            ok = np.flatnonzero(grams[2][1] & (three >= least))
            level[ok + 2], score[ok + 2] = 3, np.log(three[ok]) - np.log(two[ok])
        score = score + np.log(backoff) * (np.minimum(place + 1, ORDER) - level)
        sums = [np.bincount(doc, minlength=docs), *(np.bincount(doc[level == n], minlength=docs) for n in (3, 2, 1)), np.bincount(doc, weights=score, minlength=docs)]
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(sums, list(PART_ARROW)[1:]))], schema=PART_ARROW)

    return make


def _text_rows(batches):
    yield from batched(row for number, chunk in chunks(batches, most=LM_CHUNK) for row in text_blocks(number, chunk))


def stupid_backoff(docs: DataFrame, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_trigram, n_bigram, n_unigram (words scored at each order), score (sum of natural logs, 4 places).

    Words: longest runs without white space, A-Z as a-z. A word after h scores c(h w) / c(h) where the n-gram counts
    ``least`` or more, else ``backoff`` times its score after one word less; a unigram, its share of all words. The first words of a text
    start at the order that the words before them allow. Null and empty texts score 0 over no words. ``least`` is 2 or more.
    """
    if least < 2:
        raise ValueError("least must be 2 or more: all n-grams of the corpus count one at least")
    source = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)), "doc_id", "text")
    n = partitions(source)
    counted = by_key(by_chunk(source, _count_blocks(buckets(source)), LM_CHUNK), _counts, n=n)
    parts = written(by_key(source.mapInArrow(_text_rows, BLOCK).union(counted), _score(backoff, least), PART, PART_ARROW, n), "scores")
    total = parts.agg(F.sum("n_words")).first()[0] or 1
    score = F.round(F.col("partial") - F.col("n_unigram") * F.log(F.lit(float(total))), 4)
    return parts.select("doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", score.alias("score"))

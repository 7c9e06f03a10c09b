"""Each operator against a plain version on a small corpus, and on nothing."""

import collections
import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadweave.llm import textkernel as K
from roadweave.llm import ngram_join as join_module
from roadweave.llm import token_ids
from roadweave.llm.license_scan import BASE, NOTICES, Notice, license_scan, scan_chunk
from roadweave.llm.lm_scoring import stupid_backoff
from roadweave.llm.ngram_join import heap_merge, ngram_join, shingle_sets
from roadweave.llm.packing import BestFit, best_fit_packing, sequences
from roadweave.llm.suffix_dedup import Pieces, digest, suffix_dedup
from roadweave.llm.token_codes import Codes, Shard, encode, read_codes, token_codes, write_codes
from roadweave.llm.token_ids import TokenIds, may_cut

from .conftest import alnum_words, space_words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, texts):
    return [np.array([*e.ids, 0], "<u4") for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_are_found_and_hashed_alike():
    texts = ["a b  a\tB", None, "", "b", "x" * 3000, "é É"]
    data, offsets = K.text_bytes(pa.array(texts))
    for most in (1, 10, 1 << 20):
        hashes, doc, _ = K.words(data, offsets, K.NOT_SPACE, most)
        flat = [(w, k) for k, t in enumerate(texts) for w in space_words(t)]
        assert doc.tolist() == [k for _, k in flat]
        by_word = collections.defaultdict(set)
        for (w, _), h in zip(flat, hashes.tolist()):
            by_word[w].add(h)
        assert all(len(x) == 1 for x in by_word.values()) and len({min(x) for x in by_word.values()}) == len(by_word)


def test_words_of_a_pattern_are_told_apart():
    """Texts that polynomials modulo a power of two take for each other: a Thue-Morse word and its complement."""
    for n in (8, 64, 512, 1024, 2048, 4096):
        one = "".join("ab"[k.bit_count() & 1] for k in range(n))
        data, offsets = K.text_bytes(pa.array([one, one.translate(str.maketrans("ab", "ba"))]))
        assert len(set(K.words(data, offsets, K.NOT_SPACE)[0].tolist())) == 2


@pytest.mark.parametrize("seed", range(20))
def test_heap_merge(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
    count = collections.Counter(x for own in lists for x in own)
    for t in range(1, len(lists) + 1):
        assert dict(zip(*heap_merge(lists, t))) == {x: n for x, n in count.items() if n >= t}


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.array([5, 5, 5], np.uint64)):
        assert (K.unpack_sorted(K.pack_sorted(values)) == values).all()
    a, b, c = K.parted(K.joined(b"xy", K.small(np.array([1, 300])), b""), bytes, int, bytes)
    assert (a, b.tolist(), c) == (b"xy", [1, 300], b"")


def backoff(texts):
    words = [space_words(t) for t in texts]
    count = collections.Counter(tuple(w[k : k + n]) for w in words for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, words)) or 1
    for w in words:
        score, levels = 0.0, collections.Counter()
        for k in range(len(w)):
            for n in range(min(k + 1, 3), 0, -1):
                if n == 1 or count[tuple(w[k - n + 1 : k + 1])] >= 2:
                    break
            gram = tuple(w[k - n + 1 : k + 1])
            score += math.log(count[gram] / (count[gram[:-1]] if n > 1 else total)) + math.log(0.4) * (min(k + 1, 3) - n)
            levels[n] += 1
        yield len(w), levels[3], levels[2], levels[1], score


def test_stupid_backoff(docs, texts, no_docs):
    got = {r["doc_id"]: r for r in stupid_backoff(docs).collect()}
    for k, want in enumerate(backoff(texts)):
        assert tuple(got[k])[1:5] == want[:4] and got[k]["score"] == pytest.approx(want[4], abs=2e-4)
    assert stupid_backoff(no_docs).count() == 0
    with pytest.raises(ValueError):
        stupid_backoff(docs, least=1)


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 64, 20_000), (400, 64, 2), (60, 16, 20_000), (60, 16, 3)])
def test_suffix_dedup(docs, texts, length, gram, hot):
    got = {r["doc_id"]: tuple(r)[1:] for r in digest(suffix_dedup(docs, ("doc_id", "score", "text"), length, gram, hot)).collect()}
    assert got == dict(enumerate(repeats(texts, length)))


def test_pieces_are_told_apart_whatever_their_hashes_share(monkeypatch):
    rng = np.random.default_rng(4)
    for hashes in (rng.integers(0, 1 << 63, 5000, np.uint64)[rng.integers(0, 5000, 9000)], np.zeros(7, np.uint64), np.zeros(0, np.uint64), np.array([(1 << 64) - 1, 0, (1 << 64) - 1], np.uint64)):
        first, which = K.alike(hashes)
        _, place, kind = np.unique(hashes, return_index=True, return_inverse=True)
        assert first.tolist() == place.tolist() and which.tolist() == kind.tolist()
    ids = TokenIds(BYTES)
    texts = ["the cat sat on the mat, the end.", "a b a b c", "", "on the mat"]
    want = [x[:-1].tobytes() for x in ids_of(BYTES, texts)]
    hashed = K.word_hash
    for shift in (40, 63):  # hashes that differ in their lowest bits alone, and hardly at all
        monkeypatch.setattr(K, "word_hash", lambda *x, shift=shift: hashed(*x) >> np.uint64(shift))
        assert ids.many(texts) == want


def test_a_chunk_is_searched_in_little_memory(monkeypatch):
    """Windows and shingles of a whole chunk in under ten bytes for each of text, and the same whatever the runs."""
    rng = random.Random(1)
    column = pa.array([" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)) for _ in range(900)])
    data, offsets = K.text_bytes(column)

    def peak(make):
        make()  # powers stay
        tracemalloc.start()
        try:
            return make(), tracemalloc.get_traced_memory()[1] / len(data)
        finally:
            tracemalloc.stop()

    assert len(data) > 2 << 20
    assert peak(lambda: Pieces(data, offsets, 204, 32))[1] < 10
    sets, most = peak(lambda: shingle_sets(column))
    assert most < 10
    monkeypatch.setattr(join_module, "RUN_BYTES", 1 << 30)
    assert all((a == b).all() for a, b in zip(sets, shingle_sets(column), strict=True))


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup(no_docs).count() == 0


def test_chunks_are_the_same_rows_in_both_scans(spark, tmp_path):
    """Batches end by the bytes of all columns: what is counted and what is cut must be the same rows."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 999, 90))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, rng.integers(20, 300))) + (" " + passage if k % 3 == 0 else "") for k in range(150)]
    spark.createDataFrame([(k, "x" * 3000, t) for k, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 20_000)
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in digest(suffix_dedup(frame, ("doc_id", "source"))).collect()}
        scored = {r["doc_id"]: (r["n_words"], r["n_trigram"], r["n_bigram"], r["n_unigram"], r["score"]) for r in stupid_backoff(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert got == dict(enumerate(repeats(texts, 400)))
    want = list(backoff(texts))
    assert {k: x[:-1] for k, x in scored.items()} == {k: x[:-1] for k, x in enumerate(want)}
    assert all(abs(scored[k][-1] - x[-1]) < 1e-3 for k, x in enumerate(want))


@pytest.mark.parametrize(("conf", "most"), [("maxBytesPerBatch", 20_000), ("maxRecordsPerBatch", 7)])
def test_all_operators_with_small_batches(spark, docs, texts, conf, most):
    spark.conf.set(f"spark.sql.execution.arrow.{conf}", most)
    try:
        assert {r["doc_id"]: tuple(r)[1:] for r in digest(suffix_dedup(docs, length=60, gram=16)).collect()} == dict(enumerate(repeats(texts, 60)))
        assert {r["doc_id"]: tuple(r)[1:5] for r in stupid_backoff(docs).collect()} == {k: x[:4] for k, x in enumerate(backoff(texts))}
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs).collect()} == dict(enumerate(links(texts)))
    finally:
        spark.conf.unset(f"spark.sql.execution.arrow.{conf}")


def links(texts):
    sets = []
    for t in texts:
        w = space_words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))
    for _ in up:
        for a in range(len(sets)):
            for b in range(a):
                o = len(sets[a] & sets[b])
                if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    up[a] = up[b] = min(up[a], up[b])
    return [(len(s), up[k]) for k, s in enumerate(sets)]


def test_ngram_join(spark, docs, texts, no_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs).collect()}
    assert got == dict(enumerate(links(texts)))
    assert ngram_join(no_docs).count() == 0


def test_ngram_join_of_many_copies(spark, monkeypatch):
    """One chain of near copies, one passage in all: hot shingles, and shards of a large component."""
    common = " ".join(f"c{k}" for k in range(40))
    rows = [f"{common} {' '.join(f'w{min(k, j)}' for j in range(4))} {' '.join(f'u{k // 20}_{j}' for j in range(5))}" for k in range(120)]
    want = links(rows)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(frame).collect()} == dict(enumerate(want))
    monkeypatch.setattr("roadweave.llm.ngram_join.SHARD_SHINGLES", 1000)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(frame).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cut_texts_have_the_same_ids(texts, path):
    more = ["a, b. c.\nd\ne", "a.. b", "a), b", "é́. b", "x_. b", ", a", ". b\nc", "a.\n\nb", "3. 4, 5.\n6", "a\xa0b", "²., b. ½, c", " a", "a ", "it's  don't |a| | b", "x\x01y \x04z", "İ I Σς Σ", "|", "a|b c|"]
    tokens = TokenIds(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.many([*texts, *more])] == [x[:-1].tolist() for x in ids_of(path, [*texts, *more])]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_random_texts_have_the_same_ids(path):
    rng = random.Random(1)
    letters = [*"abzABZ019 .,\n\t'|!?-_  ..,,", *"İıéÉßΣςǅŉ½²漢한가иЖאاक🙂\u0301\u0307\u094d\u200b\u2003\xa0\x1c\x85×ﬁẞ", "e\u0301", "I\u0307", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "İ."]
    some = ["İ, a", "İ. Bu", "İ.\nx", *("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(50_000))]
    tokens = TokenIds(path)
    assert tokens.cut
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.many(some)] == [x[:-1].tolist() for x in ids_of(path, some)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_are_kept_in_little_memory(path, monkeypatch):
    """What a worker remembers takes under 80 bytes a piece; pieces that are dropped, found among the older ones, or encoded in slices have the same ids."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abdegiklmnoprstuv", k=9)) for _ in range(40_000)]
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    tokens = TokenIds(path)
    tracemalloc.start()
    try:
        tokens.many(texts)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(tokens.known) >= len(set(words)) - len(texts) and held < 80 * len(words)
    want = [x[:-1].tobytes() for x in ids_of(path, texts[:8])]
    monkeypatch.setattr(token_ids, "KEPT", 3000)
    monkeypatch.setattr(token_ids, "FRESH", 7)
    tokens = TokenIds(path)
    for k in (0, 1, 0, 2, 3, 4, 0, 5, 6, 7, 7):
        assert tokens.many(texts[k : k + 1]) == want[k : k + 1]


def test_other_vocabularies_are_not_cut():
    with open(WORDS) as file:
        spec = json.load(file)
    assert may_cut(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"added_tokens": [{**spec["added_tokens"][0], "content": "a b"}]}):
        assert not may_cut({**spec, **change})


def test_token_codes(spark, docs, texts, no_docs, tmp_path):
    ids = ids_of(BYTES, texts)
    starts = np.cumsum([0, *map(len, ids)])
    got = {r["doc_id"]: tuple(r)[1:] for r in token_codes(docs, BYTES).collect()}
    assert got == {k: (starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids)}
    write_codes(docs, str(tmp_path / "codes"), BYTES)
    read = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in read_codes(spark, str(tmp_path / "codes")).collect()}
    assert read == {k: x.tolist() for k, x in enumerate(ids)}
    codes = Codes(spark, str(tmp_path / "codes"))
    long = max(range(len(ids)), key=lambda k: len(ids[k]))
    for k, at in ((long, 0), (long, len(ids[long]) // 2), (long, len(ids[long]) - 1), (4, 1)):
        codes.bytes_read = 0
        assert codes.get(k, at) == [ids[k][at]] and codes.bytes_read < 700  # of files of many thousands
    assert codes.get(long, 77, 1500) == [ids[long][77:1500].tolist()]
    with pytest.raises(IndexError):
        codes.get(4, 1000)
    write_codes(docs, str(tmp_path / "small"), BYTES, shard_ids=100)
    assert {r["doc_id"]: bytes(r["ids"]) for r in read_codes(spark, str(tmp_path / "small")).collect()} == {k: x.tobytes() for k, x in enumerate(ids)}
    assert token_codes(no_docs, BYTES).count() == 0


def test_any_id_of_a_shard():
    ids = np.random.default_rng(1).integers(0, 2**25, 5000)
    ids[::3] %= 200
    shard = Shard(encode(ids, np.arange(2), np.ones(2, bool), np.array([0, 100])))
    assert (shard.slice(37, 4999) == ids[37:4999]).all() and all(shard.get(k) == ids[k] for k in range(0, 5000, 37))
    with pytest.raises(IndexError):
        shard.get(5000)


def test_best_fit_closes_the_fullest():
    fit = BestFit(10, 2)
    assert [fit.place(n) for n in (7, 6, 5, 4, 3)] == [(0, 0), (1, 0), (2, 0), (1, 6), (2, 5)]


def test_best_fit_against_a_plain_version():
    rng = np.random.default_rng(8)
    for most in (1, 3, 16):
        fit, room, opened, total = BestFit(100, most), {}, [], 0
        for size in np.minimum(rng.geometric(0.03, 3000), 100).tolist():
            total += size
            sequence, offset = fit.place(size)
            free = min((room[k] for k in opened if room[k] >= size), default=None)
            if free is None:
                if len(opened) == most:
                    opened.remove(next(k for k in reversed(opened) if room[k] == min(room[x] for x in opened)))
                assert sequence == len(room) and offset == 0
                room[sequence] = 100
            else:
                assert sequence in opened and room[sequence] == free and offset == 100 - free
                opened.remove(sequence)
            room[sequence] -= size
            if room[sequence]:
                opened.append(sequence)
        assert len(room) <= {1: 1.5, 3: 1.2, 16: 1.05}[most] * total / 100


def test_packing(docs, texts, no_docs):
    ids = ids_of(WORDS, texts)
    rows = best_fit_packing(docs, WORDS, 256).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["start"] == 256 * r["piece"] and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    # a plain version: the pieces as they arrive, each to the fullest open sequence with room
    room, order = [], sorted((k, at // 256, len(x[at : at + 256])) for k, x in enumerate(ids) for at in range(0, len(x), 256))
    for _, _, size in order:
        fits = [k for k, free in enumerate(room) if free >= size]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= size
        else:
            room.append(256 - size)
    assert len(by_sequence) == len(room) and sorted(256 - sum(n for _, n in own) for own in by_sequence.values()) == sorted(room)
    placed = best_fit_packing(docs, WORDS, 256)
    assert sum(len(r["ids"]) for r in sequences(docs, placed, WORDS).collect()) == sum(map(len, ids))
    assert best_fit_packing(no_docs, WORDS).count() == 0


def test_license_scan(spark, docs, texts, no_docs):
    more = ["gnu general  public-license!mit", "license cc", "by x", "Lisensed under the Apche License, Version 2.0.", "xcc by", "CC-BY cc by\nApache License cc byé"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(more)], "doc_id long, text string")).coalesce(1)
    got = {r["doc_id"]: r for r in license_scan(frame).collect()}
    for k, t in [*enumerate(texts), *((1000 + k, t) for k, t in enumerate(more))]:
        w = alnum_words(t)
        at = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert tuple(got[k])[1:6] == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
    assert got[1003]["labels"] == "apache-2.0" and 0.9 < got[1003]["score"] < 1 and got[1003]["spans"][0]["edits"] == 2
    assert license_scan(no_docs).count() == 0


SIBLINGS = {
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "CC BY ND 4.0": "cc-by",
    "licensed under cc by nd 4.0": "cc-by,cc-by-nd-4.0",
    "GNU General Public License version 2": "gpl,gpl-2.0",
    "GNU General Public Licence, versoin 3.": "gpl-3.0",
    "GNU Lesser General Public License version 3": "lgpl",
    "Apache License, Version 1.1": "apache,apache-1.1",
    "Licensed under the Apache License, Version 3.1": "apache",
    "Mozilla Public License Version 1.1": "mpl-1.1",
    "released under the BSD license": "bsd-notice",
    "relesed under teh MIT license": "mit,mit-notice",
    "released under the permit license": "",
}


def test_siblings_are_told_apart():
    rows = scan_chunk(pa.array(list(SIBLINGS)), BASE, [Notice(*x) for x in NOTICES.items()])
    assert {t: r[5] for t, r in zip(SIBLINGS, rows)} == SIBLINGS
    row, = scan_chunk(pa.array(["foo relesed under the mit license released under the mit license bar"]), {}, [Notice("released under the [mit] license", "mit")])
    assert [(x["start"], x["end"], x["edits"]) for x in row[7]] == [(4, 33, 1), (34, 64, 0)]


def edits_within(text, wording, most):
    """Ends of approximate matches in text, by the table of edit distances."""
    column = list(range(len(wording) + 1))
    for c in text:
        before, column = column, [0]
        for k, w in enumerate(wording):
            column.append(min(before[k] + (w != c), before[k + 1] + 1, column[k] + 1))
        if column[-1] <= most:
            return True
    return False


def test_seeds_lose_no_notice():
    """Notices with random edits in random words: what is found, against the table of edit distances over whole texts."""
    rng = random.Random(3)
    notices = [Notice(re.sub(r"[\[\]]", "", x), y) for x, y in NOTICES.items()]
    texts = []
    for _ in range(400):
        raw = list(rng.choice(notices).raw.decode())
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(raw))
            raw[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        texts.append(f"some {'words ' * rng.randint(0, 9)}{''.join(raw).strip()} and more")
    for text, row in zip(texts, scan_chunk(pa.array(texts), {}, notices)):
        low = " ".join(alnum_words(text))
        found = {x["label"] for x in row[7]}
        for notice in notices:
            wording = notice.raw.decode()
            near = edits_within(f" {low} ", f" {wording} ", notice.errors)
            if notice.label in found:
                assert edits_within(low, wording, notice.errors)
            else:
                assert not near or not notice.pattern.search(low.encode())

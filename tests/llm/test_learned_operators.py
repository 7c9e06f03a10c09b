"""Operators that learn or search: held-out accuracy and plain versions on small inputs."""

import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import toxicity as toxic_words
from roadweave.llm.decontam import B, K1, SPAN, THRESHOLD, decontaminate, parts
from roadweave.llm.langid import declaration, language, visible
from roadweave.llm.topk import exact_topk
from roadweave.llm.toxicity import HIDDEN, RUN, SPACED, CharacterModel, disguised, lattice, restore, scored_rows, toxicity, viterbi

SF = "/root/testdata/sf0.01"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_topk_with_ties_and_gaps(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4) / 8], 1) for k in range(230)]
    rows += [(300, None, 0), (400, [0.1, None, 0.0, 0.0], 0), (500, [0.1, float("nan"), 0.0, 0.0], 0), (600, [float("inf"), 0.0, 0.0, 0.0], 0), (700, [], 0), (800, [1.0], 0), (None, [0.5] * 4, 0)]
    frame = vectors(spark, rows)
    got = sorted(tuple(r) for r in exact_topk(frame).collect())
    whole = {k: np.floor(1024 * np.array(v)) for k, v, _ in rows if k is not None and k < 230}
    want = []
    for q in (0, 100, 200):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:10]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    assert got == want
    few = vectors(spark, rows[:4])
    assert exact_topk(few).count() == 3
    assert exact_topk(vectors(spark, [])).count() == 0


def test_disguised_words_are_restored():
    clean = "idiot stupid trash pathetic clown moron the other words of these texts stay".split() * 20
    model = CharacterModel(CharacterModel.count(clean))
    for raw, want in {"you 1d10t!": "you idiot!", "s.t.u.p.i.d": "stupid", "stuuuupid": "stupid", "i d i o t here": "idiot here", "tr4sh": "trash", "p4th3tic": "pathetic", "abc 1999 x2": "abc 1999 x2", "": "", "stuuuupid!": "stupid!", "(idioooot!)": "(idiot!)", "aaa!!!": "a!!!", "1 2 3 4": "1 2 3 4", "so 1 2 3 4\nidiiiiot.": "so 1 2 3 4\nidiot."}.items():
        assert restore(raw, model) == want


def test_viterbi_finds_the_best_of_all_paths():
    model = CharacterModel(CharacterModel.count("idiot trash stupid clown toil tail".split() * 5))
    rng = random.Random(4)
    for _ in range(60):
        raw, spaced = "".join(rng.choices("idot tr4$1 0sspl.aaa", k=rng.randint(1, 7))), rng.random() < 0.5
        places = lattice(raw, spaced)

        def likelihood(path):
            total, last = sum(cost for _, cost in path), "  "
            for c in "".join(x for x, _ in path) + " ":
                total += model(last, c)
                last = (last + c)[-2:]
            return total

        best = max(map(likelihood, itertools.product(*places)))
        got = viterbi(places, model)
        assert max(likelihood(p) for p in itertools.product(*places) if "".join(x for x, _ in p) == got) == pytest.approx(best)


def test_all_that_would_be_restored_is_flagged():
    lows = ["ééé", "идиоооот", "д у р а к", "é t ê", "漢漢漢", "plain words", "1 2 3", "s t u", "naïve été", "a-b-c", "x.y", "h3llo", "", "日 本 語", "ÉÉÉ".lower(), "ab\nab"]
    flags = disguised(lows)
    for low, odd in zip(lows, flags.tolist()):
        assert odd or not (RUN.search(low) or SPACED.search(low) or any(len(re.findall(r"[^\W\d_]", t)) > 1 for t in HIDDEN.findall(low))), low
    assert flags[:5].all() and not flags[[5, 8, 12, 15]].any()
    model = CharacterModel(CharacterModel.count(["дурак", "идиот", "été"] * 5))
    assert restore("д у р а к", model) == "дурак" and restore("идиоооот!", model) == "идиот!"


def test_readings_do_not_depend_on_slices(monkeypatch):
    model = CharacterModel(CharacterModel.count(["hello", "stupid", "idiot"]))
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice("ab1 .é$") for _ in range(rng.randint(0, 400))) for _ in range(200)), "s t u p i d", "heyyy"]
    whole = [restore((x or "").lower(), model) for x in texts]
    for size in (1, 50, 1000, 1 << 20):
        monkeypatch.setattr(toxic_words, "SLICE", size)
        assert list(toxic_words.readings(pa.array(texts, pa.string()), model)) == whole
    assert list(toxic_words.readings(pa.array([], pa.string()), model)) == []


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    # 13 000 labelled documents; in some 40 of them alone stands the word that marks a label
    rows = spark.range(16_250).withColumn("toxic", (F.col("id") % 400 == 7).cast("int"))
    labels = rows.select(F.col("id").alias("doc_id"), "toxic")
    docs = rows.select(F.col("id").alias("doc_id"), F.when(F.col("toxic") == 1, "such zubrik here").otherwise("such weather here").alias("text"))
    read = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").agg(F.count("*"), F.sum("toxic")).first()
    seen = []
    fitted = toxic_words.fit
    monkeypatch.setattr(toxic_words, "fit", lambda found, *more: seen.append(found) or fitted(found, *more))
    models = []
    for few in (500_000, 10):  # labels sent to all tasks, or dealt out with the documents
        monkeypatch.setattr(toxic_words, "FEW_LABELS", few)
        models.append(toxic_words.learn(docs, labels))
        assert (sum(n for _, _, n in seen[-1]), sum(n for y, _, n in seen[-1] if y)) == tuple(read) and read[0] > 12_000
        assert len(seen[-1]) == 2
    assert models[0] == models[1] and models[0][1]["=zubrik"] > 0.5
    assert models[0][0]["wea"] == read[0] - read[1] and models[0][0]["zub"] == read[1]
    monkeypatch.setattr(toxic_words, "HELD", 3)
    assert toxic_words.learn(docs, labels) == models[0]


def plain_features(low):
    words = {t.strip(toxic_words.EDGE) for t in low.split()} - {""}
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in toxic_words.PREFIXES if k < len(w)}


def test_features_are_counted_and_weighted_as_plain_ones():
    rng = random.Random(6)
    lows = ["", "  ", "''' x", *("".join(rng.choice("abstupid.,\n \u3000é日") for _ in range(rng.randint(0, 120))) for _ in range(300))]
    toxic = np.array([rng.randint(0, 1) for _ in lows])
    own = [plain_features(low) for low in lows]
    want = {f: (sum(f in x for x in own), sum(f in x and y for x, y in zip(own, toxic.tolist()))) for f in set().union(*own)}
    got = [(f, (n, bad)) for names, every, toxics in toxic_words.tally(lows, toxic) for f, n, bad in zip(names.to_pylist(), every.tolist(), toxics.tolist())]
    assert len(got) == len(want) and dict(got) == want
    weights = dict.fromkeys(rng.sample(sorted(want), 200), 1.0)
    scorer = toxic_words.Scorer({}, weights, 0.0)
    for low, features in [*zip(lows, own)] * 2:
        assert [scorer.names[k] for k in scorer.hits(low)] == [f for f in weights if f in features]


def test_strings_of_characters_are_counted_as_plain_ones():
    words = {"a": 2, "été": 1, "stupid": 5, "日本": 3, "aaa": 1}
    want = {" ": 12, "  ": 12}
    for word, n in words.items():
        word = f"  {word} "
        for k in range(2, len(word)):
            for size in range(3):
                gram = word[k - size : k + 1]
                want[gram] = want.get(gram, 0) + n
    assert CharacterModel.count(words) == want and CharacterModel.count([]) == {}


def test_flags_do_not_depend_on_the_texts_beside():
    lows = ["tail a", "1 head", "aa", "a", "go s", " u", "x", "h3llo"]
    assert disguised(lows).tolist() == [bool(disguised([x])[0]) for x in lows] == [False] * 7 + [True]


def test_a_disguised_word_is_read_once(monkeypatch):
    model = CharacterModel(CharacterModel.count(["stupid", "the", "way"]))
    want = restore("the stuuupid w4y, s.t.u.p.i.d", model)
    calls = []
    monkeypatch.setattr(toxic_words, "viterbi", lambda *x: calls.append(x) or viterbi(*x))
    model = CharacterModel(model.counts)
    assert restore("the stuuupid w4y, s.t.u.p.i.d\n" * 50, model) == (want + "\n") * 50 and len(calls) == 3


def test_regression_at_any_number_of_documents():
    rng = np.random.default_rng(8)
    kinds = [(int(y), sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist())) for y in rng.integers(0, 2, 40)]
    for times in (1, 1000):
        weight, bias = toxic_words.fit([(y, x, times) for y, x in kinds], 6)
        slope, off = 0.3 * weight, 0.0
        for y, x in kinds:
            d = times * (1 / (1 + math.exp(-(bias + sum(weight[f] for f in x)))) - y)
            off += d
            slope[x] += d
        assert max(abs(slope)) < 1e-3 * times and abs(off) < 1e-3 * times


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) >= 0.93
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in rows) <= 0.02 * len(rows)
    odd = spark.createDataFrame([(1, None), (None, ""), (1, "you 1d10t, p4thetic trash and sc.um")], "doc_id long, text string")
    out = toxicity(odd, labels).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    # nothing to learn from, and nothing to score
    assert [r["score"] for r in toxicity(odd, labels.limit(0)).collect()] == pytest.approx([0.0] * 3, abs=1e-9)
    assert toxicity(docs.limit(0), labels).count() == 0
    more = scored_rows(odd.selectExpr("*", "5 AS toxicity"), labels)
    assert more.columns == ["doc_id", "text", "toxicity"] and more.count() == 3


ITEMS = [(1, "Where does the zorvax river meet the quellin sea? It meets the sea near plonkton harbour."), (2, "Mirbat holds seven lanterns over the frosted gate of orun. They burn."), (3, "Single sentence item about glimmering vokashi stones and nothing more"), (4, None), (5, ""), (None, "no id here at all")]


def test_parts():
    assert parts("One. Two three? Four.") == ("One. Two three? ", "Four.")
    assert parts("a b c d e f") == ("a b c d ", "e f") and parts("one two") == ("one two", "")


def test_decontaminate(spark):
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    changed = ITEMS[0][1].replace("near", "by")
    docs = [(10, filler(500) + " " + ITEMS[0][1] + " " + filler(300)), (11, ITEMS[1][1]), (12, filler(400)), (13, None), (14, ""), (15, filler(77) + " " + changed), (16, "Where does the zorvax river meet the quellin sea? " + filler(40)), (17, ITEMS[2][1].upper() + ". " + ITEMS[1][1]), (17, ITEMS[2][1])]
    frame = spark.createDataFrame([(k, t, 0.5) for k, t in docs], "doc_id long, text string, score double")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate(frame, items).where("leaked = 1").select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(10, 1), (11, 2), (15, 1), (17, 2), (17, 3), (17, 3)]
    assert decontaminate(frame.limit(0), items).count() == 0 and decontaminate(frame, items.limit(0)).count() == 0


def test_scattered_words_leak_nothing(spark):
    """Whatever other items are in the block: a long one makes passages long, not the span that must hold question and answer."""
    rng = np.random.default_rng(6)
    filler = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    scattered = filler(120)
    for k, word in enumerate(ITEMS[0][1].replace("?", "").replace(".", "").split()):
        scattered[7 * k] = word
    copied = [*filler(33), *ITEMS[0][1].split(), *filler(90)]
    between = filler(60) + [y for x in ITEMS[0][1].split() for y in ([x, "hm"] if x in ("the", "sea?") else [x])] + filler(9)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([scattered, copied, between, [*scattered, *copied]])], "doc_id long, text string")
    found = []
    for others in ([], [(9, " ".join(f"v{k}" for k in range(1000)) + ".")]):
        items = spark.createDataFrame(ITEMS[:3] + others, "item_id long, text string")
        found.append(sorted(tuple(r) for r in decontaminate(docs, items).where("leaked = 1").select("doc_id", "item_id", "first_word").collect()))
    assert found == [[(1, 1, 33), (2, 1, 60), (3, 1, 153)]] * 2


def test_search_against_scoring_every_span(spark):
    """Every span of every item at every word of every document, scored plainly; small items blocks and large make no difference."""
    from roadweave.llm import decontam

    rng = np.random.default_rng(12)
    items = [" ".join(f"t{x}" for x in rng.zipf(1.4, rng.integers(4, 25)) % 90) + "? " + " ".join(f"t{x}" for x in rng.zipf(1.4, 4) % 90) + "." for _ in range(30)]
    texts = []
    for k in range(60):
        words = [f"t{x}" for x in rng.zipf(1.4, 150) % 90]
        own = re.findall(r"\w+", items[k % 30])
        at = int(rng.integers(0, 120))
        words[at:at] = [w for w in own if rng.random() > 0.1 * (k % 5)]
        texts.append(" ".join(words[: 40 if k % 7 == 0 else None]))
    texts += ["", None, "t1", items[3] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): tuple(r)[2:5] for r in decontaminate(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}

    bags = [re.findall(r"\w+", x) for x in items]
    df = {t: sum(t in b for b in bags) for b in bags for t in b}
    idf = {t: math.log(1 + (30 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean = sum(map(len, bags)) / 30

    def ordered(part, span):
        best = [0.0] * (len(span) + 1)
        for w in part:
            new = best[:]
            for k, x in enumerate(span):
                new[k + 1] = max(new[k], best[k + 1], best[k] + idf[w] if x == w else 0.0)
            best = new
        return best[-1] / sum(idf[w] for w in part)

    want = {}
    for d, text in enumerate(texts):
        words = re.findall(r"\w+", text or "")
        for i, bag in enumerate(bags):
            weight = {t: idf[t] * bag.count(t) * (K1 + 1) / (bag.count(t) + K1 * (1 - B + B * len(bag) / mean)) for t in set(bag)}
            size = math.ceil(SPAN * len(bag))
            for at in range(len(words)):
                span = words[at : at + size]
                score = sum(weight[t] for t in set(span) & set(bag)) / sum(weight.values())
                if words[at] in weight and score >= THRESHOLD - 1e-6:
                    halves = [ordered(re.findall(r"\w+", p), span) for p in parts(items[i])]
                    if min(halves) > min(want.get((d, i), (0, -1, -1))[1:]) + 1e-8:
                        want[d, i] = (score, *halves)
    assert set(found) == set(want) and len(want) > 30
    assert all(min(found[k][1:]) == pytest.approx(min(want[k][1:]), abs=1e-5) for k in want)
    assert decontam.PASSAGE > 1


def test_wand_finds_what_scoring_all_finds(spark):
    from roadweave.llm.decontam import Index, term_lists

    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.5, 12) % 60) for _ in range(50)]
    lists = term_lists(texts)
    every = np.concatenate([np.unique(x) for x in lists])
    df = {int(t): int((every == t).sum()) for t in every}
    index = Index(list(range(50)), texts, df, 50, 12.0, 0.6)
    for _ in range(200):
        query = np.flatnonzero(rng.random(len(index.terms)) < rng.random()).tolist()
        scores = np.zeros(50)
        for t in query:
            for item, w in zip(*index.postings[t]):
                scores[item] += w
        for limit in (0.3, 0.6):
            assert {i for i, _ in index.wand(query, limit)} == set(np.flatnonzero(scores >= limit - 1e-5).tolist())


def test_language(spark):
    words = {"en": "the of and with that house water stone", "de": "der die und mit das haus wasser stein", "fr": "le la et avec que maison eau pierre"}
    rng = np.random.default_rng(1)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    docs = spark.createDataFrame([(k, text(x, 60), x) for k, x in enumerate(["en", "de", "fr"] * 10)] + [(99, None, None), (98, "x", None)], "doc_id long, text string, lang string")
    pages = [(1, "http://a.example.de/x", f"<html lang='de'><script>the of and</script><p>{text('de', 50)}"), (2, "https://b.example.fr/", f"<p>{text('fr', 50)}</p>"), (3, None, text("en", 40)), (4, "http://a.example.de/y", None), (5, "bad url", ""), (6, None, None), (7, "http://c.example.com/fr/1", "<html lang=fr>")]
    frame = spark.createDataFrame([(*p, "zz", 3.0) for p in pages], "page_id long, url string, html string, lang string, prior double")
    got = {r["page_id"]: r for r in language(frame, docs).collect()}
    assert {k: got[k]["lang"] for k in (1, 2, 3, 4, 7)} == {1: "de", 2: "fr", 3: "en", 4: "de", 7: "fr"} and len(got) == 7
    assert got[1]["declared_lang"] == "de" and got[1]["text_lang"] == "de" and got[6]["text_lang"] is None and all(0 < r["probability"] <= 1 for r in got.values())
    assert language(frame.limit(0), docs).count() == 0
    assert all(r["lang"] is None for r in language(frame, docs.limit(0)).collect())


def test_declarations_and_hidden_parts():
    for html, want in {"<html lang='DE-at'>": "de", "<meta http-equiv='Content-Language' content='fr'>": "fr", "<meta name=x content='en'><meta content-language content=es>": "es", "<html><body lang=en>": None, "": None}.items():
        assert declaration(html) == want
    assert visible("a<script>b</script>c<style>d<!--e--></style>f<!--g-->h<br>i&amp;j").split() == b"a c f h i j".split()
    assert visible("a<script>b").split() == [b"a"] and visible("1 < 2 and 3").split() == b"1 < 2 and 3".split()
    for hard in ("<script " * 200_000, "<html " * 200_000, "<!-- " * 200_000, "<meta content-language " * 100_000, "<" * 500_000):
        began = time.time()
        visible(hard), declaration(hard)
        assert time.time() - began < 5


def test_language_on_pages(spark):
    """Pages whose declaration is taken away or says another language, against what they declared: text, address and host decide."""
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["page_id"]: r["declared_lang"] for r in language(pages, docs).collect()}
    assert all(truth.values())
    for change, said in (("", None), (" lang='en'", "en")):
        found = language(pages.withColumn("html", F.regexp_replace("html", r"(?i)\s+lang\s*=\s*[\"']?[a-z-]+[\"']?", change)), docs).collect()
        assert {r["declared_lang"] for r in found} == {said}
        assert np.mean([r["lang"] == truth[r["page_id"]] for r in found]) >= 0.95 and not any(math.isnan(r["probability"]) for r in found)


def test_many_languages(spark):
    """No language is left out, however rare."""
    rng = np.random.default_rng(2)
    docs = [(100 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in rng.integers(0, 30, 40)), f"l{k}") for k in range(80) for j in range(1 if k else 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    pages = frame.selectExpr("doc_id AS page_id", "'http://x.example' AS url", "text AS html", "lang AS want").where("doc_id % 100 = 0")
    got = language(pages, frame, 5).join(pages.select("page_id", "want"), "page_id").collect()
    assert len(got) == 80 and np.mean([r["lang"] == r["want"] for r in got]) > 0.9


def test_topk_of_repeated_rows(spark):
    rng = np.random.default_rng(7)
    base = [(k, [float(x) for x in rng.integers(-9, 9, 3)], 0) for k in range(30)]
    rows = [*base, *([(100, [1.0, 2.0, 3.0], 0)] * 5), (100, [3.0, 1.0, 0.0], 0)]
    got = sorted(tuple(r) for r in exact_topk(vectors(spark, rows)).collect())
    want = []
    for q, (query, v, _) in enumerate(rows):
        if query % 100 == 0:
            best = sorted((-int(np.floor(1024 * np.array(v)) @ np.floor(1024 * np.array(x))), k) for k, x, _ in rows if k != query)[:10]
            want += [(query, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    assert got == sorted(want)

"""Toxicity of whole texts, after disguised words are restored through a noisy channel.

Writers hide words with digits and signs for letters, with letters drawn out and with letters set apart. A place that looks so becomes a lattice:
each sign may stand for itself or for letters, a drawn-out letter for one or two, a gap for a space or nothing, each at a cost of the channel.
Viterbi finds the reading that a character model and the channel together make likeliest. Words of the restored text, and their beginnings, are the
features of a logistic regression. Both models are fitted on all labelled documents that are not held out.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadweave.llm import textkernel as K
from roadweave.llm.shared import chunks, give_back, text, written

#: Features that the regression keeps, strings in the character model; words or features that a task counts before it hands the counts on.
FEATURES, GRAMS, HELD = 4_000, 200_000, 100_000
#: Rows of labels that go to every task; with more, documents and labels are dealt out by id.
FEW_LABELS = 500_000
#: A feature must stand in so many toxic documents, with so large a likelihood ratio (G) against chance.
SUPPORT, EVIDENCE = 3, 15.0
PREFIXES = range(4, 10)
#: Bytes of texts that are looked at in one go; arrays over them take about 30 times that.
SLICE = 1 << 20
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
GAPS = " .-_*"
#: Channel: log probability that a sign stands for a letter, for itself, a drawn-out letter for one or two, a gap for nothing or a space.
AS_LETTER, AS_SELF, ONCE, TWICE, CLOSED, OPEN = map(math.log, (0.5, 0.05, 0.6, 0.3, 0.7, 0.3))
EDGE = ".,;:!?\"'()[]{}<>*_~`"

RUN = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*])[^\W_])(?:\1[^\W_])+(?![^\W_])")
HIDDEN = re.compile(r"\S*[0-9@$!|+]\S*")
SIGN, SPACE = re.compile(r"[0-9@$!|+]"), re.compile(r"\s")
LETTERS = re.compile(r"[^\W\d_]")

#: What a character is, by its code; all beyond ASCII count as letters here.
_LETTER, _LEET, _GAP, _WIDE = 1, 2, 4, 8
_KIND = np.zeros(129, np.uint8)
_KIND[[*range(0x61, 0x7B), 128]] |= _LETTER | _WIDE
_KIND[0x30:0x3A] |= _WIDE
_KIND[[ord(c) for c in LEET]] |= _LEET | _WIDE
_KIND[[ord(c) for c in GAPS]] |= _GAP


def codes(texts: list[str]) -> np.ndarray:
    """The characters of texts, a line end behind each."""
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")


class CharacterModel:
    """Log probability of a character after the two before it: counts, interpolated with shorter ones."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.kinds = counts, max(1, sum(len(g) == 1 for g in counts))
        self.total = sum(n for g, n in counts.items() if len(g) == 1)
        self.known: dict[str, float] = {}
        self.read: dict[tuple[str, bool], str] = {}

    def __call__(self, before: str, c: str) -> float:
        gram = before + c
        if gram not in self.known:
            get = self.counts.get
            p = (get(c, 0) + 0.5) / (self.total + 0.5 * (self.kinds + 1))
            for k in (1, 0):
                head = gram[k:-1]
                n = get(head, 0)
                p = (get(gram[k:], 0) + 5 * p) / (n + 5)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[gram] = math.log(p)
        return self.known[gram]

    def reading(self, raw: str, spaced: bool) -> str:
        """``viterbi`` of a disguised string, remembered for a while."""
        found = self.read.get((raw, spaced))
        if found is None:
            if len(self.read) > 50_000:
                self.read.clear()
            found = viterbi(lattice(raw, spaced), self)
            if len(raw) <= 100:
                self.read[raw, spaced] = found
        return found

    @staticmethod
    def count(words: list[str] | dict[str, int]) -> Counter:
        """How often each string of three characters or fewer ends within a word or at its end, two spaces before and one behind it."""
        times = Counter(words)
        out: Counter = Counter()
        if not times:
            return out
        code = np.frombuffer("".join([f"  {word} " for word in times]).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, times), np.int64, len(times)) + 3
        own = np.ones(len(code), bool)  # no string begins at a word's last two
        ends = np.cumsum(size)
        own[ends - 1] = own[ends - 2] = False
        at = np.flatnonzero(own)
        n = np.repeat(np.fromiter(times.values(), np.int64, len(times)), size)[at]
        three, which = np.unique(code[at] << 42 | code[at + 1] << 21 | code[at + 2], return_inverse=True)
        total = np.zeros(len(three), np.int64)
        np.add.at(total, which, n)
        for gram, m in zip(three.tolist(), total.tolist()):
            gram = chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)
            for k in range(3):
                out[gram[k:]] += m
        every = sum(times.values())
        out[" "] += every  # the contexts at a word's start
        out["  "] += every
        return out


def lattice(raw: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """What each place of a disguised string may stand for."""
    out, at = [], 0
    while at < len(raw):
        c = raw[at]
        if spaced and c in GAPS:
            out.append([("", CLOSED), (" ", OPEN)])
        elif c in LEET:
            out.append([(x, AS_LETTER - math.log(len(LEET[c]))) for x in LEET[c]] + [(c, AS_SELF)])
        elif c.isalpha():
            end = at + 1
            while end < len(raw) and raw[end] == c:
                end += 1
            if end - at >= 3:
                out.append([(c, ONCE), (c + c, TWICE)])
            else:
                out += [[(c, 0.0)]] * (end - at)
            at = end - 1
        else:
            out.append([(c, 0.0)])
        at += 1
    return out


def viterbi(places: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The likeliest string, among all paths. States are the last two characters."""
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    known = model.known
    for options in [*places, [(" ", 0.0)]]:
        following: dict[str, tuple[float, tuple | None]] = {}
        if len(options) == 1 and len(states) == 1 and len(options[0][0]) == 1:  # one way on
            ((state, (score, path)),), ((out, cost),) = states.items(), options
            gram = state + out
            p = known.get(gram)
            states = {gram[-2:]: (score + cost + (model(state, out) if p is None else p), (path, out))}
            continue
        for state, (score, path) in states.items():
            for out, cost in options:
                total, last = score + cost, state
                for c in out:
                    gram = last + c
                    p = known.get(gram)
                    total += model(last, c) if p is None else p
                    last = gram[-2:]
                if last not in following or total > following[last][0]:
                    following[last] = (total, (path, out))
        states = following
    path = max(states.values(), key=lambda x: x[0])[1]
    parts = []
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))[:-1]


def tokens_with(low: str, sought: re.Pattern, read) -> str:
    """The text with ``read`` in place of each token (between white space) that holds what is sought."""
    parts, done, found = [], 0, sought.search(low)
    while found:
        a, space = found.start(), SPACE.search(low, found.end())
        while a > done and not low[a - 1].isspace():
            a -= 1
        b = space.start() if space else len(low)
        parts += (low[done:a], read(low[a:b]))
        done, found = b, sought.search(low, b)
    return "".join([*parts, low[done:]]) if parts else low


def restore(low: str, model: CharacterModel) -> str:
    """A text in lower case with its disguised places as the channel reads them."""

    def token(raw):
        core = raw.strip(EDGE)
        if len(LETTERS.findall(core)) < 2 or not any(c in LEET for c in core):
            return raw
        at = raw.index(core)
        return raw[:at] + model.reading(core, False) + raw[at + len(core) :]

    def apart(m):
        raw = m.group()
        signs = [c for c in raw if c not in GAPS]
        return model.reading(raw, True) if 2 * sum(c.isalpha() for c in signs) > len(signs) else raw

    def drawn(raw):
        core = raw.strip(EDGE)
        at = raw.index(core)
        return raw[:at] + model.reading(core, False) + raw[at + len(core) :]

    return tokens_with(tokens_with(SPACED.sub(apart, low), SIGN, token), RUN, drawn)


def disguised(lows: list[str]) -> np.ndarray:
    """Which texts in lower case have a place that looks disguised: a sign beside a letter, three of one letter, or letters set apart."""
    code = codes(lows)
    out = np.zeros(len(lows), bool)
    if len(code) < 3:
        return out
    kind = _KIND[np.minimum(code, 128)]
    letter, leet, gap, wide = (kind & x != 0 for x in (_LETTER, _LEET, _GAP, _WIDE))
    odd = np.zeros(len(code), bool)
    odd[1:] |= leet[1:] & letter[:-1]
    odd[:-1] |= leet[:-1] & letter[1:]
    same = code[1:] == code[:-1]
    odd[2:] |= same[1:] & same[:-1] & letter[2:]
    # letters or digits by themselves, none of them beside
    alone = wide.copy()
    alone[1:] &= ~wide[:-1]
    alone[:-1] &= ~wide[1:]
    odd[1:-1] |= gap[1:-1] & alone[:-2] & alone[2:]
    ends = np.cumsum(np.fromiter(map(len, lows), np.int64, len(lows)) + 1)
    out[np.searchsorted(ends, np.flatnonzero(odd), side="right")] = True
    return out


def readings(column: pa.Array, model: CharacterModel):
    """Each text in lower case, restored."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        lows = [(value or "").lower() for value in column.slice(a, b - a).to_pylist()]
        for odd, low in zip(disguised(lows).tolist(), lows):
            yield restore(low, model) if odd else low


def doc_words(lows: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts in lower case, and each pair of a text and a word that it has: the text's number, the word's."""
    split = pc.utf8_split_whitespace(pa.array(lows, pa.large_string()))
    coded = pc.utf8_trim(split.flatten(), EDGE).dictionary_encode()
    doc = np.repeat(np.arange(len(lows)), np.diff(split.offsets.to_numpy()))
    pair = distinct(doc * (len(coded.dictionary) + 1) + coded.indices.to_numpy())
    doc, word = np.divmod(pair, len(coded.dictionary) + 1)
    if len(blank := np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))):
        doc, word = doc[word != blank[0]], word[word != blank[0]]
    return coded.dictionary, doc, word


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def features(words: pa.Array):
    """Of words their features, kind by kind, each with the sign before it and the numbers of the words that have one: words, and beginnings of PREFIXES."""
    every = np.arange(len(words))
    yield "=", words, every
    size = pc.utf8_length(words).to_numpy()
    for k in PREFIXES:
        longer = every[size > k]
        yield "^", pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, k), longer


def tally(lows: list[str], toxic: np.ndarray) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The features of restored texts: in how many texts each stands, and in how many with the label."""
    words, doc, word = doc_words(lows)
    out = []
    for sign, names, own in features(words):
        coded = names.dictionary_encode()
        size = len(coded.dictionary)
        of_word = np.full(len(words), -1, np.int64)
        of_word[own] = coded.indices.to_numpy()
        feature = of_word[word]
        at, feature = doc[feature >= 0], feature[feature >= 0]
        if sign == "^":  # several words of a text may begin alike
            at, feature = np.divmod(distinct(at * (size + 1) + feature), size + 1)
        n, bad = np.bincount(feature, minlength=size), np.bincount(feature[toxic[at] > 0], minlength=size)
        names = pc.binary_join_element_wise(pa.scalar(sign, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        out.append((names.filter(pa.array(n > 0)), n[n > 0], bad[n > 0]))
    return out


class Scorer:
    def __init__(self, counts: dict[str, int], weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = CharacterModel(counts), weights, bias
        self.names = list(weights)
        self.numbers = {f: k for k, f in enumerate(self.names)}
        self.words = {f[1:] for f in weights if f[0] == "="}
        self.heads = {f[1 : PREFIXES[0] + 1] for f in weights if f[0] == "^"}
        self.of_token: dict[str, list[int]] = {}  # of the tokens seen those with weighted features
        self.seen: set[str] = set()
        self.marked: set[str] = set()

    def look(self, tokens: set[str]) -> None:
        """Remembers tokens, and the features of those that may have any."""
        words, heads, first = self.words, self.heads, PREFIXES[0]
        for token in tokens:
            word = token.strip(EDGE)
            if word in words or word[:first] in heads:
                own = ["=" + word, *("^" + word[:k] for k in PREFIXES if k < len(word))]
                self.of_token[token] = [self.numbers[f] for f in own if f in self.numbers]
                self.marked.add(token)
        self.seen |= tokens

    def hits(self, low: str) -> list[int]:
        """The numbers of the weighted features that a restored text has, ascending."""
        tokens = set(low.split())
        fresh = tokens - self.seen
        if fresh:
            if len(self.seen) + len(fresh) > 400_000:
                for held in (self.seen, self.marked, self.of_token):
                    held.clear()
                fresh = tokens
            self.look(fresh)
        return sorted({k for t in tokens & self.marked for k in self.of_token[t]})

    def score(self, low: str) -> float:
        total = self.bias + sum(sorted(self.weights[self.names[k]] for k in self.hits(low)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def fit(rows: list[tuple[int, list[int], int]], size: int, rounds: int = 400, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression over present features; rows: (label, features, how many documents are such).

    Steps are bounded by each feature's own curvature, so they fit any number of documents, and gather speed until the slope turns against them.
    """
    label, times = np.array([y for y, _, _ in rows], float), np.array([n for _, _, n in rows], float)
    # the last feature is the bias, which all rows have
    hits = [[*x, size] for _, x, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in hits])
    col = np.array([f for x in hits for f in x], np.int64)
    held = np.append(np.full(size, ridge), 0.0)
    curve = 0.25 * np.bincount(col, weights=(times * np.bincount(row))[row], minlength=size + 1) + held
    toxic = (label * times).sum()
    weight = np.append(np.zeros(size), math.log((toxic + 0.5) / (times.sum() - toxic + 0.5)))
    ahead, speed = weight, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=ahead[col], minlength=len(rows)), -30, 30)))
        slope = np.bincount(col, weights=(times * (p - label))[row], minlength=size + 1) + held * ahead
        following = ahead - slope / np.where(curve > 0, curve, 1.0)
        if (slope * (following - weight)).sum() > 0:
            speed = 1.0
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, weight, speed = following + (speed - 1) / faster * (following - weight), following, faster
    return weight[:-1], float(weight[-1])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, float], float]:
    """The character counts, weights and bias, from all documents with a label 0 or 1 and crc32(doc_id) % 5 > 0.

    Of rows that share an id one is learned from. At most ``GRAMS`` strings of three characters or fewer are kept, the most frequent.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= FEW_LABELS:
        own = F.broadcast(own)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).join(own, "doc_id")
    found = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(found.select("toxic", "text"), "labelled")

    def letters(batches):
        tokens: Counter = Counter()

        def counted():
            words: Counter = Counter()
            for token, n in tokens.items():
                words[token.strip(EDGE)] += n
            total = CharacterModel.count({w: n for w, n in words.items() if w.isalpha()})
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

        for _, chunk in chunks(batches):
            for value in chunk.column("text").to_pylist():
                tokens.update((value or "").lower().split())
                if len(tokens) > HELD:
                    yield counted()
        yield counted()
        give_back()

    grams = found.mapInArrow(letters, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # a bounded table: strings of three characters at most
    counts = {r["gram"]: r["n"] for r in grams.orderBy(F.desc("n"), "gram").limit(GRAMS).collect()}
    model = CharacterModel(counts)

    def present(batches):
        for _, chunk in chunks(batches):
            for names, n, bad in tally(list(readings(chunk.column("text"), model)), chunk.column("toxic").to_numpy()):
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], ["feature", "n", "bad"])
        give_back()

    counted = found.mapInArrow(present, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    size = found.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in size}
    if not n.get(1) or not n.get(0):
        return counts, {}, -700.0 if not n.get(1) else 700.0
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n[0] + 1.0))
    share, clean = F.lit(n[1] / (n[0] + n[1])), F.col("n") - F.col("bad")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("n") * p))).otherwise(0.0)
    evidence = 2 * (part(F.col("bad"), share) + part(clean, 1 - share))
    best = counted.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).where(evidence >= EVIDENCE).where("odds > 1.5").orderBy(F.desc(evidence), "feature").limit(FEATURES)
    names = [r["feature"] for r in best.select("feature").collect()]
    scorer = Scorer(counts, dict.fromkeys(names, 1.0), 0.0)

    def hit(batches):
        for _, chunk in chunks(batches):
            rows = [scorer.hits(low) for low in readings(chunk.column("text"), scorer.model)]
            yield pa.RecordBatch.from_arrays([chunk.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "hits"])
        give_back()

    # documents of one label and the same features are one row with a count
    alike = found.mapInArrow(hit, "toxic int, hits array<int>").groupBy("toxic", "hits").agg(F.count("*").alias("n"))
    rows = sorted((r["toxic"], list(r["hits"]), r["n"]) for r in alike.collect())
    weight, bias = fit(rows, len(names))
    return counts, {f: round(float(w), 6) for f, w in zip(names, weight)}, round(float(bias), 6)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is divisible by 5), score (0 to 1), predicted (score >= 0.5) of every row.

    Null texts score as empty ones. Only the text is scored. With no toxic label to learn from all score 0; with no clean one, 1.
    Documents that repeat an id are scored each; an id with labels of both kinds counts as toxic. A null id is never held out.
    """
    counts, weights, bias = learn(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((counts, weights, bias))  # bounded: FEATURES weights, 200 000 counts

    def run(batches):
        give_back()
        scorer = Scorer(*held.value)
        for _, chunk in chunks(batches):
            scores = [scorer.score(low) for low in readings(chunk.column("text"), scorer.model)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
        give_back()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with ``toxicity`` of the text as one more column (replacing one of that name)."""
    counts, weights, bias = learn(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((counts, weights, bias))

    schema = T.StructType([*(f for f in docs.schema if f.name != "toxicity"), T.StructField("toxicity", T.DoubleType())])
    shape = to_arrow_schema(schema)

    def run(batches):
        give_back()
        scorer = Scorer(*held.value)
        for _, chunk in chunks(batches):
            texts = chunk.column("text").cast(pa.string())
            scores = [scorer.score(low) for low in readings(texts, scorer.model)]
            columns = [chunk.column(f.name).cast(f.type) for f in list(shape)[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], schema=shape)
        give_back()

    return docs.mapInArrow(run, schema)

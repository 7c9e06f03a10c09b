"""Benchmark items in training texts: BM25 over an inverted index of the items, block-max WAND, then both parts verified.

The items are the indexed side and every passage of every document is a query, so only the index travels: in blocks of ITEMS items
at most, each broadcast by itself. A passage is PASSAGE slots, one starting with every slot, and a slot is so long that the longest item's span
lies whole in the passage that begins with its first slot. Scores are shares of an item's score against itself.

Bounds come first, for a chunk's passages at once: terms that few items hold give each passage, per group of GROUP items, the sum of their largest
weights there; the frequent terms together add at most a constant. A passage whose bounds all stay under the threshold holds no item. The others go
through the posting lists with pivots (WAND), in the groups whose block maxima can reach the threshold. All items at or above it are
found.

Passages only retrieve. A pair is judged within spans of SPAN times the item's own words, whatever other items are in the block: the span's words
must reach the threshold, and question and answer count the words that stand there in their order.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K
from roadweave.llm.shared import chunks, give_back, text

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage needs, and share of the weight of question and answer each.
THRESHOLD, OVERLAP = 0.6, 0.6
#: Words of a span for each word of the item, for words put in between.
SPAN = 1.5
#: Items of a block, items of a group, and slots of a passage: the more slots, the fewer words beside a span.
ITEMS, GROUP, PASSAGE = 1024, 8, 5
#: Passages whose bounds are summed at once.
ROWS = 8192
SENTENCE = re.compile(r"[.!?](?:\s+)(?=\S)")


def parts(item: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and that; of a single sentence the last third of its words."""
    cuts = list(SENTENCE.finditer(item))
    if cuts:
        return item[: cuts[-1].end()], item[cuts[-1].end() :]
    words = list(re.finditer(r"\S+", item))
    at = words[-(-2 * len(words) // 3)].start() if len(words) >= 3 else len(item)
    return item[:at], item[at:]


def term_lists(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    hashes, doc, _ = K.words(data, offsets, K.ALNUM)
    return np.split(hashes, np.searchsorted(doc, np.arange(1, len(texts))))


class Index:
    """Posting lists of a block of items. ``df``: in how many of all ``total`` items a term occurs; ``mean``: their mean length."""

    def __init__(self, ids: list[int], texts: list[str], df: dict[int, int], total: int, mean: float, threshold: float):
        words = term_lists(texts)
        full = [k for k, w in enumerate(words) if len(w)]
        self.ids, words = [ids[k] for k in full], [words[k] for k in full]
        self.spans = [int(np.ceil(SPAN * len(w))) for w in words]
        self.stride = max(self.spans, default=1)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        n, size = len(self.terms), len(words)
        idf = np.array([np.log(1 + (total - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in self.terms])
        weight = np.zeros((n, size), np.float32)
        for k, own in enumerate(words):
            at, tf = np.unique(np.searchsorted(self.terms, own), return_counts=True)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            weight[at, k] = w / w.sum()
        self.postings = [(np.flatnonzero(row).tolist(), row[row > 0].tolist()) for row in weight]
        self.by_group: list[dict[int, tuple[list[int], list[float], float]]] = [{} for _ in range(-(-size // GROUP))]
        for t, (items, values) in enumerate(self.postings):
            for group in sorted({k // GROUP for k in items}):
                part = [(k, v) for k, v in zip(items, values) if k // GROUP == group]
                self.by_group[group][t] = ([k for k, _ in part], [v for _, v in part], max(v for _, v in part))
        groups = -(-size // GROUP) if size else 0
        padded = np.zeros((n, groups * GROUP), np.float32)
        padded[:, :size] = weight
        self.group_max = padded.reshape(n, groups, GROUP).max(axis=2)
        self.most = weight.max(axis=1, initial=0)
        # the most frequent terms, as long as they add little to any item
        self.essential = np.ones(n, bool)
        reach = np.zeros(size, np.float32)
        for t in np.argsort(-np.count_nonzero(weight, axis=1), kind="stable").tolist():
            if (reach + weight[t]).max(initial=0) > threshold / 2:
                break
            reach += weight[t]
            self.essential[t] = False
        self.rest = np.zeros(groups * GROUP, np.float32)
        self.rest[:size] = reach
        self.rest = self.rest.reshape(groups, GROUP).max(axis=1) if groups else self.rest
        self.own = [(at := np.flatnonzero(weight[:, k]), weight[at, k].astype(np.float64)) for k in range(size)]
        self.halves = []  # words of question and answer in order, as places among the item's own terms, and their weights
        for k, (own, _) in zip(full, self.own):
            pair = []
            for part in parts(texts[k]):
                at = np.searchsorted(self.terms, term_lists([part])[0])
                pair.append((np.searchsorted(own, at), idf[at]))
            self.halves.append(pair)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the terms among hashes of words."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        likely = np.zeros(1 << 16, bool)
        likely[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(likely[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[term] == hashes[at]
        return at[same], term[same]

    def wand(self, terms: list[int], threshold: float, groups: list[int] | None = None) -> list[tuple[int, float]]:
        """Items with a score at or above the threshold for these distinct terms, of all groups or those named. Block-max WAND.

        A group whose block maxima can't reach the threshold is passed over; within a group a list's bound is its block maximum.
        """
        slack = 1e-5  # sums of single precision
        found = []
        if groups is None:
            groups = np.flatnonzero(self.group_max[terms].sum(axis=0) >= threshold - slack).tolist()
        for group in groups:
            own = self.by_group[group]
            lists = [[*own[t], 0] for t in terms if t in own]  # items, weights, bound, place
            while lists:
                lists.sort(key=lambda x: x[0][x[3]])
                total, pivot = 0.0, None
                for k, x in enumerate(lists):
                    total += x[2]
                    if total >= threshold - slack:
                        pivot = k
                        break
                if pivot is None:
                    break
                item = lists[pivot][0][lists[pivot][3]]
                if lists[0][0][lists[0][3]] == item:
                    score = 0.0
                    for x in lists:
                        if x[0][x[3]] != item:
                            break
                        score += x[1][x[3]]
                        x[3] += 1
                    if score >= threshold - slack:
                        found.append((item, min(1.0, score)))
                else:
                    for x in lists[:pivot]:
                        while x[3] < len(x[0]) and x[0][x[3]] < item:
                            x[3] += 1
                lists = [x for x in lists if x[3] < len(x[0])]
        return found


def in_order(words: np.ndarray, weights: np.ndarray, found: np.ndarray) -> float:
    """The most weight of words that stand among the found ones in the same order, as a share."""
    if not len(words):
        return 1.0
    best = np.zeros(len(found) + 1)
    for word, weight in zip(words.tolist(), weights.tolist()):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(found == word, best[:-1] + weight, 0)))
    return round(float(best[-1] / weights.sum()), 9)


def best_span(index: Index, item: int, place: np.ndarray, term: np.ndarray, before: int, threshold: float) -> tuple[float, float, float, int] | None:
    """(score, question overlap, answer overlap, first word) of the span that verifies an item best, of those at or above the threshold.

    ``place`` and ``term``: a passage's words that items hold. Spans begin at one of the item's words, at a place before ``before``.
    """
    own, weight = index.own[item]
    mine = np.isin(term, own)
    place, word = place[mine], np.searchsorted(own, term[mine])
    starts = int(np.searchsorted(place, before))
    ends = np.searchsorted(place, place[:starts] + index.spans[item])
    seen = np.zeros((len(word) + 1, len(own)), np.int32)
    seen[np.arange(len(word)) + 1, word] = 1
    seen = np.cumsum(seen, axis=0)
    present = seen[ends] > seen[:starts]
    score = present @ weight
    bound = np.ones(starts)  # words in any order
    for words, weights in index.halves[item]:
        if len(words):
            bound = np.minimum(bound, present @ np.bincount(words, weights, len(own)) / weights.sum())
    best = None
    for k in np.lexsort((-score, -bound)).tolist():
        if best and bound[k] <= min(best[1:3]) + 1e-9:
            break
        if score[k] >= threshold - 1e-5:
            shares = [in_order(*half, word[k : ends[k]]) for half in index.halves[item]]
            if not best or min(shares) > min(best[1:3]):
                best = (min(1.0, float(score[k])), *shares, int(place[k]))
    return best


def search(index: Index, column: pa.Array, threshold: float) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word of the span) for the best span of each pair."""
    data, offsets = K.text_bytes(column)
    hashes, doc, _ = K.words(data, offsets, K.ALNUM)
    if not len(index.ids) or not len(hashes):
        return []
    place, term = index.find(hashes)
    nth = place - np.searchsorted(doc, doc[place])
    stride = max(1, -(-index.stride // (PASSAGE - 1)))  # so that a passage holds any span that begins in its first slot
    count = np.bincount(doc, minlength=len(offsets) - 1)
    slots = np.maximum(1, -(-count // stride))
    slot0 = np.cumsum(slots) - slots
    slot = slot0[doc[place]] + nth // stride
    heavy = index.essential[term]
    pairs = np.unique(slot[heavy] * len(index.terms) + term[heavy])
    if not len(pairs):
        return []
    own = pairs // len(index.terms)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    bound = np.add.reduceat(index.group_max[pairs % len(index.terms)], starts)
    live = own[starts]
    # a passage is a run of PASSAGE slots of one document; its bound is the sum of theirs
    owner = np.searchsorted(slot0, live, side="right") - 1
    first = live[:, None] - np.arange(PASSAGE)  # the passages that hold a slot with heavy terms
    row, back = np.nonzero(first >= slot0[owner][:, None])
    passage = first[row, back]
    order = np.argsort(passage, kind="stable")
    passage, row = passage[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    groups: dict[int, list[int]] = {}
    for lo in range(0, len(begin), ROWS):
        part = begin[lo : lo + ROWS]
        upto = begin[lo + ROWS] if lo + ROWS < len(begin) else len(row)
        reach = np.add.reduceat(bound[row[part[0] : upto]], part - part[0]) + index.rest >= threshold - 1e-5
        groups.update((int(passage[part[k]]), np.flatnonzero(reach[k]).tolist()) for k in np.flatnonzero(reach.any(axis=1)).tolist())
    best: dict[tuple[int, int], tuple] = {}
    by_slot = np.searchsorted(slot, np.arange(int(slots.sum()) + 1))
    for s, own_groups in groups.items():
        d = int(np.searchsorted(slot0, s, side="right")) - 1
        last = min(s + PASSAGE, int(slot0[d] + slots[d]))
        here = slice(by_slot[s], by_slot[last])
        words = nth[here]
        for item, _ in index.wand(sorted(set(term[here].tolist())), threshold, own_groups):
            span = best_span(index, item, words, term[here], int(s - slot0[d] + 1) * stride, threshold)
            if span and ((d, item) not in best or min(span[1:3]) > min(best[d, item][1:3])):
                best[d, item] = span
    return [(d, item, *x) for (d, item), x in best.items()]


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, leaked int"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((x, pa.float64()) for x in ("score", "question_overlap", "answer_overlap")), ("first_word", pa.int64()), ("leaked", pa.int32())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """For each document and item with a span at or above the threshold: doc_id, item_id, score (share of the item's own BM25),
    question_overlap, answer_overlap (shares of their idf weight that stand in the span in order), first_word of the span, leaked (1 if both overlaps suffice).

    Null and empty texts hold nothing, items without words are never found. Rows that share an id are documents, or items, each
    for itself. Items without an id are left out. Other columns are left out.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(text(benchmark), F.lit("")).alias("text")).where("item_id is not null")

    def terms(batches):
        for batch in batches:
            for own in term_lists(batch.column("text").to_pylist()) if batch.num_rows else []:
                distinct = np.unique(own).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.full(len(distinct), len(own)) if len(own) else [], pa.int64())], ["term", "words"])

    total, = items.agg(F.count("*")).first()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs))
    if not total:
        return spark.createDataFrame([], FOUND)
    blocks = -(-total // ITEMS)
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    frequency = items.mapInArrow(terms, "term long, words long").groupBy("term").agg(F.count("*").alias("df"))
    mean = items.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))).alias("n")).agg(F.avg("n")).first()[0] or 1.0
    out = None
    for block in range(blocks):
        own = items.where(block_of == block)
        rows = own.orderBy("item_id", "text").collect()
        df = own.mapInArrow(terms, "term long, words long").select("term").distinct().join(frequency, "term").collect()
        index = Index([r["item_id"] for r in rows], [r["text"] for r in rows], {r["term"] % (1 << 64): r["df"] for r in df}, total, mean, threshold)
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            give_back()
            index = held.value
            for _, chunk in chunks(batches):
                ids = chunk.column("doc_id").to_pylist()
                found = [(ids[d], index.ids[item], round(score, 6), round(q, 6), round(a, 6), at, int(q >= overlap and a >= overlap)) for d, item, score, q, a, at in search(index, chunk.column("text"), threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND_ARROW)], schema=FOUND_ARROW)
            give_back()

        part = source.mapInArrow(run, FOUND)
        out = part if out is None else out.union(part)
    return out

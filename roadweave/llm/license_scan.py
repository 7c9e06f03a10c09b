"""License notices in whole texts: exact phrases of words, and short notices with a few edits.

A notice of m letters may have m // 10 errors. Cut in one part more than that, one part stands there unchanged (pigeonhole), so exact searches
for the parts find all candidates; around each the regex library matches the whole notice with bounded errors. What tells a notice from its siblings
(versions, variants) must stand unedited. Texts are compared as words in lower case with one space between, byte by byte; spans are bytes of the text itself.
"""

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K
from roadweave.llm.shared import chunks, text

#: Phrases of words and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wordings of common notices and the labels they add. Words in brackets must stand as they are.
NOTICES = {
    "licensed under the apache license version [2 0]": "apache-2.0",
    "apache license version [1 1]": "apache-1.1",
    "released under the [mit] license": "mit-notice",
    "released under the [bsd] license": "bsd-notice",
    "gnu general public license version [3]": "gpl-3.0",
    "gnu general public license version [2]": "gpl-2.0",
    "gnu [lesser] general public license": "lgpl",
    "gnu [affero] general public license": "agpl",
    "mozilla public license version [2 0]": "mpl-2.0",
    "mozilla public license version [1 1]": "mpl-1.1",
    "licensed under [cc by 4 0]": "cc-by-4.0",
    "licensed under [cc by sa 4 0]": "cc-by-sa-4.0",
    "licensed under [cc by nc 4 0]": "cc-by-nc-4.0",
    "licensed under [cc by nd 4 0]": "cc-by-nd-4.0",
    "creative commons attribution": "creative-commons",
    "permission is hereby granted free of charge": "mit-text",
    "redistribution and use in source and binary forms": "bsd",
}
LETTERS_FOR_AN_ERROR = 10

SPAN = "array<struct<label: string, start: long, end: long, edits: int>>"
SCAN = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"
SPAN_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
SCAN_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPAN_ARROW)])


class Notice:
    def __init__(self, wording: str, label: str):
        self.raw, self.label = re.sub(r"[\[\]]", "", wording).encode(), label
        self.errors = len(self.raw) // LETTERS_FOR_AN_ERROR
        cuts = [k * len(self.raw) // (self.errors + 1) for k in range(self.errors + 2)]
        self.seeds = [(self.raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        edge, parts = rb"(?<![0-9a-z\x80-\xff])(?:%s)(?![0-9a-z\x80-\xff])", []
        for k, part in enumerate(re.split(r"[\[\]]", wording)):  # every second one stands in brackets
            fixed = regex.escape(part.encode(), special_only=True)
            if part:
                parts.append(edge % fixed if k % 2 else rb"(?:%s){e<=%d}" % (fixed, self.errors))
        self.pattern = regex.compile(rb"(?b)" + edge % b"".join(parts))

    def find(self, text: bytes, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of matches in the windows; of those that overlap the one with the fewest edits, then the first."""
        found = set()
        for lo, hi in windows:
            m = self.pattern.search(text, lo, hi)
            if m and sum(m.fuzzy_counts) <= self.errors:
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int, int]] = []
        taken = SortedSpans()
        for edits, start, end in sorted(found):
            if taken.add(start, end):
                kept.append((start, end, edits))
        return kept


class SortedSpans:
    """Spans that don't overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start)
        if (k and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def places(text: bytes, what: bytes):
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def scan_chunk(column: pa.Array, base: dict[str, str], notices: list[Notice]) -> list[tuple]:
    """For each text n_words, n_base, first_word, last_word, base labels, labels, score, spans."""
    data, offsets = K.text_bytes(column)
    docs = len(offsets) - 1
    low = K.LOWER[data]
    starts, ends, doc = K.word_spans(low, offsets, K.ALNUM)
    n_words = np.bincount(doc, minlength=docs)
    # words with one space after each; a text starts anew with a line end
    keep = K.ALNUM[low]
    after = ends[(ends < len(low))]
    after = after[~keep[after]]
    keep[after] = True
    place = np.flatnonzero(keep)
    flat = np.where(K.ALNUM[low], low, 0x20)[place]
    bounds = np.searchsorted(place, offsets)
    whole = flat.tobytes()
    firsts = np.searchsorted(place, starts)
    word0 = np.cumsum(n_words) - n_words
    base_hits: dict[int, list[tuple[int, int, int, str]]] = {}
    word_start = np.zeros(len(flat) + 1, bool)
    word_start[firsts] = True
    for phrase, label in base.items():
        raw = phrase.encode()
        for at in places(whole, raw):
            d = int(np.searchsorted(bounds, at, side="right")) - 1
            end = at + len(raw)
            if word_start[at] and end <= bounds[d + 1] and (end == bounds[d + 1] or flat[end] == 0x20 or word_start[end]):
                base_hits.setdefault(d, []).append((int(np.searchsorted(firsts, at)) - int(word0[d]), at, end, label))
    candidates: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, notice in enumerate(notices):
        for seed, shift in notice.seeds:
            for at in places(whole, seed):
                d = int(np.searchsorted(bounds, at, side="right")) - 1
                lo = max(int(bounds[d]), at - shift - notice.errors - 1)
                hi = min(int(bounds[d + 1]), at - shift + len(notice.raw) + notice.errors + 1)
                candidates.setdefault((d, k), []).append((lo, hi))
    fuzzy: dict[int, list[tuple[int, int, int, str]]] = {}
    for (d, k), windows in candidates.items():
        first = int(bounds[d])
        own = whole[first : bounds[d + 1]]
        for start, end, edits in notices[k].find(own, [(lo - first, hi - first) for lo, hi in sorted(set(windows))]):
            fuzzy.setdefault(d, []).append((edits, first + start, first + end, notices[k].label))
    rows = []
    for d in range(docs):
        own, more = base_hits.get(d, []), fuzzy.get(d, [])
        if not own and not more:
            rows.append((int(n_words[d]), 0, None, None, "", "", 0.0, []))
            continue
        words = [x[0] for x in own]
        labels = {x[3] for x in own}
        spans = sorted((int(place[a]) - int(offsets[d]), int(place[b - 1]) + 1 - int(offsets[d]), label, edits) for edits, a, b, label in [(0, *x[1:]) for x in own] + more)
        score = 1.0 if own else max(1 - edits / (b - a) for edits, a, b, _ in more)
        rows.append((int(n_words[d]), len(own), min(words, default=None), max(words, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[3] for x in more})), score, [{"label": x[2], "start": x[0], "end": x[1], "edits": x[3]} for x in spans]))
    return rows


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start and end in bytes, edits).

    Score: 1 with a base phrase, else the best notice's share of letters that need no edit, else 0. Null and empty texts hold
    nothing; rows that are alike are scanned each for itself; other columns are left out. ``notices``: wordings in lower case with single spaces,
    and labels; what stands in brackets must stand in the text unedited.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices

    def run(batches):
        own = [Notice(*x) for x in notices.items()]
        for _, chunk in chunks(batches):
            columns = list(zip(*scan_chunk(chunk.column("text"), base, own)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(SCAN_ARROW)[1:]))], schema=SCAN_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)).mapInArrow(run, SCAN)

"""Token ids of whole texts through the tokenizers library, which sees each distinct piece between spaces once in a while."""

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np

from roadweave.llm import textkernel as K
from roadweave.llm.shared import HELD

#: Pieces kept by a worker, in two generations, and the longest one kept; bytes of text that are cut at once, and pieces that are encoded at once.
KEPT, LONGEST, RUN, FRESH = 1_200_000, 48, 1 << 20, 1 << 12
#: Letters and digits that stay one letter or digit in any case and beside any sign: ASCII and Latin ones. Capital dotted I becomes two characters.
PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LETTERS = re.compile(f"[{PLAIN.removeprefix('0-9')}]+")
BETWEEN_BARS = re.compile(rf"[{PLAIN}](?:.*[{PLAIN}])?", re.S)
#: Bytes that begin no white space, by themselves or with those that may follow; ASCII letters and digits.
DARK, PLAIN_BYTE = np.ones(256, bool), np.zeros(256, bool)
DARK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE3]] = False
PLAIN_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

_loaded: dict[str, "TokenIds"] = {}
HELD.append(_loaded.clear)


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before each of its bytes: before a space that something dark follows, around a single line end between
    dark ASCII, and between a PLAIN letter or digit and a stop or comma that such a space or line end follows."""
    at = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(3, np.uint8)])  # two before, three behind
    here, one, two, three = at[2:-3], at[3:-2], at[4:-1], at[5:]
    before, earlier = at[1:-4], at[:-5]
    dark = DARK[one]
    # of the characters E2 80 .. and E2 81 .. some are white space
    dark &= (one != 0xE2) | ((two != 0x80) & (two != 0x81)) | ((three >= 0x8B) & (three != 0xA8) & (three != 0xA9) & (three != 0xAF) & (three != 0x9F))
    space = (here == 0x20) & dark
    line = (here == 0x0A) & dark & DARK[before] & (before < 0x80)
    latin = (before >= 0x80) & (before < 0xC0) & (earlier >= 0xC3) & (earlier <= 0xC5)
    latin &= ~((earlier == 0xC3) & ((before == 0x97) | (before == 0xB7))) & ~((earlier == 0xC4) & (before == 0xB0))
    stop = ((here == 0x2C) | (here == 0x2E)) & (PLAIN_BYTE[before] | latin)
    out = space | line
    stop[:-1] &= out[1:]
    stop[-1:] = False
    out |= stop
    out[1:] |= line[:-1]
    return out


#: How the vocabularies whose texts may be cut normalize and split, as their files say it.
WORDS_APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LOWER_CASE = ["NFC", "Replace", "Lowercase"]


def may_cut(spec: dict) -> bool:
    """Whether a vocabulary file splits texts by one of the two known rules, so that it never joins what ``TokenIds`` cuts apart.

    Byte-level: the rule takes a space with what follows it, and letters, digits, other signs and white space apart; nothing is normalized.
    Words: white space goes, letters, digits and other signs are taken apart; composition and lower case join or change nothing across
    white space, and PLAIN letters stay letters. Special tokens hold neither white space nor a stop or comma beside a letter.
    """
    if any(re.search(r"\s|[.,]", x["content"]) or x["normalized"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
        return False
    split, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if split.get("type") == "ByteLevel":
        return normal is None and split["use_regex"] and not split["add_prefix_space"]
    parts = split.get("pretokenizers") or [{}]
    known = normal and [x["type"] for x in normal.get("normalizers", [])] == LOWER_CASE and normal["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
    return bool(known) and parts[0].get("pattern") == {"Regex": WORDS_APART} and parts[0]["invert"] and not parts[-1].get("use_regex", True)


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    upto = np.cumsum(size)
    at = np.repeat((starts - upto + size).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return at


class Known:
    """Pieces and their ids in arrays, about 40 bytes for each: a piece is found by its hash, and its bytes are compared."""

    def __init__(self, kind: np.dtype):
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending, and the number of the piece
        self.start, self.size, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(8, np.uint8)
        self.at, self.n, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece's first id in ``ids`` and their number, -1 if it isn't here."""
        at, n = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        if len(self):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
            own = self.slot[near]
            hit = np.flatnonzero((self.hashes[near] == hashes) & (self.size[own] == size))
            hit = hit[K.equal_spans(data, starts[hit], self.text, self.start[own[hit]], size[hit])]
            at[hit], n[hit] = self.at[own[hit]], self.n[own[hit]]
        return at, n

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Takes pieces of distinct hashes, but for those whose hash another piece has here."""
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        if len(self):
            free = self.hashes[np.minimum(place, len(self) - 1)] != hashes[order]
            order, place = order[free], place[free]
        hashes, starts, size, at, n = (x[order] for x in (hashes, starts, size, at, n))
        self.slot = np.insert(self.slot, place, np.arange(len(self), len(self) + len(order)))
        self.hashes = np.insert(self.hashes, place, hashes)
        self.start = np.append(self.start, (len(self.text) - 8 + np.cumsum(size) - size).astype(np.int32))
        self.size = np.append(self.size, size.astype(np.uint8))
        self.text = np.concatenate([self.text[:-8], data[spread(starts, size)], self.text[-8:]])
        self.at = np.append(self.at, (len(self.ids) + np.cumsum(n) - n).astype(np.int32))
        self.n = np.append(self.n, n.astype(np.uint16))
        self.ids = np.append(self.ids, ids[spread(at, n)])


class TokenIds:
    """The ids as little-endian unsigned 32-bit integers, those of ``encode(text, add_special_tokens=False)`` of the whole text.

    Where ``may_cut`` holds, texts are cut where ``cuts`` says and each distinct piece is encoded by itself, once in a while. Pieces are told apart
    by a hash, and what it takes for alike is compared. Texts of other vocabularies, and such as may hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.cut = may_cut(spec)
        self.folds = self.cut and bool(spec["normalizer"])  # A-Z are a-z, and white space goes
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        kind = np.dtype(np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32)
        self.known, self.older = Known(kind), Known(kind)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space, or end a word
        self.edge[[k for token, k in vocab.items() if (token.endswith("</w>") if self.folds else token.startswith("\u0120"))]] = True
        bar = self.tokenizer.encode("a|b", add_special_tokens=False).ids
        self.bar = bar[1] if len(bar) == 3 else None

    def encode_barred(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as one text with bars between, where a bar is always an id of its own. No piece holds a bar or ends where it could join one."""
        if self.bar is None:
            return self.encode(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast(["|".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.bar)
        return self.parts(ids, np.append(0, ends + 1), np.append(ends, len(ids)))

    def encode_plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as one text, where the ids show at which a piece begins (byte-level: with its one space) or ends (words of letters)."""
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.folds else "").join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(pieces):
            return self.encode(pieces)
        return self.parts(ids, np.append(0, at[:-1] + 1), at + 1) if self.folds else self.parts(ids, at, np.append(at[1:], len(ids)))

    @staticmethod
    def parts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    def encode_fresh(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        plain, barred, rest = [], [], []
        for k, p in enumerate(pieces):
            easy = LETTERS.fullmatch(p) if self.folds else p[0] == " " and " " not in p[1:]
            (plain if easy else barred if "|" not in p and BETWEEN_BARS.fullmatch(p) else rest).append(k)
        for own, how in ((plain, self.encode_plain), (barred, self.encode_barred), (rest, self.encode)):
            if own:
                for k, ids in zip(own, how([pieces[k] for k in own]), strict=True):
                    out[k] = ids
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_slices(self, pieces: Iterator[bytes]) -> Iterator[np.ndarray]:
        """The ids of each piece, FRESH pieces encoded at once: the library takes over 100 bytes for each id while it encodes."""
        while own := [p.decode() for p in islice(pieces, FRESH)]:
            for ids in self.encode_fresh(own):
                yield np.frombuffer(ids, "<u4").astype(self.known.ids.dtype)

    def look_up(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids among which those of distinct pieces stand, the place of each piece's first one, and their number. Eight bytes follow the text in ``data``."""
        known, older = self.known, self.older
        at, n = known.find(hashes, data, starts, size)
        late = np.flatnonzero(n < 0)
        at[late], n[late] = older.find(hashes[late], data, starts[late], size[late])
        at[late] += len(known.ids)
        fresh = late[n[late] < 0]
        raw = data.data
        ids = list(self.encode_slices(raw[a:b].tobytes() for a, b in zip(starts[fresh].tolist(), (starts + size)[fresh].tolist())))
        n[fresh] = [len(x) for x in ids]
        at[fresh] = len(known.ids) + len(older.ids) + np.cumsum(n[fresh]) - n[fresh]
        pool = np.concatenate([known.ids, older.ids, *ids])
        late = late[size[late] <= LONGEST]
        if len(known) + len(late) > KEPT // 2:
            self.older, self.known = known, Known(known.ids.dtype)
        self.known.add(hashes[late], data, starts[late], size[late], pool, at[late], n[late])
        return pool, at, n

    def run(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts, cut all at once."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        if self.folds:
            data = np.where(np.append(data[1:], 0) < 0x80, K.LOWER[data], data)  # no mark beyond ASCII follows that could join the letter
        ends = np.cumsum([len(x) for x in raw])
        begins = cuts(data)
        begins[ends - [len(x) for x in raw]] = True  # a stop before the end of a text stays with its word
        late = ends[:-1][ends[:-1] < len(data)]
        for k in (1, 2):  # what was seen behind the end belongs to the next text
            begins[np.maximum(late - k, 0)] = False
        begins[ends - [len(x) for x in raw]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(data))
        begin_of = starts
        if self.folds:  # nor does the space before a word matter
            starts = starts + ((data[starts] == 0x20) & (stops - starts > 1))
        hashes = K.word_hash(data, starts, stops)
        first, which = K.alike(hashes)
        if not K.same_bytes(data, starts, stops, first[which]):
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            if not K.same_bytes(data, starts, stops, first[which]):
                return self.encode([x.decode() for x in raw])
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        pool, base, size = self.look_up(hashes[first], data, starts[first], (stops - starts)[first])
        length = size[which]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = pool[spread(base[which], length)].astype("<u4", copy=False).tobytes()
        edges = 4 * upto[np.searchsorted(begin_of, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def many(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        own, raw, total = [], [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.cut or "<|" in text:
                out[k] = self.encode([text])[0]
                continue
            own.append(k)
            raw.append(text.encode())
            total += len(raw[-1])
            if total > RUN:
                for at, ids in zip(own, self.run(raw)):
                    out[at] = ids
                own, raw, total = [], [], 0
        if raw:
            for at, ids in zip(own, self.run(raw)):
                out[at] = ids
        return out


def token_ids(path: str) -> TokenIds:
    """The worker's own tokenizer for that vocabulary file."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def by_run(tokens: TokenIds, column) -> Iterator[bytes]:
    """The ids of each text of an Arrow column, RUN bytes of text at a time."""
    held, total = [], 0
    for value in column:
        held.append(value.as_py())
        total += len(held[-1] or "")
        if total > RUN:
            yield from tokens.many(held)
            held, total = [], 0
    yield from tokens.many(held)

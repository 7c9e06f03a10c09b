"""Removal of every byte that a repeated string of ``length`` bytes covers.

The Burrows-Wheeler order of a collection is built column by column, one symbol of each text a round, with the
common prefixes of neighbours (Bauer, Cox, Rosone, Sciortino). Whole documents would need as many rounds as the
longest has bytes, each a pass over all; so the windows of ``length`` bytes are dealt out first:

1. A window's key is the least hash of its GRAM-byte strings (leftmost of equals), which depends on nothing but the
   window; runs of windows with one key place are pieces. Keys are counted by hash; a key that occurs once is unique.
2. Pieces of the other keys go to the bucket of their key, equal ones as one with their number. There each is
   aligned at its key place and round by round one symbol of every piece is put in front: a stable partition of the
   order by symbol is the next column of the transform, and common prefixes follow as one more than the least
   between two neighbours with the same symbol. Order and prefixes go through sequential column files, in memory up
   to SPOOL_BYTES and in the task's own scratch file beyond. A window is repeated if its neighbour has ``length`` symbols in common with
   it, or if its piece occurs twice.
3. The repeated windows go back to their chunks, which cut the texts.
A key with HOT or more pieces (a passage that very many texts share) is dealt out by a second key within the first.
"""

import tempfile
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadweave.llm import textkernel as K
from roadweave.llm.shared import BLOCK, batched, buckets, by_chunk, by_key, chunks, partitions, scanned, text, text_blocks, text_of

LENGTH, GRAM = 400, 64
HOT = 20_000
SPOOL_BYTES = 32 << 20
#: Bytes whose windows are hashed at once; some twenty arrays of eight bytes for each stand beside them.
SEGMENT = 1 << 17
PLACE = np.uint64((1 << 24) - 1)


def segments(offsets: np.ndarray, length: int):
    """Byte ranges that hold each window of ``length`` bytes once: runs of whole documents, or overlapping parts of a long one."""
    first, docs = 0, len(offsets) - 1
    while first < docs:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, side="right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        while hi - lo > 2 * SEGMENT:
            yield lo, lo + SEGMENT + length - 1
            lo += SEGMENT
        yield lo, hi
        first = last


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of its least, by the upper 40 bits, leftmost of equals."""
    n = len(hashes)
    rows = -(-n // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:n] = (hashes & ~PLACE) | np.arange(n, dtype=np.uint64)
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & PLACE).astype(np.int64)


class Pieces:
    """Runs of windows with one key: ``key``, ``content`` (digest of the bytes), ``start``, ``windows``, ``anchor`` (place of the key in the piece).

    ``hot``: ascending keys whose runs a second key divides further.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None):
        parts = []
        for lo, hi in segments(offsets, length):
            if hi - lo < length:
                continue
            part = data[lo:hi]
            sums = K.rolling(part)
            at = np.arange(len(part) - gram + 1)
            grams = span = K.span_hash(sums, at, at + gram)
            place = least_places(grams, length - gram + 1)
            windows = len(place)
            bounds = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left") + 1] - lo
            valid = np.ones(windows, bool)
            for end in bounds[bounds < hi - lo].tolist():  # windows over the end of a document
                valid[max(0, end - length + 1) : end] = False
            new = np.ones(windows, bool)
            new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
            if hot is not None and len(hot):
                own = span[place]
                found = np.searchsorted(hot, own)
                is_hot = hot[np.minimum(found, len(hot) - 1)] == own
                second = least_places(K.mix(grams ^ np.uint64(K.MIX[0])), length - gram + 1)
                new[1:] |= is_hot[1:] & (second[1:] != second[:-1])
            start = np.flatnonzero(new)
            count = np.diff(start, append=windows)
            kept = valid[start]
            start, count = start[kept], count[kept]
            key = span[place[start]]
            if hot is not None and len(hot):
                deeper = is_hot[start]
                key = np.where(deeper, K.mix(key + K.mix(span[second[start]] ^ np.uint64(K.MIX[1]))), key)
            end = start + count + length - 1
            raw = part.tobytes()
            content = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())]), "<u8").astype(np.uint64)
            parts.append((key, content, start + lo, count, place[start] - start))
        empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        self.key, self.content, self.start, self.windows, self.anchor = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        self.id = K.mix(self.key + K.mix(self.content))


def column_order(flat: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, group: np.ndarray, many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece which of its windows are repeated. Pieces of a group are aligned at their anchors; ``many``: the piece occurs more than once."""
    windows = size - length + 1
    repeated = np.zeros(int(windows.sum()), bool)
    base = np.cumsum(windows) - windows
    lowest, highest = -anchor, size - anchor  # columns from, to
    at = start + anchor  # place of column 0
    by_end = np.argsort(-highest, kind="stable")
    ends = -highest[by_end]
    with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as file:

        def write(order: np.ndarray, common: np.ndarray) -> None:
            file.seek(0)
            file.write(order.astype(np.int64).tobytes())
            file.write(common.astype(np.int64).tobytes())

        def read(n: int) -> tuple[np.ndarray, np.ndarray]:
            file.seek(0)
            return np.frombuffer(file.read(8 * n), np.int64), np.frombuffer(file.read(8 * n), np.int64)

        n, entered, last_out = 0, 0, np.sort(lowest)[::-1]
        gone = 0
        for column in range(int(highest.max()) - 1, int(lowest.min()) - 1, -1):
            order, common = read(n)
            upto = int(np.searchsorted(ends, -(column + 1), side="right"))
            left = int(np.searchsorted(-last_out, -column, side="left"))  # pieces that start behind this column
            if left > gone:
                gone = left
                stay = np.flatnonzero(lowest[order] <= column)
                if len(stay):
                    common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
                order, common = order[stay], common[: len(stay)]
            if upto > entered:
                fresh = by_end[entered:upto]
                entered = upto
                order = np.concatenate([fresh, order])
                common = np.concatenate([np.zeros(len(fresh), np.int64), common])
                turn = np.argsort(group[order], kind="stable")
                order, common = order[turn], common[turn]
            n = len(order)
            if not n:
                continue
            symbol = group[order] * 256 + flat[at[order] + column]  # this round's column of the transform
            if (symbol[1:] >= symbol[:-1]).all():
                following = np.zeros(n, np.int64)
                following[1:] = np.where(symbol[1:] == symbol[:-1], common[1:] + 1, 0)
            else:
                turn = np.argsort(symbol, kind="stable")
                order, symbol = order[turn], symbol[turn]
                following = np.zeros(n, np.int64)
                same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
                if len(same):
                    bounds = np.empty(2 * len(same), np.int64)
                    bounds[0::2] = turn[same - 1] + 1
                    bounds[1::2] = turn[same] + 1
                    padded = np.append(common, 0)
                    following[same] = np.minimum.reduceat(padded, bounds)[0::2] + 1
            common = following
            here = np.flatnonzero(column <= size[order] - length - anchor[order])
            if len(here):
                long = np.append(common >= length, False)
                hit = here[long[here] | long[here + 1] | many[order[here]]]
                own = order[hit]
                repeated[base[own] + column + anchor[own]] = True
            write(order, common)
    return np.split(repeated, base[1:])


def _count_keys(nbuckets: int, length: int, gram: int):
    def make(number, chunk):
        data, offsets = K.text_bytes(chunk.column("text"))
        key, count = np.unique(Pieces(data, offsets, length, gram).key, return_counts=True)
        bucket = (key >> np.uint64(40)) * np.uint64(nbuckets) >> np.uint64(24)
        edges = np.searchsorted(bucket, np.arange(nbuckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield b, 1, number, K.joined(K.pack_sorted(key[part]), K.small(count[part]))

    return make


def _repeated_keys(key, own, most: int = HOT):
    parts = [(src, *K.parted(payload, bytes, int)) for _, src, payload in own]
    keys = [K.unpack_sorted(p[1]) for p in parts]
    every, turn = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, turn, np.concatenate([p[2].astype(np.int64) for p in parts]))
    total = total[turn]
    ends = np.cumsum([len(k) for k in keys])
    for (src, _, _), k, end in zip(parts, keys, ends.tolist()):
        own_total = total[end - len(k) : end]
        if (own_total >= 2).any():
            yield src, 1, key, K.joined(K.pack_sorted(k[own_total >= 2]), K.pack_sorted(k[own_total >= most]))


def _keys(own) -> tuple[np.ndarray, np.ndarray]:
    parts = [K.parted(payload, bytes, bytes) for kind, _, payload in own if kind == 1]
    none = [np.zeros(0, np.uint64)]
    return tuple(np.sort(np.concatenate(none + [K.unpack_sorted(p[k]) for p in parts])) for k in (0, 1))


def within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _send_pieces(nbuckets: int, length: int, gram: int):
    def make(number, own):
        keys, hot = _keys(own)
        if not len(keys):
            return
        if len(hot):
            yield -1 - number, 2, number, K.pack_sorted(hot)
        data, offsets = K.text_bytes(text_of(own[0][2]).column("text"))
        plain = Pieces(data, offsets, length, gram)
        kept = within(plain.key, keys)
        if len(hot):
            deeper = Pieces(data, offsets, length, gram, hot)
            # a piece of the divided runs belongs where the run that holds it does
            run = np.searchsorted(plain.start, deeper.start, side="right") - 1
            plain, kept = deeper, kept[run]
        key, content, start, size, anchor = (x[kept] for x in (plain.key, plain.content, plain.start, plain.windows + length - 1, plain.anchor))
        _, first, count = np.unique(plain.id[kept], return_index=True, return_counts=True)
        order = np.argsort(key[first], kind="stable")
        first, count = first[order], count[order]
        bucket = (key[first] >> np.uint64(40)) * np.uint64(nbuckets) >> np.uint64(24)
        edges = np.searchsorted(bucket, np.arange(nbuckets + 1))
        pack = zstandard.ZstdCompressor(3)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = first[edges[b] : edges[b + 1]]
            raw = b"".join(data[s : s + z].tobytes() for s, z in zip(start[at].tolist(), size[at].tolist()))
            yield b, 1, number, K.joined(K.pack_sorted(key[at]), content[at], K.small(count[edges[b] : edges[b + 1]]), K.small(size[at]), K.small(anchor[at]), pack.compress(raw))

    return make


def _build(length: int):
    """The transform of a bucket's pieces; back to each chunk go its pieces that hold repeated windows."""

    def make(key, own):
        if key < 0:
            yield from ((-1 - key, kind, src, payload) for kind, src, payload in own)
            return
        unpack = zstandard.ZstdDecompressor()
        parts = [(src, *K.parted(payload, bytes, int, int, int, int, bytes)) for _, src, payload in own]
        keys = np.concatenate([K.unpack_sorted(p[1]) for p in parts])
        content, count, size, anchor = (np.concatenate([p[k].astype(np.uint64 if k == 2 else np.int64) for p in parts]) for k in (2, 3, 4, 5))
        ids = K.mix(keys + K.mix(content))
        order = np.lexsort((content, keys))  # a piece is known by key and content together, 128 bits
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (content[order][1:] != content[order][:-1])])
        first, turn = order[new], np.empty(len(order), np.int64)
        turn[order] = np.cumsum(new) - 1
        total = np.bincount(turn, weights=count).astype(np.int64)
        group_of, group = np.unique(keys[first], return_inverse=True)
        alone = (np.bincount(group)[group] == 1) & (total == 1)
        place = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(unpack.decompress(p[6]) for p in parts), np.uint8)
        live = np.flatnonzero(~alone)
        if not len(live):
            return
        at = first[live]
        found = column_order(flat, place[at], size[at], anchor[at], group[live], total[live] > 1, length)
        spans = []  # per piece: number of runs of repeated windows, their starts and ends
        for x in found:
            step = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8)))
            spans.append(step)
        full = np.array([len(x) > 0 for x in spans])
        slot = np.full(len(first), -1)
        slot[live[full]] = np.flatnonzero(full)
        ends = np.cumsum([len(K.unpack_sorted(p[1])) for p in parts])
        start = 0
        for p, end in zip(parts, ends.tolist()):
            mine = np.arange(start, end)[slot[turn[start:end]] >= 0]
            start = end
            if len(mine):
                mine = mine[np.argsort(ids[mine])]
                own_spans = [spans[s] for s in slot[turn[mine]].tolist()]
                yield p[0], 1, key, K.joined(K.pack_sorted(ids[mine]), K.small(np.array([len(x) for x in own_spans])), K.small(np.concatenate(own_spans)))

    return make


def covered(start: np.ndarray, end: np.ndarray, total: int, offsets: np.ndarray) -> np.ndarray:
    """Starts and ends of the longest runs that the ranges cover, cut at the ends of documents."""
    depth = np.zeros(total + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    inside = np.zeros(total + 2, bool)
    inside[1:-1] = np.cumsum(depth[:-1], out=depth[:-1]) > 0
    del depth
    step = inside[1:] != inside[:-1]
    first, last = step & inside[1:], step & inside[:-1]
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < total)]
    cut = cut[inside[cut] & inside[cut + 1]]
    first[cut] = last[cut] = True
    return np.stack([np.flatnonzero(first), np.flatnonzero(last)], axis=1)


def whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans widened to the ends of the UTF-8 characters that they cut; what then touches is one."""
    lead = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
    first = lead[np.maximum(np.searchsorted(lead, spans[:, 0], side="right") - 1, 0)]
    return np.stack([first, lead[np.searchsorted(lead, spans[:, 1])]], axis=1)


def _cut(length: int, gram: int, shape: pa.Schema, keep: list[str], least_words: int, characters: bool):
    def make(number, own):
        chunk = text_of(own[0][2])
        hot = [K.unpack_sorted(payload) for kind, _, payload in own if kind == 2]
        replies = [K.parted(payload, bytes, int, int) for kind, _, payload in own if kind == 1]
        data, offsets = K.text_bytes(chunk.column("text"))
        spans = np.zeros((0, 2), np.int64)
        if replies:
            ids = np.concatenate([K.unpack_sorted(p[0]) for p in replies])
            count, flat = (np.concatenate([p[k].astype(np.int64) for p in replies]) for k in (1, 2))
            first = np.cumsum(count) - count
            order = np.argsort(ids)
            ids, count, first = ids[order], count[order], first[order]
            pieces = Pieces(data, offsets, length, gram, np.concatenate(hot) if hot else None)
            at = np.flatnonzero(within(pieces.id, ids))
            if len(np.unique(pieces.id[at])) != len(np.unique(ids)):
                raise RuntimeError(f"chunk {number}: {len(np.unique(ids))} pieces answered, {len(np.unique(pieces.id[at]))} of them are here")
            slot = np.searchsorted(ids, pieces.id[at])
            n = count[slot] // 2
            owner = np.repeat(np.arange(len(at)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lo, hi = flat[first[slot][owner] + 2 * nth], flat[first[slot][owner] + 2 * nth + 1]
            where = pieces.start[at][owner]
            spans = covered(where + lo, where + hi + length - 1, len(data), offsets)
            if characters:
                spans = whole_characters(data, spans)
                spans = covered(*spans.T, len(data), offsets)
            if least_words:
                first_byte, last_byte, _ = K.word_spans(data, offsets, K.NOT_SPACE)
                spans = spans[np.searchsorted(last_byte, spans[:, 1], side="right") - np.searchsorted(first_byte, spans[:, 0]) >= least_words]
        doc = np.searchsorted(offsets, spans[:, 0], side="right") - 1
        edges = np.searchsorted(doc, np.arange(chunk.num_rows + 1))
        removed = np.bincount(doc, weights=spans[:, 1] - spans[:, 0], minlength=chunk.num_rows).astype(np.int64)
        kept, lists = [], []
        raw = data.tobytes()
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            runs = spans[edges[k] : edges[k + 1]].tolist()
            lists.append([{"start": a - lo, "end": b - lo} for a, b in runs])
            kept.append(b"".join(raw[a:b] for a, b in zip([lo, *(b for _, b in runs)], [*(a for a, _ in runs), hi])) if runs else raw[lo:hi])
        columns = [chunk.column(c) for c in keep] + [pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed), pa.array(lists, shape.field("spans").type)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    return make


def suffix_dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM, hot: int = HOT, least_words: int = 0, characters: bool = False) -> DataFrame:
    """The columns ``keep``, kept (the bytes that remain), n_bytes, n_removed, spans (start and end of each removed run, in bytes).

    A byte goes if a string of ``length`` bytes over it starts anywhere else too, in this text or another; all is judged on
    the input. A null text is empty; texts shorter than ``length`` stay whole. Rows that are alike count as many times
    as they stand there. Results replace columns of ``keep`` with the same names.
    ``least_words``: runs with fewer whole words (between white space) stay. ``characters``: a run that ends within a character takes all of it.
    """
    keep = tuple(c for c in keep if c not in ("kept", "n_bytes", "n_removed", "spans"))
    carried = [c for c in keep if c != "text"]
    source = scanned(docs.select(*carried, text(docs)), *carried, "text")
    texts = source.mapInArrow(_text_rows, BLOCK)
    n, nbuckets = partitions(source), buckets(source)
    counted = by_key(by_chunk(source, _count_keys(nbuckets, length, gram)), partial(_repeated_keys, most=hot), n=n)
    sent = by_key(texts.union(counted), _send_pieces(nbuckets, length, gram), n=n)
    found = by_key(sent, _build(length), n=n)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [source.schema[c] for c in keep] + [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)]
    schema = T.StructType(fields)
    shape = to_arrow_schema(schema)
    return by_key(texts.union(found), _cut(length, gram, shape, list(keep), least_words, characters), schema, shape, n)


def _text_rows(batches):
    yield from batched(row for number, chunk in chunks(batches) for row in text_blocks(number, chunk))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

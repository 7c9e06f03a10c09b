"""Near copies by exact n-gram Jaccard similarity, with T-occurrence search over inverted lists.

1. Each document's set of shingle hashes is dealt out by hash in packed blocks; every bucket counts in how many
   documents a shingle occurs and returns the shared ones. A document needs ``threshold`` of its shingles shared.
2. Sets that are equal are one class. Shared shingles in order of rarity give each class a prefix; two classes
   that are similar enough have a shingle of their prefixes in common (prefix filtering), so components of
   that relation hold all links.
3. Within a component, DivideSkip: for each class as a query, the short lists of its shingles are merged and
   what occurs often enough there is looked up in the long lists by binary search. Overlaps are exact.
   A component of more than GROUP_SHINGLES is cut into shards, each pair of which is a task; shards grow with the root of the component.
Links that add nothing to a component already connected are not looked up, so thousands of near copies make no
square of pairs, and none is lost.
"""

from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K
from roadweave.llm.shared import batched, buckets, by_chunk, by_key, partitions, scanned, text, written
from roadweave.operators.components import connected_components

SHINGLE, PERCENT = 5, 80
#: Shingles of a component that one task takes; larger components are searched shard by shard, shards of SHARD_SHINGLES at most.
GROUP_SHINGLES, SHARD_SHINGLES = 1 << 12, 1 << 22
#: A chunk sends no more than so many documents with the same shingle by name; beyond, only their number.
HOT = 32
#: Bytes of documents whose shingles are made at once.
RUN_BYTES = 1 << 18

ROW = "doc_id long, n_shingles long, class binary, shared binary"
ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("shared", pa.binary())])


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending; offsets; a second hash of each, from other word hashes.

    Fewer words than n make one shingle; no words, none.
    """
    data, offsets = K.text_bytes(column)
    found, first = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        found.append(_sets_of_run(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], n))
        first = last
    grams, sizes, other = (np.concatenate(x) for x in zip(*found))
    return grams, np.concatenate([[0], np.cumsum(sizes)]), other


def _sets_of_run(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with the size of each set in place of offsets."""
    hashes, doc, _ = K.words(data, offsets, K.NOT_SPACE)
    second = K.words(data, offsets, K.NOT_SPACE, salt=K.MIX[1])[0]
    grams, whole = K.ngrams(hashes, doc, n)
    docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=docs)
    short = np.flatnonzero((counts > 0) & (counts < n))
    first = np.cumsum(counts) - counts
    own, other = [grams[whole]], [K.ngrams(second, doc, n)[0][whole]]
    if len(short):
        length = counts[short]
        weight = np.concatenate([np.array(K.NGRAM, np.uint64)[:k] for k in length])
        at = np.repeat(first[short], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        for sums, words in ((own, hashes), (other, second)):
            sums.append(K.mix(np.add.reduceat(words[at] * weight, np.cumsum(length) - length) + length.astype(np.uint64)))
    grams, other, owner = np.concatenate(own), np.concatenate(other), np.concatenate([doc[: len(whole)][whole], short])
    order = np.lexsort((grams, owner))
    grams, other, owner = grams[order], other[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=docs), other[new]


def class_ids(grams: np.ndarray, offsets: np.ndarray, second: np.ndarray) -> list[bytes | None]:
    """128 bits that equal sets share, from two hashes that do not depend on each other; none for an empty set."""
    full = np.diff(offsets) > 0
    out: list[bytes | None] = [None] * len(full)
    if full.any():
        at = offsets[:-1][full]
        two = np.stack([np.add.reduceat(K.mix(x ^ np.uint64(salt)), at) for x, salt in zip((grams, second), K.MIX)], axis=1)
        for k, pair in zip(np.flatnonzero(full).tolist(), two):
            out[k] = pair.tobytes()
    return out


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any set that is similar enough."""
    return -(-n * percent // 100)


def _shingle_blocks(nbuckets: int, n: int):
    def make(number, chunk):
        grams, offsets, second = shingle_sets(chunk.column("text"), n)
        classes = class_ids(grams, offsets, second)
        del second
        sizes = np.diff(offsets)
        ids = chunk.column("doc_id")
        # one document of each class in the chunk speaks for it
        seen: dict[bytes | None, int] = {None: -1}
        speaks = np.array([c not in seen and seen.setdefault(c, k) == k for k, c in enumerate(classes)], bool)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        kept = speaks[owner]
        grams, owner = grams[kept], owner[kept]
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        del kept, order
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        count = np.diff(first, append=len(grams))
        hot = count > HOT
        hot_rows = np.repeat(hot, count)
        sink = pa.BufferOutputStream()
        table = pa.record_batch([ids, pa.array(sizes), pa.array(classes, pa.binary())], ["doc_id", "n", "class"])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
            out.write_batch(table)
        yield -1 - number, 0, number, K.joined(sink.getvalue().to_pybytes(), grams[hot_rows], K.small(owner[hot_rows]))
        unique = grams[first]
        names = owner[~hot_rows]
        del grams, owner, first, hot_rows
        sent = np.minimum(count, np.where(hot, 0, count))  # names of documents that follow
        bucket = (unique >> np.uint64(40)) * np.uint64(nbuckets) >> np.uint64(24)
        ends = np.cumsum(sent)
        edges = np.searchsorted(bucket, np.arange(nbuckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            lo, hi = ends[part][0] - sent[part][0], ends[part][-1]
            yield b, 1, number, K.joined(K.pack_sorted(unique[part]), K.small(count[part]), K.small(names[lo:hi]))

    return make


def _share_counts(key, own):
    """Of a bucket, for each chunk its shingles that at least two documents have, with their number. Chunks' own blocks pass."""
    if key < 0:
        yield from ((-1 - key, kind, src, payload) for kind, src, payload in own)
        return
    parts = [(src, *K.parted(payload, bytes, int, int)) for _, src, payload in own]
    parts = [(src, K.unpack_sorted(g), c, names) for src, g, c, names in parts]
    grams = np.concatenate([p[1] for p in parts])
    count = np.concatenate([p[2].astype(np.int64) for p in parts])
    which = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.repeat(np.add.reduceat(count[order], first), np.diff(first, append=len(ordered)))
    back = np.empty(len(order), np.int64)
    back[order] = total
    ends = np.cumsum(np.bincount(which, minlength=len(parts)))
    for k, (src, own_grams, c, names) in enumerate(parts):
        df = back[ends[k] - len(own_grams) : ends[k]]
        shared = df >= 2
        if shared.any():
            sent = np.where(c > HOT, 0, c).astype(np.int64)
            rows = names[np.repeat(shared, sent)]
            yield src, 1, key, K.joined(K.pack_sorted(own_grams[shared]), K.small(c[shared].astype(np.int64)), K.small(df[shared]), K.small(rows.astype(np.int64)))


def _survivors(percent: int):
    """For each chunk its documents, with the shared shingles in order of rarity where there are enough of them."""

    def make(key, own):
        table = own[0][2]
        head, hot_grams, hot_owner = K.parted(table, bytes, int, int)
        table = pa.ipc.open_stream(head).read_next_batch()
        grams, owner, df = [], [], []
        for kind, _, payload in own[1:]:
            packed, count, total, names = K.parted(payload, bytes, int, int, int)
            g = K.unpack_sorted(packed)
            sent = np.where(count > HOT, 0, count).astype(np.int64)
            grams.append(np.repeat(g, sent))
            df.append(np.repeat(total, sent).astype(np.int64))
            owner.append(names.astype(np.int64))
            many = count > HOT
            if many.any():
                lo, hi = np.searchsorted(hot_grams, g[many]), np.searchsorted(hot_grams, g[many], side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                grams.append(hot_grams[at])
                owner.append(hot_owner[at].astype(np.int64))
                df.append(np.repeat(total[many], hi - lo).astype(np.int64))
        n = np.asarray(table.column("n"))
        shared: list[bytes | None] = [None] * len(n)
        if grams:
            grams, owner, df = map(np.concatenate, (grams, owner, df))
            enough = np.bincount(owner, minlength=len(n)) >= np.maximum(1, need(n, percent))
            kept = enough[owner]
            grams, owner, df = grams[kept], owner[kept], df[kept]
            order = np.lexsort((grams, df, owner))
            grams, owner = grams[order], owner[order]
            ends = np.searchsorted(owner, np.arange(len(n) + 1))
            for k in np.flatnonzero(enough).tolist():
                shared[k] = grams[ends[k] : ends[k + 1]].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([table.column("doc_id"), table.column("n").cast(pa.int64()), table.column("class"), pa.array(shared, pa.binary())], schema=ROW_ARROW)

    return make


def _prefix_blocks(nbuckets: int, percent: int):
    """(shingle, class, size) of every prefix, in blocks by shingle."""

    def run(batches):
        def rows():
            for number, batch in enumerate(batches):
                grams, which = [], []
                n = np.asarray(batch.column("n_shingles"))
                ids = batch.column("class").to_pylist()
                for k, raw in enumerate(batch.column("shared").to_pylist()):
                    own = np.frombuffer(raw, "<u8")
                    length = int(n[k]) - int(need(n[k], percent)) + 1 - (int(n[k]) - len(own))
                    grams.append(own[: max(0, length)])
                    which.append(np.full(len(grams[-1]), k))
                if not grams:
                    continue
                grams, which = np.concatenate(grams), np.concatenate(which)
                order = np.argsort(grams, kind="stable")
                grams, which = grams[order], which[order]
                bucket = (grams >> np.uint64(40)) * np.uint64(nbuckets) >> np.uint64(24)
                edges = np.searchsorted(bucket, np.arange(nbuckets + 1))
                table = np.frombuffer(b"".join(ids), "V16")
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    part = slice(edges[b], edges[b + 1])
                    own, local = np.unique(which[part], return_inverse=True)
                    yield b, 0, number, K.joined(K.pack_sorted(grams[part]), K.small(local), table[own].tobytes(), K.small(n[own]))

        yield from batched(rows())

    return run


EDGE, EDGE_ARROW = "u binary, v binary", pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _candidates(percent: int):
    """Links classes with a shingle in common to the next in size, where sizes allow it; the components stay as all pairs would make them."""

    def make(key, own):
        grams, ids, sizes = [], [], []
        for _, _, payload in own:
            g, local, table, n = K.parted(payload, bytes, int, bytes, int)
            grams.append(K.unpack_sorted(g))
            ids.append(np.frombuffer(table, "V16")[local])
            sizes.append(n[local].astype(np.int64))
        grams, ids, sizes = map(np.concatenate, (grams, ids, sizes))
        pairs = ids.view("<u8").reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0], sizes, grams))
        grams, ids, sizes, pairs = grams[order], ids[order], sizes[order], pairs[order]
        link = (grams[1:] == grams[:-1]) & (pairs[1:] != pairs[:-1]).any(axis=1) & (sizes[1:] * percent <= sizes[:-1] * 100)
        u, v = ids[:-1][link], ids[1:][link]
        if len(u):
            both = np.unique(np.concatenate([u.view("<u8").reshape(-1, 2), v.view("<u8").reshape(-1, 2)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in both[:, :2]], pa.binary()), pa.array([x.tobytes() for x in both[:, 2:]], pa.binary())], schema=EDGE_ARROW)

    return make


class Lists:
    """Inverted lists of sets' shingles, as arrays: of each shingle the members that have it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        member = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.member = flat[order], member[order]
        self.first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.grams, self.ends = flat[self.first], np.append(self.first[1:], len(flat))

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a set's shingles, shortest first."""
        at = np.searchsorted(self.grams, query)
        lo, hi = self.first[at], self.ends[at]
        return [self.member[lo[k] : hi[k]] for k in np.argsort(hi - lo, kind="stable").tolist()]


def heap_merge(lists: list[list[int]], t: int) -> tuple[list[int], list[int]]:
    """Members of at least t of the ascending lists, and in how many each is (MergeSkip).

    The least member is popped with all its copies; where they are fewer than t, the t - 1 least lists skip to the member that the heap has then,
    since nothing before it can be in t lists.
    """
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    at = [0] * len(lists)
    found, count = [], []
    while len(heap) >= t:
        member, own = heap[0][0], []
        while heap and heap[0][0] == member:
            own.append(heappop(heap)[1])
        if len(own) >= t:
            found.append(member)
            count.append(len(own))
            target = member + 1
        else:
            while heap and len(own) < t - 1:
                own.append(heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in own:
            at[k] = bisect_left(lists[k], max(target, member + 1) if lists[k][at[k]] == member else target, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))
    return found, count


def t_occurrence(query: np.ndarray, lists: Lists, t: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least t of the query's lists, and in how many they are (DivideSkip). ``skip``: members that don't matter.

    The longest lists, fewer than t, are only probed: a member of t lists is in t less their number of the others at least.
    """
    own = lists.of(query)
    if len(own) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = len(own[-1])
    n_long = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)))
    short, long = own[: len(own) - n_long], own[len(own) - n_long :]
    size = np.array([len(x) for x in short])
    merged = np.concatenate(short)
    left = np.flatnonzero(~skip[merged])
    cuts = np.searchsorted(left, np.cumsum(size)).tolist()
    merged = merged[left].tolist()
    found, count = map(np.array, heap_merge([merged[a:b] for a, b in zip([0, *cuts], cuts)], t - n_long))
    for left, own_list in zip(range(len(long) - 1, -1, -1), reversed(long)):
        if not len(found):
            break
        at = np.minimum(np.searchsorted(own_list, found), len(own_list) - 1)
        count = count + (own_list[at] == found)
        kept = count + left >= t
        found, count = found[kept], count[kept]
    return found.astype(np.int64), count.astype(np.int64)


def link_forest(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: pairs with 100 * overlap >= percent * union. ``sizes`` counts shingles nobody shares too."""
    order = np.argsort(sizes, kind="stable")
    lists = Lists([sets[k] for k in order])
    ordered, links = sizes[order], []
    root = np.arange(len(order))
    for k in range(len(order)):
        n = int(ordered[k])
        if n * (100 - percent) < percent:
            continue  # so few shingles are similar enough to equal sets only, and those are one class
        skip = root == root[k]
        skip |= ordered * (100 - percent) < percent
        skip |= (ordered * 100 < n * percent) | (ordered * percent > n * 100)
        if skip.all():
            continue
        found, overlap = t_occurrence(sets[order[k]], lists, max(1, int(need(np.int64(n), percent))), skip)
        for other in found[100 * overlap >= percent * (n + ordered[found] - overlap)].tolist():
            a, b = sorted((int(root[k]), int(root[other])))
            if a != b:
                root[root == b] = a
                links.append((int(order[k]), int(order[other])))
    return links


def _search(percent: int):
    """The links within a component, or between two shards of a large one. A forest spans what they connect."""

    def make(key, own):
        by_class = {payload[:16]: payload for _, _, payload in own}  # rows may repeat
        ids = sorted(by_class)
        raw = [by_class[x] for x in ids]
        sizes = np.array([int(x[16:32]) for x in raw], np.int64)
        links = link_forest([np.frombuffer(x, "<u8", offset=32) for x in raw], sizes, percent)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in links], pa.binary()), pa.array([ids[b] for _, b in links], pa.binary())], schema=EDGE_ARROW)

    return make


def ngram_join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets; null without words), component_id (smallest doc_id reachable by links).

    Words: longest runs without white space, A-Z as a-z. Null and empty texts have no set and no link. Rows that share
    a doc_id each count; a null doc_id is never the smallest unless its component has no other. Other columns are left out.
    """
    source = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)), "doc_id", "text")
    parts, nbuckets = partitions(source), buckets(source)
    counted = by_key(by_chunk(source, _shingle_blocks(nbuckets, n)), _share_counts, n=parts)
    rows = written(by_key(counted, _survivors(percent), ROW, ROW_ARROW, parts), "sets")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"))
    alive = rows.where("shared is not null")
    prefixes = alive.select("n_shingles", "class", "shared").mapInArrow(_prefix_blocks(nbuckets, percent), "key long, kind int, src long, payload binary")
    near = connected_components(by_key(prefixes, _candidates(percent), EDGE, EDGE_ARROW, parts))
    members = near.join(alive.groupBy("class").agg(F.min("doc_id").alias("doc_id")).withColumnRenamed("class", "node"), "node")
    members = members.join(alive, (F.col("node") == F.col("class")) & alive["doc_id"].eqNullSafe(members["doc_id"])).select("component", "class", "n_shingles", "shared")
    shingles = F.sum(F.octet_length("shared")) / 8
    shards = F.ceil(F.greatest(F.sqrt(shingles / GROUP_SHINGLES), shingles / SHARD_SHINGLES)).cast("int")
    size = members.groupBy("component").agg(shards.alias("shards"))
    dealt = members.join(size, "component").withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    low, high = F.least("shard", "other"), F.greatest("shard", "other")
    dealt = dealt.where((F.col("shards") == 1) | (F.col("shard") != F.col("other")))
    dealt = dealt.select(F.xxhash64("component", low, high).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("src"), F.concat("class", F.encode(F.lpad(F.col("n_shingles").cast("string"), 16, "0"), "utf-8"), "shared").alias("payload"))
    links = connected_components(by_key(dealt, _search(percent), EDGE, EDGE_ARROW, parts))
    labelled = classes.join(links, classes["class"] == links["node"], "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "component").select("class", "component_id")
    return rows.select("doc_id", "n_shingles", "class").join(ids, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_counts(texts: list[str], n: int = SHINGLE) -> Counter:
    """For small inputs and tests: how many of the texts hold each shingle hash."""
    grams, _, _ = shingle_sets(pa.array(texts, pa.string()), n)
    return Counter(grams.tolist())

"""Token ids in files that give any id without decoding a block: directly addressable codes (Brisaboa, Ladra, Navarro).

An id is cut into chunks of WIDTHS bits, lowest first. Level k holds the k-th chunk of the ids that have one, and a bitmap of
those that go on in level k + 1; how many do before a place comes from counts every RANK bits and the few bits after.

Under a path, ``shards`` holds the files, raw bytes as below, and ``index`` (Parquet) says of each document in which file it lies and where.
One id takes an index row and a few ranges of bytes of one file; nothing is inflated. A file is
``magic, length of the shape, shape, documents' ids, whether they have one, and starts, then per level chunks, bitmap, counts``, and a line end.
"""

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.shared import ends_with_session, shared_dir, text, trim
from roadweave.llm.token_ids import by_run, token_ids

MAGIC = b"RWDAC002"
WIDTHS = (8, 8, 16)
RANK = 512
#: Ids in a shard, so that a file has some 5 MB; a longer document is a shard of its own.
SHARD_IDS = 1 << 21
END_ID = 0

INDEX = "doc_id long, file string, part int, first long, place long, n_tokens long, ids_crc32 long"
INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("part", pa.int32()), *((x, pa.int64()) for x in ("first", "place", "n_tokens", "ids_crc32"))])


def encode(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, widths: tuple[int, ...] = WIDTHS, part: int = 0, first: int = 0) -> bytes:
    """The bytes of a shard. ``known``: whether the document has an id; ``starts``: its place in the shard; ``first``: ids of its part before it."""
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError(f"ids of more than {sum(widths)} bits")
    levels, rest = [], ids.astype(np.uint32)
    for width in widths:
        more = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        go = more > 0
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
        bits = np.packbits(go, bitorder="little")
        ranks = np.zeros(-(-len(go) // RANK) + 1, np.int64)
        ones = np.bitwise_count(bits)
        ones = np.concatenate([ones, np.zeros(-len(ones) % (RANK // 8), np.uint8)]).reshape(-1, RANK // 8).sum(axis=1, dtype=np.int64)
        np.cumsum(ones, out=ranks[1:])
        levels += [(rest & np.uint32((1 << width) - 1)).astype(kind).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        rest = more[go]
    head = np.array([len(ids), len(doc_ids), part, first, len(widths), *widths, *map(len, levels)], "<u8")
    return b"".join([MAGIC, np.uint64(len(head)).tobytes(), head.tobytes(), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), *levels])


class Shard:
    """A shard, read by ranges of bytes: ``read(from, how many)``, or its bytes."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = (lambda at, size: source[at : at + size]) if isinstance(source, (bytes, memoryview)) else source
        magic = bytes(self.read(0, 16))
        if magic[:8] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n = int.from_bytes(magic[8:], "little")
        head = np.frombuffer(self.read(16, 8 * n), "<u8").astype(np.int64).tolist()
        self.n_ids, self.n_docs, self.part, self.first, depth = head[:5]
        self.widths, sizes = head[5 : 5 + depth], head[5 + depth :]
        self.kinds = [np.dtype(f"<u{1 if w <= 8 else 2 if w <= 16 else 4}") for w in self.widths]
        self.at_docs = 16 + 8 * n
        ends = np.cumsum([self.at_docs + 17 * self.n_docs, *sizes]).tolist()
        self.levels = [ends[3 * k : 3 * k + 3] for k in range(depth)]  # where chunks, bitmap and counts begin

    def _bits(self, level: int, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi of a level's bitmap."""
        return np.frombuffer(self.read(self.levels[level][1] + lo, hi - lo), np.uint8)

    def _chunks(self, level: int, lo: int, hi: int) -> np.ndarray:
        kind = self.kinds[level]
        return np.frombuffer(self.read(self.levels[level][0] + lo * kind.itemsize, (hi - lo) * kind.itemsize), kind)

    def _rank(self, level: int, place: int, bits: np.ndarray) -> int:
        """How many ids before the place go on in the next level; ``bits``: the bitmap from the last count on."""
        block = place // RANK
        count = int.from_bytes(self.read(self.levels[level][2] + 4 * block, 4), "little")
        whole = (place - block * RANK) // 8
        return count + int(np.bitwise_count(bits[:whole]).sum()) + ((int(bits[whole]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else 0)

    def get(self, place: int) -> int:
        """The id at a place: of each of its levels one chunk, at most RANK bits and one count."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = shift = 0
        for k, width in enumerate(self.widths):
            value |= int(self._chunks(k, place, place + 1)[0]) << shift
            bits = self._bits(k, place // RANK * RANK // 8, place // 8 + 1)
            if not bits[-1] >> place % 8 & 1:
                break
            shift += width
            place = self._rank(k, place, bits)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo to hi, as unsigned 32-bit integers."""
        out = np.zeros(hi - lo, "<u4")
        where, shift = slice(None), 0
        for k, width in enumerate(self.widths):
            if hi == lo:
                break
            out[where] |= self._chunks(k, lo, hi).astype(np.uint32) << np.uint32(shift)
            begin = lo // RANK * RANK // 8
            bits = self._bits(k, begin, -(-hi // 8))
            go = np.unpackbits(bits[lo // 8 - begin :], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            if not go.any():
                break
            where = np.flatnonzero(go) if k == 0 else where[go]
            lo = self._rank(k, lo, bits)
            hi, shift = lo + len(where), shift + width
        return out

    def places(self) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Each document's id, and from and to where its ids stand."""
        raw = self.read(self.at_docs, 17 * self.n_docs)
        ids = np.frombuffer(raw, "<i8", self.n_docs).tolist()
        known = np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs).tolist()
        starts = np.frombuffer(raw, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        return [d if k else None for d, k in zip(ids, known)], starts, np.append(starts[1:], self.n_ids)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, start in the shard and ids."""
        docs, starts, ends = self.places()
        ids = self.slice(0, self.n_ids)
        for doc, lo, hi in zip(docs, starts.tolist(), ends.tolist()):
            yield doc, lo, ids[lo:hi]


def _shards(tokenizer: str, widths: tuple[int, ...], shard_ids: int):
    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        tokens = token_ids(tokenizer)
        docs, ids, total = [], [], 0

        def image():
            sizes = np.array([len(x) // 4 for x in ids])
            known = np.array([d is not None for d in docs])
            raw = encode(np.frombuffer(b"".join(ids), "<u4"), np.array([d or 0 for d in docs], np.int64), known, np.cumsum(sizes) - sizes, widths, part, first)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["image"])

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), by_run(tokens, batch.column("text"))):
                own += end
                if docs and total + len(own) // 4 > shard_ids:
                    yield image()
                    first, docs, ids, total = first + total, [], [], 0
                docs.append(doc)
                ids.append(own)
                total += len(own) // 4
        if docs:
            yield image()
            docs, ids = [], []
        trim()

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").where("length > 0")


def _located(batches):
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            shard = Shard(memoryview(content.as_buffer()))
            docs, lo, hi = shard.places()
            n = len(docs)
            sums = [zlib.crc32(ids.tobytes()) for _, _, ids in shard.documents()]
            columns = [docs, pa.repeat(file, n), pa.repeat(shard.part, n), pa.repeat(shard.first, n), lo, hi - lo, sums]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, INDEX_ARROW)], schema=INDEX_ARROW)
    trim()


def write_codes(docs: DataFrame, path: str, tokenizer: str, widths: tuple[int, ...] = WIDTHS, shard_ids: int = SHARD_IDS) -> None:
    """Shards of all documents in ascending doc_id order (null first, equal ones by text), and their index as the files are read back, under ``path``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text(docs)).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    # a writer of lines whose one line a file is the shard's bytes as they are: Spark commits it as it does any table
    images = ordered.mapInArrow(_shards(tokenizer, widths, shard_ids), "image binary").select(F.col("image").cast("string").alias("value"))
    images.write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/shards")
    _files(docs.sparkSession, path).select("path", "content").mapInArrow(_located, INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, part, first (ids of the part before the file), place (in the file), n_tokens, ids_crc32, as the files were read back."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


class Codes:
    """Documents' ids from the files under ``path``, by document and place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.index, self.bytes_read = spark, read_index(spark, path), 0

    def _ranges(self, file: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(file)
        stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)

        def read(at: int, size: int) -> bytes:
            if not size:
                return b""
            stream.seek(at)
            self.bytes_read += size
            return bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))

        return stream, read

    def get(self, doc_id: int, lo: int, hi: int | None = None) -> list:
        """The id at place ``lo`` of the document, or those up to ``hi``, of every row with that doc_id."""
        found = []
        for row in self.index.where(F.col("doc_id") == doc_id).orderBy("part", "first", "place").collect():
            if not 0 <= lo < row["n_tokens"]:
                raise IndexError(lo)
            stream, read = self._ranges(row["file"])
            try:
                shard = Shard(read)
                found.append(shard.get(row["place"] + lo) if hi is None else shard.slice(row["place"] + lo, row["place"] + min(hi, row["n_tokens"])).tolist())
            finally:
                stream.close()
        return found


READ = "doc_id long, start long, n_tokens long, ids binary"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """How many ids the parts before each part have: a number for each partition that wrote."""
    base, total = {}, 0
    for part, n in sorted(map(tuple, read_index(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())):
        base[part], total = total, total + n
    return base


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens with the end id, and ids (little-endian
    unsigned 32-bit), from the files."""
    base = _bases(spark, path)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(memoryview(content.as_buffer()))
                rows = [(doc, base[shard.part] + shard.first + lo, len(ids), ids.tobytes()) for doc, lo, ids in shard.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ_ARROW)], schema=READ_ARROW)

    return _files(spark, path).select("content").mapInArrow(run, READ)


def token_codes(docs: DataFrame, tokenizer: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Writes the codes of all documents to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone; rows that share a doc_id follow each other by text. Other columns are left out. The files go
    when the application ends.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(docs, path, tokenizer, widths)
    ends_with_session(spark, path)
    base = spark.createDataFrame(list(_bases(spark, path).items()), "part int, base long")
    return read_index(spark, path).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

"""The shared folder, chunks of documents, and blocks of rows that are dealt out by a key."""

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K

#: A block: what it is for (``key``: a bucket or a chunk), its kind, the chunk it comes from, and its bytes.
BLOCK = "key long, kind int, src long, payload binary"
BLOCK_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), ("payload", pa.binary())])
#: Bytes of text in a chunk, and rows; a longer document is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 6 << 20, 1 << 15
#: Buckets for each shuffle partition, so that tasks get about as much as each other, and bytes of files that a bucket and a partition stand for at most.
SPREAD, BUCKET_BYTES, PARTITION_BYTES = 8, 4 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where none is set and all runs on this machine, as in tests, a folder of its own takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadweave-"))
        at = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def ends_with_session(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that what follows neither computes them anew nor depends on an executor.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    ends_with_session(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def partitions(source: DataFrame) -> int:
    """Shuffle partitions for what comes of a scan: as many as are set, more if the files are too large for them."""
    leaf = source._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(str(leaf.stats().sizeInBytes())) // PARTITION_BYTES))


def buckets(source: DataFrame) -> int:
    """Parts that a table of hashes is cut in. No result depends on their number."""
    leaf = source._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
    return max(SPREAD * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(str(leaf.stats().sizeInBytes())) // BUCKET_BYTES))


def scanned(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns from files, so that two scans deal the same rows to the same tasks; anything but a scan is written first."""
    docs = docs.select(*columns)
    nodes = [x.strip(" +-:").split(" ")[0] for x in docs._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return docs if all(x in ("Project", "Relation") for x in nodes if x) else written(docs, "scan")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with at most ``most`` bytes of text, each with a number of its own.

    Where a run ends follows from the rows alone, not from the batches Spark makes of them (it ends those by the rows and bytes of all columns).
    """
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    rows = total = 0

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        first = 0
        for row, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if rows and (total + size > most or rows == CHUNK_ROWS):
                if row > first:
                    held.append(batch.slice(first, row - first))
                yield number, whole()
                number, held, first, rows, total = number + 1, [], row, 0, 0
            rows, total = rows + 1, total + size
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield number, whole()


def blocks(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK_ARROW)], schema=BLOCK_ARROW)


def batched(rows: Iterator[tuple[int, int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Blocks in record batches of about that many bytes."""
    ready, size = [], 0
    for row in rows:
        ready.append(row)
        size += len(row[3]) + 32
        if size >= most:
            yield blocks(ready)
            ready, size = [], 0
    if ready:
        yield blocks(ready)


#: What else a worker remembers between tasks of one operator; another operator's tasks drop it.
HELD: list[Callable[[], None]] = [K._powers.clear]


def give_back() -> None:
    """Returns freed memory to the machine: a worker that waits for its next task holds none of the last one's."""
    for forget in HELD:
        forget()
    trim()


def trim() -> None:
    """Returns freed memory to the machine and keeps what is remembered."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def by_chunk(docs: DataFrame, make: Callable[[int, pa.RecordBatch], Iterator[tuple[int, int, int, bytes]]], most: int = CHUNK_BYTES) -> DataFrame:
    """The blocks that ``make`` gives for every chunk."""

    def run(batches):
        give_back()
        yield from batched(row for number, chunk in chunks(batches, most=most) for row in make(number, chunk))
        give_back()

    return docs.mapInArrow(run, BLOCK)


def by_key(dealt: DataFrame, make: Callable, schema: str = BLOCK, shape: pa.Schema = BLOCK_ARROW, n: int | None = None) -> DataFrame:
    """``make(key, [(kind, src, payload)])`` for all blocks of each key, one key at a time; it gives blocks, or record batches if ``schema`` is another.

    ``n``: partitions, by default those that are set.
    """

    def groups(batches):
        key, own = None, []
        for batch in batches:
            for k, kind, src, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key and own:
                    yield key, own
                    own = []
                key = k
                own.append((kind, src, payload))
        if own:
            yield key, own

    def run(batches):
        give_back()
        if schema == BLOCK:
            yield from batched(row for key, own in groups(batches) for row in make(key, own))
        else:
            for key, own in groups(batches):
                yield from make(key, own)
        give_back()

    n = n or int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "kind", "src").mapInArrow(run, schema)


def text_blocks(number: int, chunk: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """The chunk itself, for the tasks that gather what was found out about it. Kind 0: it comes before all replies."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(chunk)
    yield number, 0, number, sink.getvalue().to_pybytes()


def text_of(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def text(df: DataFrame, column: str = "text"):
    """The column as text, null where it is null."""
    return F.col(column).cast("string").alias(column)

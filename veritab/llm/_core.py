"""What several text operators share: staged tables, Arrow batches, and word and window hashes in NumPy.

Words are the runs of bytes other than space and the five control characters 0x09 to 0x0D. These separators
are single bytes that never occur inside a multi-byte UTF-8 character, so words can be found in the raw
Arrow buffer of a whole batch at once, without creating Python strings.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed in one go; a longer document is still hashed whole.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch, and rows that are read from Parquet at once.
BATCH_BYTES, READ_ROWS = 1 << 21, 1024
#: Bytes of input that one task reads at least, and rows of a staged file, where there are many.
PACKED_BYTES, FILE_ROWS = 1 << 24, 1 << 18
#: Rows that name documents and are broadcast at most; of an id and a hash each, some 120 MB.
BROADCAST_DOCS = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one in local
    mode, and an error on a cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veritab-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def parallel(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def packed(texts: DataFrame) -> DataFrame:
    """A scan of many small partitions in fewer tasks: of PACKED_BYTES each, but two for each core at least.

    Anything that has to shuffle first is left as it is: its partitions are not known before it runs.
    """
    plan = texts._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return texts
    most = max(parallel(texts.sparkSession), -(-int(str(plan.optimizedPlan().stats().sizeInBytes())) // PACKED_BYTES))
    return texts.coalesce(most) if texts.rdd.getNumPartitions() > most else texts


def staged(frame: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The same rows, read from a table just written to the shared folder: the lineage ends here.

    A lost executor costs no recomputation of what lies behind, and a join of the result deals both sides
    anew, so adaptive execution can split its skewed partitions. Partitions have the advisory size, so that a small
    table is a few files: on local file systems each file costs a process that Hadoop starts from the executor.

    rows: about how many there can be, if that is known; then no more files than one for FILE_ROWS of them, or two for
    each core, even where shuffles are dealt to many partitions.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/veritab-{label}-{uuid.uuid4().hex}"
    if rows is not None:
        frame = frame.coalesce(max(parallel(spark), -(-rows // FILE_ROWS)))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.staged_at = path
    return out


def named(frame: DataFrame) -> DataFrame:
    """A staged table that names documents, broadcast if it has few rows, so that whole texts need no shuffle to meet it."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_DOCS else frame


def released(*frames: DataFrame | None) -> None:
    """Removes staged tables that nothing will read any more."""
    for frame in frames:
        if frame is not None and (path := frame.__dict__.pop("staged_at", None)):
            spark = frame.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: Spark removes shuffle files and broadcasts of finished steps only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of workers and readers by bytes and rows, unless the session's own bounds are lower.

    Python workers get Arrow batches of about BATCH_BYTES, and Parquet is decoded READ_ROWS rows at a time: texts of any
    length are then a few megabytes at once, and small rows still come by the thousand.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(name, most)


def trimmed() -> None:
    """Gives memory that a worker has freed back to the machine: workers are used again, for other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task, or now makes: one thing at a time, whichever operator asks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Forgets what another operator has kept in this worker."""
    if _kept:
        _kept.clear()
        trimmed()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work in a worker that first lets go of what another operator has kept in it, unless this one keeps
    something itself, and in the end gives back what memory it doesn't use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # sent by value: the module's functions know its state
        if not keeps:
            let_go()
        yield from work(batches)
        trimmed()

    return run


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(raw: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``most`` bytes together: first row, row after the last, their bytes and offsets."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z as a-z."""
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SEPARATOR[raw]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = True
    after[edges - 1] = True
    start = np.flatnonzero(~gap & before)
    return start, np.flatnonzero(~gap & after) + 1, np.searchsorted(start, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A value for each byte at each of the first 256 places of a word.
PLACES = 256
_place_values = [mixed(np.arange(PLACES << 8, dtype=np.uint64) + np.uint64(seed)) for seed in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
STEP, JOIN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def span_places(begin: np.ndarray, n: int) -> np.ndarray:
    """For each of n values its place behind the last span that begins at or before it. begin: ascending, not empty."""
    kind = np.int32 if n < 1 << 31 else np.int64
    place = np.arange(n, dtype=kind)
    place[begin[0] :] -= np.repeat(begin.astype(kind), np.diff(np.append(begin, n)))
    return place


def _summed(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mixed(total[end] - total[start] + mixed((end - start).astype(np.uint64) + STEP))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span, none of which overlaps another; ``second``: an independent one.

    The sum of one random value for each (place, byte), mixed with the length. A value depends on the place, so
    no pattern of bytes cancels out as it would in a polynomial modulo 2 ** 64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    place = span_places(start, len(raw))
    values = _place_values[second].take(((place & (PLACES - 1)) << 8) | raw)
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mixed(values[far] + (place[far] >> 8).astype(np.uint64) * STEP)
    return _summed(values, start, end)


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the sequence hashes[start:end] for each span; spans are in order and don't overlap."""
    out = np.full(len(start), np.uint64(seed))
    filled = np.flatnonzero(end > start)
    if len(filled):
        place = span_places(start[filled], len(hashes)).astype(np.uint64)
        out[filled] = _summed(mixed(hashes + place * STEP + np.uint64(seed)), start[filled], end[filled])
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of what a and then b are hashes of."""
    return mixed(a * JOIN + b)


def gram_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive hashes, put together from runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, done, out = mixed(hashes + np.uint64(seed)), 1, 0, None
    while True:
        if size & width:
            part = level[done : done + n]
            out = part if out is None else joined(out, part)
            done += width
        width *= 2
        if width > size:
            return out
        level = joined(level[: -(width // 2)], level[width // 2 :])


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one row, and the index of the word each starts at."""
    lengths = np.diff(first)
    counts = np.maximum(lengths - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return gram_hashes(hashes, size, seed)[at], at


def signed(x: np.ndarray) -> np.ndarray:
    """64 unsigned bits as the long that Spark holds."""
    return np.ascontiguousarray(x).view(np.int64)

"""Shared pieces: table access, shared storage, and vectorised text kernels.

The kernels work on Arrow string buffers: many texts lie in one byte array, and
numpy finds words and hashes them without making Python strings.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel handles at once; working arrays take about 50 times that.
SLICE_BYTES = 512 << 10
#: Rows in an Arrow batch between the JVM and Python, so that a batch stays near 2 MB of text.
BATCH_ROWS = 500
#: Rows in a file of a small table between steps, and how many files one has at least.
FILE_ROWS, LEAST_FILES = 20_000, 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; sets the Arrow batch size the operators are written for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the place that driver and executors share.

    It is below ``spark.checkpoint.dir``. Only in a local session (tests on one machine)
    may that be unset; a temporary folder is then made and kept for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="verbatix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/verbatix/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    ``rows`` tells about how many rows come; a small table then has few files, a large
    one as many as its last shuffle has partitions.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if rows is not None and (files := max(LEAST_FILES, -(-rows // FILE_ROWS))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Give back the driver's memory of earlier steps: what nothing refers to in Python and in the JVM, where broadcasts and shuffles are dropped only after a collection, and what the allocators of both hold free."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str | None:
    """The driver's JVM gives free memory beside its heap back to the system; what it says of that, or None if it has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    lang = jvm.java.lang
    kinds, args = gateway.new_array(lang.Class, 4), gateway.new_array(lang.Object, 4)
    try:
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = gateway.new_array(lang.Object, 0), gateway.new_array(lang.String, 0)
        # By the interface's method: the server's own class is not open to other modules.
        return lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def settle_executors(spark: SparkSession) -> None:
    """Executors give back the heap of earlier steps, which their JVMs otherwise hold up to its limit beside the Python workers; a task for each core reaches them all."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def trim() -> None:
    """Give free memory of this process back to the system; C's allocator keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under this name, made where it is first asked for."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """A task that needs much memory gives back what its worker kept for tasks of other operators, and what these have freed."""
    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def drop_shared(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of materialized tables that are no longer needed."""
    jvm = spark.sparkContext._jvm
    for file in (f for df in tables for f in df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together (or one row of any length)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as long as the longest slice so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                row = np.full(size, np.uint64(base), np.uint64)
                row[0] = 1
                setattr(cls, name, np.multiply.accumulate(row))
        return cls.up[:n], cls.down[:n]


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_LOWER_CODES = _CODES[_ASCII_LOWER]

#: Which bytes part words: white space as in the shingle contract, or everything but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice: 64-bit hashes (A-Z as a-z), first word of each row (n + 1), byte starts and ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:n])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:n], [True]))) + 1
    up, down = _Powers.of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER_CODES[data] * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets), starts, ends


_PLACES = mix(np.arange(101, 133, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; entry i starts at word i."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _PLACES[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct n-word shingles; a row of fewer words has its whole sequence as one, an empty row none."""
    hashes, first, _, _ = words(data, offsets)
    runs = grams(hashes, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out = np.sort(runs[a : b - n + 1])
            keep = np.ones(len(out), bool)
            keep[1:] = out[1:] != out[:-1]
            yield out[keep]
        elif b > a:
            yield grams(hashes[a:b], b - a) ^ np.uint64(0x5851F42D4C957F2D * (b - a) & (1 << 64) - 1)
        else:
            yield runs[:0]

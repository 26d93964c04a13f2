"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract: space, \t, \n, \v, \f, \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SHARED = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder serves, but only with a local master.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="knnspark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/knnspark-{uuid.uuid4().hex}/{name}"
    if not _SHARED:
        atexit.register(_clean)
    _SHARED.append((spark, path.rsplit("/", 1)[0]))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _SHARED:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then; other paths may belong to another one
            continue


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    The write's shuffle files go with it: what is written needs them no more. discard() removes the table itself.
    """
    spark, path = df.sparkSession, new_table_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    tidy_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose readers have all been written themselves."""
    for table_ in tables:
        path = table_.written_to.rsplit("/", 1)[0]
        remove_path(table_.sparkSession, path)
        _SHARED[:] = [x for x in _SHARED if x[1] != path]


def tidy_driver(spark: SparkSession) -> None:
    """Gives native memory that the driver's Python and JVM no longer need back to the system.

    Many small jobs leave the C library's arenas full of holes, which count as used. Java versions without that command stay as they are.
    """
    gc.collect()
    tidy()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    try:
        kinds, given = new(lang.Class, 4), new(lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class is not public, its interface is.
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds at most `most` bytes of `column` (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def tidy() -> None:
    """Gives memory that a Python worker no longer needs back: idle workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at white space and at the row's end."""
    ink = ~_IS_SPACE[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    prev = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
    starts = np.flatnonzero(ink & (~prev | first[:-1]))
    nxt = np.concatenate([ink[1:], [False]]) if len(ink) else ink
    ends = np.flatnonzero(ink & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0xA0761D6478BD642F
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            grown[0] = 1
            _POWERS[k] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, the same wherever the span stands."""
    up, down = _powers(len(buf) + 1)
    scrambled = mix64(np.arange(1, 257, dtype=np.uint64))[buf]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(scrambled * up[: len(buf)], dtype=np.uint64, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

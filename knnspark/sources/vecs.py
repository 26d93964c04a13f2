"""fvecs, bvecs and ivecs: little-endian records of a 32-bit dimension count and the components.

A reader for spark.read.format("vecs") that cuts files by record ranges, and a writer. Files
are opened through pyarrow's file systems, so any URI it knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = {"fvecs": ("<f4", "float", pa.float32()), "bvecs": ("u1", "short", pa.int16()), "ivecs": ("<i4", "int", pa.int32())}
ROWS_PER_BATCH = 4096


def kind_of(path: str) -> str:
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind not in KINDS:
        raise ValueError(f"{path}: not one of {', '.join(KINDS)}")
    return kind


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _record(kind: str, dims: int) -> np.dtype:
    return np.dtype([("d", "<u4"), ("v", KINDS[kind][0], (dims,))])


def _files(path: str, kind: str) -> list[tuple[str, int, int]]:
    """Path, dimensions and records of the file, or of the files of a folder by name."""
    system, at = _open(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(kind)), key=lambda x: x.path) if info.type == fs.FileType.Directory else None
    if found is None:
        raise FileNotFoundError(path)
    out = []
    for f in found:
        if not f.size:
            continue
        with system.open_input_file(f.path) as opened:
            dims = int(np.frombuffer(opened.read(4), "<u4")[0])
        size = _record(kind, dims).itemsize
        if not dims or f.size % size:
            raise ValueError(f"{f.path}: {f.size} bytes are no multiple of records of {dims} dimensions")
        out.append((f.path, dims, f.size // size))
    return out


class _Range(InputPartition):
    def __init__(self, path: str, dims: int, first: int, count: int, vec_id: int) -> None:
        self.path, self.dims, self.first, self.count, self.vec_id = path, dims, first, count, vec_id


class VecsSource(DataSource):
    """Options: path, kind (else by suffix), from, num (rows), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _kind(self) -> str:
        return self.options.get("kind") or kind_of(self.options["path"])

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{KINDS[self._kind()][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self._kind())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._kind(), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind = options["path"], kind
        self.first, self.num = int(options.get("from", 0)), int(options["num"]) if options.get("num") else None
        self.step = int(options.get("rowspartition") or options.get("rowsPerPartition") or 250_000)

    def partitions(self) -> list[InputPartition]:
        files = _files(self.path, self.kind)
        rows = sum(n for _, _, n in files)
        if self.first < 0 or self.first > rows:
            raise ValueError(f"from {self.first} is outside of {rows} rows")
        if len({d for _, d, _ in files}) > 1:
            raise ValueError("files differ in dimensions")
        stop = rows if self.num is None else self.first + self.num
        if stop > rows:
            raise ValueError(f"{self.num} rows from {self.first} are more than the {rows} there are")
        out, before = [], 0
        for path, dims, n in files:
            for at in range(max(0, self.first - before), min(n, stop - before), self.step):
                out.append(_Range(path, dims, at, min(self.step, stop - before - at, n - at), before + at))
            before += n
        return out or [_Range("", 1, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        record = _record(self.kind, partition.dims)
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as opened:
            opened.seek(partition.first * record.itemsize)
            for at in range(0, partition.count, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.count - at)
                rows = np.frombuffer(opened.read(n * record.itemsize), dtype=record)
                if (rows["d"] != partition.dims).any():
                    raise ValueError(f"{partition.path}: records differ in dimensions")
                values = pa.array(rows["v"].ravel().astype(KINDS[self.kind][2].to_pandas_dtype()))
                ids = np.arange(partition.vec_id + at, partition.vec_id + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * partition.dims, values)], names=["vec_id", "embedding"])


class _Message(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Writer(DataSourceArrowWriter):
    """Each task writes one file under a temporary name; the commit names them in partition order."""

    def __init__(self, path: str, kind: str, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = path, kind, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        from pyspark import TaskContext

        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        context = TaskContext.get()
        target, out = f"{at}/_try-{context.partitionId():05d}-{context.taskAttemptId()}", None
        try:
            for batch in iterator:
                col = batch.column(batch.schema.get_field_index("embedding"))
                if not len(col):
                    continue
                dims = len(col[0])
                values = col.flatten().to_numpy(zero_copy_only=False)
                if len(values) != dims * len(col) or not dims:
                    raise ValueError("vectors differ in length or are null or empty")
                rows = np.zeros(len(col), dtype=_record(self.kind, dims))
                rows["d"], rows["v"] = dims, values.reshape(len(col), dims)
                out = out or system.open_output_stream(target)
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return _Message(target if out is not None else None)

    def commit(self, messages: list[_Message | None]) -> None:
        system, at = _open(self.path)
        kept = sorted(m.path for m in messages if m is not None and m.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(at)):
                if old.path.endswith(f".{self.kind}"):
                    system.delete_file(old.path)
        for k, path in enumerate(kept):
            system.move(path, f"{at}/part-{k:05d}.{self.kind}")
        self._drop_attempts(system, at)

    def abort(self, messages: list[_Message | None]) -> None:
        self._drop_attempts(*_open(self.path))

    @staticmethod
    def _drop_attempts(system: fs.FileSystem, at: str) -> None:
        """Files that failed or doubled attempts have left."""
        for old in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if old.path.rsplit("/", 1)[-1].startswith("_try-"):
                system.delete_file(old.path)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(VecsSource)


def read_vecs(spark: SparkSession, path: str, first: int = 0, num: int | None = None, kind: str | None = None) -> DataFrame:
    """Rows (vec_id, embedding); vec_id is the record's number in the file, or in the folder's files in order of name."""
    register_sources(spark)
    reader = spark.read.format("vecs").option("from", str(first))
    for key, value in (("num", num), ("kind", kind)):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def write_vecs(df: DataFrame, path: str, kind: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", files: int | None = None) -> None:
    """Writes vectors in the order of their ids: a folder of part files, range-partitioned (one file for files=1).

    Existing part files are replaced. bvecs take integers 0 to 255.
    """
    kind = kind or kind_of(path)
    register_sources(df.sparkSession)
    typed = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(f"array<{KINDS[kind][1]}>").alias("embedding"))
    dealt = typed.repartitionByRange(files, "vec_id") if files else typed.repartitionByRange("vec_id")
    dealt.sortWithinPartitions("vec_id").write.format("vecs").mode("overwrite").option("kind", kind).save(path)


def from_numpy(spark: SparkSession, array: np.ndarray, first_id: int = 0) -> DataFrame:
    """A 2-d array as rows (vec_id, embedding); bytes become shorts."""
    array = np.asarray(array)
    if array.ndim != 2:
        raise ValueError("a 2-dimensional array is needed")
    if array.dtype not in (np.float32, np.float64, np.uint8, np.int32):
        raise ValueError(f"no vectors of {array.dtype}")
    values = pa.array(np.ascontiguousarray(array.astype(np.int16) if array.dtype == np.uint8 else array).ravel())
    lists = pa.ListArray.from_arrays(np.arange(len(array) + 1, dtype=np.int32) * array.shape[1], values)
    return spark.createDataFrame(pa.table({"vec_id": np.arange(first_id, first_id + len(array)), "embedding": lists}))

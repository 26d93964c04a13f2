"""Datasets of HDF5 files (as ann-benchmarks ships them: train, test, neighbors) as vector tables; needs h5py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    import h5py
except ImportError:  # not everywhere installed
    h5py = None

ROWS_PER_BATCH = 4096


def read_hdf5(spark: SparkSession, path: str, dataset: str = "train", first: int = 0, num: int | None = None, rows_per_partition: int = 250_000) -> DataFrame:
    """Rows (vec_id, embedding) of a 2-d dataset in a file that all executors can open; tasks read ranges of its rows."""
    if h5py is None:
        raise ImportError("h5py is needed to read HDF5 files")
    with h5py.File(path, "r") as f:
        rows, dims = f[dataset].shape
        whole = np.issubdtype(f[dataset].dtype, np.integer)
    stop = rows if num is None else first + num
    if first < 0 or stop > rows:
        raise ValueError(f"rows {first} to {stop} are outside of {rows} rows")
    ranges = spark.range(first, stop, rows_per_partition, max(1, -(-(stop - first) // rows_per_partition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with h5py.File(path, "r") as f:
            for start in (x for b in batches for x in b.column(0).to_pylist()):
                for at in range(start, min(start + rows_per_partition, stop), ROWS_PER_BATCH):
                    end = min(at + ROWS_PER_BATCH, start + rows_per_partition, stop)
                    values = pa.array(f[dataset][at:end].astype(np.int32 if whole else np.float32).ravel())
                    lists = pa.ListArray.from_arrays(np.arange(end - at + 1, dtype=np.int32) * dims, values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), lists], names=["vec_id", "embedding"])

    return ranges.mapInArrow(run, f"vec_id bigint, embedding array<{'int' if whole else 'float'}>")

"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): a 128-bit line key and the number of documents it was seen
in, dealt by the key and sorted in each file. Each batch of documents merge-anti-joins the
keys that the runs list already (seen in `least` documents), adds its other keys as a run of
level 0, and once a level holds `fanout` runs they are merged into one run of the next level.

Listed keys go to all tasks, which drop their lines without a shuffle: all of them up to a
fixed number, and beyond that the most frequent ones, of which there can be no more than that
number; the lines of the others meet their keys in a join. So no key's lines meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, slices, tidy, written

#: White space that a key loses at both ends.
STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> list[bytes]:
    """The 128-bit key of each line (stripped, A-Z lower-cased); empty for lines without a code point."""
    # bytes.lower() changes A-Z alone.
    return [blake2b(x, digest_size=16).digest() if (x := line.strip(STRIP)) else b"" for line in (text or b"").lower().split(b"\n")]


def _key_arrays(texts: list[bytes | None], distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line number and key of the lines with a key; distinct: each key once a text."""
    of, pos, keys = [], [], []
    for k, t in enumerate(texts):
        found = [(n, x) for n, x in enumerate(line_keys(t)) if x]
        found = [(n, x) for x, n in {x: n for n, x in found}.items()] if distinct else found
        of += [k] * len(found)
        pos += [n for n, _ in found]
        keys += [x for _, x in found]
    pairs = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
    return np.array(of, dtype=np.int64), np.array(pos, dtype=np.int32), pairs[:, 0], pairs[:, 1]


def keyed_lines(docs: DataFrame, text: str, names: list[str], distinct: bool, but: Broadcast | None = None) -> DataFrame:
    """Rows (names..., pos, h1, h2) of the lines with a key; distinct: each key once per row of docs; but: Keys to leave out."""
    chosen = docs.select(*[F.col(c) for c in names], F.col(text).cast("binary").alias("_text"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                of, pos, h1, h2 = _key_arrays(batch.column(len(names)).to_pylist(), distinct)
                if but is not None:
                    other = ~but.value.has(h1, h2)
                    of, pos, h1, h2 = of[other], pos[other], h1[other], h2[other]
                columns = [c.take(pa.array(of)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pos), pa.array(h1), pa.array(h2)], names=[*names, "pos", "h1", "h2"])
        tidy()

    return chosen.mapInArrow(run, ", ".join([*kept, "pos int, h1 bigint, h2 bigint"]))


class LineRuns:
    """The levelled runs; `least` documents make a key listed."""

    schema = "h1 bigint, h2 bigint, n bigint"

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = 4) -> None:
        self.spark, self.least, self.fanout = spark, least, fanout
        self.levels: list[list[DataFrame]] = []

    def _read(self, runs: list[DataFrame]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[r.written_to for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def totals(self) -> DataFrame:
        return self._read([r for level in self.levels for r in level]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def listed(self) -> DataFrame:
        """Keys found in at least `least` documents so far, with their number of documents counted until they were listed."""
        return self.totals().where(F.col("n") >= self.least)

    def absorb(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a batch. Each row counts as one document; a key counts once in it."""
        self.absorb_counts(keyed_lines(docs, text, [], True).groupBy("h1", "h2").agg(F.count("*").alias("n")))

    def absorb_counts(self, counts: DataFrame) -> None:
        """Adds a batch of keys (h1, h2, n), each of them once."""
        if any(self.levels):
            counts = counts.join(self.listed().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(written(counts.select("h1", "h2", "n").sortWithinPartitions("h1", "h2"), "run0"))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = self._read(old).groupBy("h1", "h2").agg(F.sum("n").alias("n")).sortWithinPartitions("h1", "h2")
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(written(merged, f"run{level + 1}"))
                discard(*old)
            level += 1


def find_listed(docs: DataFrame, least: int = 10, batches: int = 4, text: str = "text") -> DataFrame:
    """Feeds all rows through LineRuns in `batches` batches (by a hash of the text) and returns the listed keys (h1, h2, n), written.

    The texts are read once: the keys' counts of all batches are made together, dealt to the batches, and absorbed one batch after another.
    """
    runs = LineRuns(docs.sparkSession, least, fanout=2)
    batch = F.pmod(F.xxhash64(F.lit(7), F.length(text), F.substring(text, 1, 64)), F.lit(batches)).cast("int").alias("_batch")
    lines = keyed_lines(docs.select(F.col(text).alias("text"), batch), "text", ["_batch"], True)
    counts = written(lines.groupBy("_batch", "h1", "h2").agg(F.count("*").alias("n")), "counts")
    for k in range(batches):
        runs.absorb_counts(counts.where(F.col("_batch") == k))
    found = written(runs.listed(), "listed")
    discard(counts, *[r for level in runs.levels for r in level])
    return found


class Keys:
    """A set of 128-bit keys as sorted numbers."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray) -> None:
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        at, open_ = np.searchsorted(self.h1, h1), np.arange(len(h1))
        while len(open_):  # once more for each key that shares the first number
            open_ = open_[at[open_] < len(self.h1)]
            open_ = open_[self.h1[at[open_]] == h1[open_]]
            same = self.h2[at[open_]] == h2[open_]
            out[open_[same]] = True
            open_ = open_[~same]
            at[open_] += 1
        return out


def apply(docs: DataFrame, least: int = 10, batches: int = 4, id_column: str = "doc_id", text: str = "text", most_keys: int = 500_000) -> DataFrame:
    """All rows and columns of docs, text without its listed lines, plus n_lines and n_dropped.

    A document is a row, also where ids repeat or are null. n_lines counts before dropping; null or empty text is one empty
    line and becomes ''. Lines without a code point after stripping stay. Equal rows get equal results. Columns that clash
    with n_lines or n_dropped are replaced. At most most_keys listed keys go to the tasks (16 bytes each).
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*rest)
    listed = find_listed(docs, least, batches, text)
    few = listed.agg(F.count("*").alias("keys"), F.sum("n").alias("n")).head()
    # No more than most_keys keys can have a most_keys-th of all counts each.
    often = least if few["keys"] <= most_keys else max(least, few["n"] // most_keys + 1)
    got = listed.where(F.col("n") >= often).select("h1", "h2").toArrow()
    keys = docs.sparkSession.sparkContext.broadcast(Keys(got["h1"].to_numpy(), got["h2"].to_numpy()))
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if often == least:
        dropped = docs.withColumn("_gone", F.lit(None).cast("array<int>"))
    else:
        # One number for a row's id (null has its own) and one for its text name the row.
        row = [F.when(F.col(id_column).isNull(), F.lit(1)).otherwise(F.xxhash64(F.lit(0), id_column)).alias("_r1"), F.xxhash64(text).alias("_r2")]
        lines = keyed_lines(docs.select("*", *row), text, ["_r1", "_r2"], False, keys)
        rare = written(listed.where(F.col("n") < often).select("h1", "h2"), "rare")
        hits = lines.join(rare, ["h1", "h2"], "left_semi").groupBy("_r1", "_r2").agg(F.collect_set("pos").alias("_gone"))
        dropped = docs.select("*", *row).join(hits, ["_r1", "_r2"], "left").select(*rest, "_gone")
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = keys.value
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                gone = batch.column(len(rest)).to_pylist()
                of, pos, h1, h2 = _key_arrays(texts, False)
                mark = shared.has(h1, h2)
                out_of = {}
                for k, n in zip(of[mark].tolist(), pos[mark].tolist(), strict=True):
                    out_of.setdefault(k, set()).add(n)
                kept, n_lines, n_dropped = [], [], []
                for k, t in enumerate(texts):
                    less = out_of.get(k, set()) | set(gone[k] or ())
                    lines = t.split(b"\n")
                    n_lines.append(len(lines))
                    n_dropped.append(len(less))
                    kept.append(b"\n".join([x for n, x in enumerate(lines) if n not in less]) if less else t)
                columns = list(batch.columns[: len(rest)])
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*rest, "n_lines", "n_dropped"])
        tidy()

    return dropped.mapInArrow(run, StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))

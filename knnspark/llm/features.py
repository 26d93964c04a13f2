"""Hashed n-gram features, computed over whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix64, slices, span_hashes, word_spans


@dataclass(frozen=True)
class NGrams:
    """words: sizes of word n-grams; chars: sizes of character n-grams (up to 3); buckets: a power of two.

    repeats adds a family in which a word stands for how often its text has it and whether it
    equals the word before.
    """

    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3,)
    buckets: int = 1 << 16
    repeats: bool = False

    @property
    def families(self) -> int:
        return len(self.words) + len(self.chars) + self.repeats

    @property
    def size(self) -> int:
        return self.families * self.buckets


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the rows' offsets among them."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = buf[at].astype(np.uint64)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        head, follow = points[wide], np.append(buf, np.zeros(3, np.uint8)).astype(np.uint64) & np.uint64(0x3F)
        one, two, three = (follow[at[wide] + k] for k in (1, 2, 3))
        six, twelve, eighteen = np.uint64(6), np.uint64(12), np.uint64(18)
        points[wide] = np.where(
            head < 0xE0, (head & np.uint64(0x1F)) << six | one,
            np.where(head < 0xF0, (head & np.uint64(0x0F)) << twelve | one << six | two, (head & np.uint64(0x07)) << eighteen | one << twelve | two << six | three),
        )
    return points, np.concatenate([[0], np.cumsum(lead)])[offsets]


def features(buf: np.ndarray, offsets: np.ndarray, kind: NGrams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams in turn: the row and the bucket of every occurrence."""
    mask = np.uint64(kind.buckets - 1)
    starts, ends, rows = word_spans(buf, offsets)
    hashes = span_hashes(buf, starts, ends)
    for n in kind.words:
        if len(hashes) < n:
            yield rows[:0], np.zeros(0, np.int64)
            continue
        h, last = hashes[: len(hashes) - n + 1], len(hashes) - n + 1
        for k in range(1, n):
            h = mix64(h * np.uint64(3) + hashes[k : last + k])
        inside = rows[:last] == rows[n - 1 :]
        yield rows[:last][inside], (mix64(h + np.uint64(n)) & mask)[inside].astype(np.int64)
    points, ends = code_points(buf, offsets) if kind.chars else (buf[:0], 0 * offsets)
    char_rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(ends))
    for n in kind.chars:
        if len(points) < n:
            yield rows[:0], np.zeros(0, np.int64)
            continue
        last = len(points) - n + 1
        h = points[:last].copy()
        for k in range(1, n):
            h |= points[k : last + k] << np.uint64(21 * k)
        inside = char_rows[:last] == char_rows[n - 1 :]
        yield char_rows[:last][inside], (mix64(h + np.uint64(n << 60)) & mask)[inside].astype(np.int64)
    if kind.repeats:
        _, which, count = np.unique(mix64(hashes + mix64(rows.astype(np.uint64))), return_inverse=True, return_counts=True)
        total = np.bincount(rows, minlength=len(offsets) - 1)
        share = np.clip(np.ceil(np.log2(np.maximum(total[rows], 1) / count[which])), 0, 5) * (total[rows] >= 20)
        same = np.zeros(len(rows), dtype=np.int64)
        same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        yield rows, 2 * share.astype(np.int64) + same + 16 * (total[rows] < 20)


def mean_weights(buf: np.ndarray, offsets: np.ndarray, kind: NGrams, weights: np.ndarray) -> np.ndarray:
    """Per row the sum over families of the mean weight of the family's n-grams."""
    n = len(offsets) - 1
    score = np.zeros(n)
    for k, (rows, buckets) in enumerate(features(buf, offsets, kind)):
        count = np.bincount(rows, minlength=n)
        score += np.bincount(rows, weights=weights[k][buckets], minlength=n) / np.maximum(count, 1)
    return score


def sparse_rows(df: DataFrame, id_columns: list[str], text: str, kind: NGrams) -> DataFrame:
    """Each row's features as arrays: bucket + family * buckets, and its share in the family."""
    keep = [f for f in df.select(*id_columns).schema]
    schema = "buckets array<int>, shares array<float>"
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                buf, offsets = flat(batch.column(batch.schema.get_field_index(text)))
                n, cells, values = len(offsets) - 1, [], []
                for k, (rows, buckets) in enumerate(features(buf, offsets, kind)):
                    size = kind.size
                    cell, count = np.unique(rows.astype(np.int64) * size + buckets + k * kind.buckets, return_counts=True)
                    total = np.bincount(rows, minlength=n)
                    cells.append(cell)
                    values.append(count / total[cell // size])
                cell, value = np.concatenate(cells), np.concatenate(values)
                order = np.argsort(cell, kind="stable")
                cell, value = cell[order], value[order].astype(np.float32)
                size = kind.size
                ends = np.searchsorted(cell, np.arange(n + 1, dtype=np.int64) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in names]
                    + [pa.ListArray.from_arrays(ends, (cell % size).astype(np.int32)), pa.ListArray.from_arrays(ends, value)],
                    names=[*names, "buckets", "shares"],
                )

    from pyspark.sql.types import StructType

    out = StructType([*keep, *StructType.fromDDL(schema).fields])
    return df.select(*dict.fromkeys([*id_columns, text])).mapInArrow(run, out)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents, the same ones on every run: the smallest hashes of their ids.

    Rows without id, label or text are left out; of repeated labels of an id the largest counts.
    """
    few = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    found = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    return found.join(F.broadcast(few), "_id").orderBy(F.xxhash64("_id"), "_id", "_text").limit(rows)


@dataclass
class Linear:
    """A binary linear model over sparse rows with a calibrated probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (score + self.bias) + self.shift, -40, 40)))


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    return of, np.concatenate([np.zeros(0, np.int64), *(b for b, _ in rows)]).astype(np.int64), np.concatenate([np.zeros(0), *(v for _, v in rows)])


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, steps: int = 40, ridge: float = 1e-3) -> Linear:
    """Logistic regression over log-count-ratio scaled shares, by full-batch Adam.

    One class only, or no rows: a constant model of the class's smoothed share.
    """
    y = np.asarray(y, dtype=np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Linear(np.zeros(size), float(np.log(prior / (1 - prior))))
    of, cell, value = _matrix(rows)
    good, bad = (np.bincount(cell, weights=value * (y[of] == k), minlength=size) for k in (1, 0))
    alpha = 1e-3 * max(1.0, y.sum() / 1000)
    ratio = np.clip(np.log((good / y.sum() + alpha / size) / (bad / (len(y) - y.sum()) + alpha / size)), -8, 8)
    ratio[(good + bad) == 0] = 0
    w, b, m, v = np.full(size, 1.0), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    scaled = value * ratio[cell]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for k in range(1, steps + 1):
        z = np.bincount(of, weights=scaled * w[cell], minlength=len(y)) + b
        d = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(cell, weights=scaled * d[of], minlength=size) + ridge * (w - 1), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Linear(w * ratio, float(b))


def calibrate(model: Linear, score: np.ndarray, y: np.ndarray) -> Linear:
    """Platt scaling on rows that the fit has not seen; fewer than 5 rows of a class among them leave the model as it is."""
    y = np.asarray(y, dtype=np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if min(pos, neg) < 5:
        return model
    x = score + model.bias
    unit = max(float(np.std(x)), 1e-6)
    x, t = x / unit, np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        r = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * x).sum() + 1e-2 * a, (p - t).sum()])
        h = np.array([[(r * x * x).sum() + 1e-2, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return Linear(model.weights, model.bias, float(max(a, 1e-3) / unit), float(b))


def fit_text_model(sample: DataFrame, kind: NGrams, steps: int = 40) -> Linear:
    """Fits on four fifths of labelled_sample() rows and calibrates on the rest (by hash of the id)."""
    rows = sparse_rows(sample.withColumn("_part", F.abs(F.xxhash64(F.lit("part"), "_id")) % 5), ["_id", "_label", "_part"], "_text", kind).drop("_id").toArrow()
    size = kind.size
    data = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(rows["buckets"], rows["shares"], strict=True)]
    y, part = rows["_label"].to_numpy().astype(float), rows["_part"].to_numpy()
    fit, rest = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    model = fit_logistic([data[k] for k in fit], y[fit], size, steps)
    score = np.array([(model.weights[data[k][0]] * data[k][1]).sum() for k in rest])
    return calibrate(model, score, y[rest]) if len(rest) else model

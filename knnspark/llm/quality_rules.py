"""Quality rules: counted rules plus a trained text model, scored in Arrow batches.

The verdict is a logistic regression over hashed word and character n-grams, fitted on a bounded
sample of labelled rows (`sample_rows`), Platt-calibrated on a fold of its own (if that has 5 rows of
each class; else it stays uncalibrated), and compared with fixed thresholds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import _IS_SPACE, flat, slices, tidy, word_spans
from .features import Linear, NGrams, fit_text_model, labelled_sample, mean_weights

KIND = NGrams(words=(1, 2), chars=(3,), buckets=1 << 15)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = b" \t\n\x0b\x0c\r"


def repeated_words(text: bytes) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    words = text.split()
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, len(words))
    first = ids[:-2] * len(words) + ids[1:-1]
    if len(words) > 2_000_000:  # the three ids no longer fit one integer
        _, first = np.unique(first, return_inverse=True)
    _, which, count = np.unique(first * len(words) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    cover = np.zeros(len(words), dtype=bool)
    for k in range(3):
        cover[k : k + len(again)] |= again
    return int(cover.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def _counts(texts: list[bytes], buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, _, rows = word_spans(buf, offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": total(~_IS_SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[buf]),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": np.array([repeated_words(t) for t in texts], dtype=np.int64),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Linear:
    """Fits the model on at most `sample_rows` labelled rows."""
    return fit_text_model(labelled_sample(docs, labels, id_column, text, label, sample_rows), KIND)


def apply(docs: DataFrame, model: Linear, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """All rows and columns of docs, with the counts, base_failed, probability and kept.

    Columns of docs that clash with these names are replaced. A null text counts as empty: no
    words, base_failed, probability of the bias alone. Ties with the threshold keep the row. Equal rows get equal results;
    texts of any length are read whole.
    """
    added = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("probability", DoubleType()), StructField("kept", BooleanType())])
    taken = {f.name for f in added}
    rest = [c for c in docs.columns if c not in taken]
    weights = model.weights.reshape(KIND.families, KIND.buckets).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weights, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = shared.value
        for whole in batches:
            for batch in slices(whole, text, 500_000):
                col = batch.column(batch.schema.get_field_index(text))
                buf, offsets = flat(col)
                raw = buf.tobytes()
                counts = _counts([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], buf, offsets)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                p = model.probability(mean_weights(buf, offsets, KIND, weights))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                    names=[*batch.schema.names, *(f.name for f in added)],
                )
        tidy()

    return docs.select(*rest).mapInArrow(run, StructType([*docs.select(*rest).schema, *added]))

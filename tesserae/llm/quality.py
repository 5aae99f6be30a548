"""Quality scores from two compression dictionaries.

One zstandard dictionary is trained on texts labelled good, one on texts labelled bad. A text that good
text explains better compresses better with the first. The difference of the two compressed sizes and the
smaller of them, both over the text's size, go through a logistic calibration fitted on labelled texts
that the dictionaries have not seen.

The fit uses at most ``SAMPLE`` labelled rows for each label, in the order of a hash of their id, of at most
``SAMPLE_BYTES`` each; only where a label has nothing but longer texts it uses pieces. The labels are sampled before any text is read. Every row is scored on its whole text.

Defined cases: null and empty texts get the calibrated score of no evidence; rows with null ids are scored but never
learned from; null labels are no labels, of conflicting labels the larger counts; with texts of one label only, or none,
the score is the share of good labels (0.5 without labels); repeated rows are scored each; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import rows_at_a_time

SAMPLE, SAMPLE_BYTES = 3000, 1 << 15
DICTIONARY, LEVEL = 112 << 10, 3
_SMOOTH = 16


class Model:
    """Dictionaries and calibration; plain bytes and numbers, so that tasks can be sent it."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float], prior: float) -> None:
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def _sizes(compressors: list[zstandard.ZstdCompressor], texts: list[bytes]) -> np.ndarray:
    """(difference, smaller size) of every text, both over its size; zeros for an empty one."""
    out = np.zeros((len(texts), 2))
    good, bad = compressors
    for i, t in enumerate(texts):
        if t:
            a, b, n = len(good.compress(t)), len(bad.compress(t)), len(t) + _SMOOTH
            out[i] = (b - a) / n, min(a, b) / n
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = p * (1 - p) + 1e-9
        w += np.linalg.solve((x * v[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled rows of ``docs`` whose label row satisfies ``train`` (over the id column); of an id's texts the least one counts."""
    known = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    order = F.xxhash64("id")
    picked = {r.id: int(r.y) for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "id").limit(sample).collect()}
    text = F.col(text_col).cast("string")
    own = docs.where(F.col(id_col).isin(list(picked)) & (F.octet_length(text) > 0))
    fetched = lambda t, short: [(r.id, r.text) for r in own.where((F.octet_length(text) <= sample_bytes) | F.lit(not short)).groupBy(F.col(id_col).alias("id")).agg(F.min(t).alias("text")).collect()]  # noqa: E731  one text of each picked id
    rows = fetched(text, True) if picked else []
    if {picked[i] for i, _ in rows} != set(picked.values()):  # a label has long texts only: pieces of at most four bytes a character
        rows = fetched(F.substring(text, 1, sample_bytes // 4), False)
    rows.sort()
    y = np.array([picked[i] for i, _ in rows])
    prior = float((sum(picked.values()) + 1) / (len(picked) + 2))
    texts = [t.encode() for _, t in rows]
    half = np.zeros(len(rows), dtype=bool)  # one half of each label's texts makes the dictionaries, the other calibrates
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    parts = [[t for t, a, b in zip(texts, half, y, strict=True) if a and b == label] for label in (1, 0)]
    try:
        model = Model(*(zstandard.train_dictionary(DICTIONARY, p).as_bytes() for p in parts), [], prior)
    except (zstandard.ZstdError, ValueError):  # too few texts to train on
        return Model(b"", b"", [], prior)
    rest = np.flatnonzero(~half)
    if len(set(y[rest])) < 2:
        return Model(b"", b"", [], prior)
    x = _sizes(model.compressors(), [texts[i] for i in rest])
    model.weights = _logistic(x, y[rest]).tolist()
    return model


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.weights else None
        w = np.array(model.weights)
        for batch in rows_at_a_time(batches, 1):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            p = np.full(len(texts), model.prior)
            if compressors:
                has = np.fromiter(map(bool, texts), dtype=bool, count=len(texts))
                x = _sizes(compressors, texts)
                p = np.where(has, 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and ``score``, the probability of a good label."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), f"row {rows.schema['row'].dataType.simpleString()}, score double")

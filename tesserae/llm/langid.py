"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one linear classifier over hashed byte n-grams predicts each bit.
Decoding adds, for each language, the losses of the predicted margins against its codeword, each bit weighted
by how well it was learned, and takes the language with the smallest sum, so some wrong bits do no harm.
A text whose two best languages are close is flagged.

Codewords: all 2**(L-1) - 1 splits for up to seven languages, else random words of 15 log2(L) bits that are far apart.
Learning uses at most ``PER_LANGUAGE`` rows of a language, those with the smallest hashes of their ids. Rows are thinned by a
threshold from counts over all rows before they are ranked, and turned into features of their whole texts by tasks, so only
rows of ``WIDTH`` numbers reach the driver; every row is predicted on its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with null language or id are not
learned from, nor are empty texts; of rows with one id and language those with the smaller hash of the text come first; with one language all others are it; without any all are ``und``; repeated rows are predicted each; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import LOWER, rows_at_a_time, texts

PER_LANGUAGE = 800
WIDTH = 4096
AMBIGUOUS = 0.6
#: Documents that are turned into rows of features at a time.
ROWS = 512


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unit rows of square-rooted counts of hashed byte trigrams, case folded for ASCII."""
    n = len(offs) - 1
    b = LOWER[data].astype(np.uint32)
    x = np.zeros((n, WIDTH), dtype=np.float32)
    if len(b) > 2:
        h = ((b[:-2] * 31 + b[1:-1]) * 257 + b[2:]) * np.uint32(2654435761) >> np.uint32(20)
        doc = np.repeat(np.arange(n), np.diff(offs))
        inside = doc[2:] == doc[:-2]
        x = np.bincount(doc[:-2][inside] * WIDTH + h[inside], minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)
    np.sqrt(x, out=x)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(norm, 1e-9)[:, None]


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)])
    rng, bits = np.random.default_rng(7), math.ceil(15 * math.log2(n))
    tries = [rng.choice([-1, 1], (n, bits)) for _ in range(50)]
    return max(tries, key=lambda m: (bits - np.where(np.eye(n, dtype=bool), -bits, m @ m.T)).min())


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, its share) of each row."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = (np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30))) * self.trust).sum(axis=2)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(x)), best]


def _train(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 150, rate: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers for all bits at once, languages weighted alike, by gradient steps with momentum."""
    x = np.c_[x, np.ones(len(x), dtype=np.float32)].astype(np.float32)
    target = code[y].astype(np.float32)
    share = (1 / np.bincount(y, minlength=len(code))[y] / len(code)).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    v = np.zeros_like(w)
    for _ in range(rounds):
        g = x.T @ (share * -target / (1 + np.exp(target * (x @ w)))) + 1e-5 * w
        v = 0.9 * v - 0.1 * rate * g
        w += v
    trust = ((np.sign(x @ w) == target) * share).sum(axis=0)
    return w, np.maximum(2 * trust - 1, 0.05)


def _rows_of_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            column = batch.column(1)[start : start + ROWS]
            for at, to, data, offs in texts(column):
                x = features(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start + at : start + to], pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE) -> Model:
    known = docs.where(train).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null and text <> ''")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((WIDTH + 1, code.shape[1]), dtype=np.float32), np.ones(code.shape[1]))
    # four times what is wanted passes the threshold, so that chance leaves no language short
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 4 * per_language / counts[lang]))])
    share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(2**53))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    taken = known.where(share < rate[F.col("lang")]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    rows = taken.select("lang", "text").mapInArrow(_rows_of_features, "lang string, x binary").collect()
    rows.sort()
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float32).reshape(len(rows), WIDTH)
    y = np.array([languages.index(r.lang) for r in rows])
    w, trust = _train(x, y, code)
    return Model(languages, code, w, trust)


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in rows_at_a_time(batches, 1):
            for start in range(0, batch.num_rows, ROWS):
                column = batch.column(1)[start : start + ROWS]
                for at, to, data, offs in texts(column):
                    ascii_ = np.append(0, np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122)))
                    letter = ascii_[offs[1:]] > ascii_[offs[:-1]]
                    for i in np.flatnonzero(~letter):
                        letter[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode()))
                    best, p = np.full(to - at, len(names) - 1), np.zeros(to - at)
                    if len(model.languages) == 1:
                        best[letter], p[letter] = 0, 1
                    elif len(model.languages) > 1:
                        b, q = model.decode(features(data, offs))
                        best[letter], p[letter] = b[letter], q[letter]
                    flag = letter & (p < AMBIGUOUS)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start + at : start + to], pa.array(names[best], pa.string()), pa.array(p.astype(np.float64)), pa.array(flag)], ["id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)

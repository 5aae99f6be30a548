"""Exact top-k inner products by pivot-table elimination.

Every vector is quantised to floor(scale * x). A table, made once and kept beside each row, comes from its distances to all pivots. Each
distance by itself bounds another by the triangle inequality; together they give the largest lower bound that distances to
these pivots allow: they place a vector on the span of the pivots and tell how far above it it lies, and two vectors are
nearest if both lie on the same side. With places y and heights h over the first pivot that is

    <x, q>  <=  <y(x), y(q)> + h(x) h(q) + terms of x alone and of q alone

Each query starts with the k-th best score among a bounded sample of the rows, so all blocks know it. Within a block the bounds of all rows
and queries are one matrix product; candidates that can still reach the k-th score are evaluated in the order of their bounds, and
evaluation stops once no bound can. The pivots are the mean of the sample and a point along each of its principal directions, where
bounds are tightest; they and the sample affect speed, never results. On near-uniform vectors of 64 dimensions single distances exclude 4 %
of the candidates, 56 pivots together 96 %.

Queries are dealt to blocks of ``QUERY_BLOCK`` and rows to blocks of ``ROW_BLOCK``; no query or row but the sample is sent to all tasks.

Defined cases: vectors that are null or empty or hold null or non-finite components take no part, nor do rows with a
null id; vectors whose length differs from the query's are no candidates of it; a query's own id is no candidate of it;
a repeated row is one candidate, an id with several vectors counts with its best, as a query with the smallest by its bytes; ties go to the
smaller id; an empty table gives an empty result; other columns do not matter. Components that are too large for exact sums of
doubles are multiplied as whole numbers of any size; components after scaling, and scores, beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, SAMPLE = 56, 2048
QUERY_BLOCK, ROW_BLOCK = 8192, 4096
#: Candidates evaluated between two looks at the k-th score, and queries whose bounds are held at a time.
STEP, QUERIES = 64, 256
#: Bounds are taken so much higher, relative to the squares of the lengths and the first pivot's, that rounding cannot exclude a row.
SLACK = 1e-5


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """The first row, then always the row farthest from those taken."""
    taken = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(sample)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def along_axes(sample: np.ndarray, n: int) -> np.ndarray:
    """The mean, and a point from it along each of the first principal directions."""
    mean = sample.mean(axis=0)
    size = max(1.0, float(np.sqrt((sample * sample).sum(axis=1).mean())))
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    return np.vstack((mean[None], mean + size * axes[:n]))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T), 0))


class Frame:
    """The span of the pivots. Pivots that add next to nothing to those before are left out."""

    def __init__(self, pivots: np.ndarray) -> None:
        rest = pivots[1:] - pivots[0]
        axes: list[np.ndarray] = []
        kept = [0]
        longest = float(np.sqrt((rest * rest).sum(axis=1).max())) if len(rest) else 0.0
        for i, v in enumerate(rest):
            for _ in range(2):
                for a in axes:
                    v = v - (v @ a) * a
            if (n := float(np.sqrt(v @ v))) > 1e-2 * longest:
                axes.append(v / n)
                kept.append(i + 1)
        self.pivots = pivots[kept]
        steps = self.pivots[1:] - pivots[0]
        self.inverse = np.linalg.inv(steps @ np.array(axes).T) if axes else np.zeros((0, 0))
        self.lengths = (steps * steps).sum(axis=1)

    def table(self, x: np.ndarray) -> np.ndarray:
        """(place on the span, height above it, product with the first pivot) of every row, from its distances to the pivots alone."""
        d = distances(x, self.pivots) ** 2
        first = self.pivots[0] @ self.pivots[0]
        y = (d[:, :1] - d[:, 1:] + self.lengths) / 2 @ self.inverse.T
        height = np.sqrt(np.maximum(d[:, 0] - (y * y).sum(axis=1), 0))
        own = ((x * x).sum(axis=1) + first - d[:, 0]) / 2
        return np.column_stack((y, height, own - first / 2))

    @staticmethod
    def bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The largest inner products that the tables of queries and rows allow."""
        return q[:, :-1] @ x[:, :-1].T + q[:, -1:] + x[:, -1]


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers."""
    if exact:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return scores[order], ids[order]


def eliminate(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, pivots: np.ndarray, k: int, *, least: np.ndarray | None = None, tables: tuple[np.ndarray, np.ndarray] | None = None, seen: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows of a block for every query, of those that reach the query's ``least`` score.

    ``tables`` holds those of queries and rows if they are known; the number of evaluated rows is added to ``seen``.
    """
    frame = Frame(pivots)
    q_table, table = tables or (frame.table(q), frame.table(x))
    norm, q_norm = (x * x).sum(axis=1), (q * q).sum(axis=1)
    exact = float(np.sqrt(norm.max(initial=0) * q_norm.max(initial=0))) < 2.0**52
    out = []
    for at in range(0, len(q), QUERIES):
        part = slice(at, at + QUERIES)
        bound = Frame.bounds(q_table[part], table) + SLACK * (norm + q_norm[part][:, None] + 2 * (pivots[0] @ pivots[0])) + 1
        for i, own in enumerate(bound, at):
            own[x_id == q_id[i]] = -np.inf
            low = -np.inf if least is None else float(least[i])
            left = np.flatnonzero((own >= low) & np.isfinite(own))
            left = left[np.argsort(-own[left], kind="stable")]
            scores, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            done, step = 0, STEP
            while done < len(left) and (len(scores) < k or own[left[done]] >= scores[-1]):
                todo = left[done : done + step]
                done, step = done + len(todo), 2 * step
                scores, ids = _best(np.append(scores, products(x[todo], q[i], exact)), np.append(ids, x_id[todo]), k)
            if seen is not None:
                seen.append(done)
            out += [(int(q_id[i]), int(v), int(s)) for v, s in zip(ids, scores, strict=True) if s >= low]
    return out


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Rows of packed vectors of one length: a byte for the width of a component, then the components."""
    out = np.empty((len(blobs), (len(blobs[0]) - 1) // blobs[0][0]))
    for i, b in enumerate(blobs):
        out[i] = np.frombuffer(b, dtype=f"<i{b[0]}", offset=1)
    return out


def _packed(v: np.ndarray) -> bytes:
    most = np.abs(v).max()
    if most >= 2.0**63:
        raise OverflowError(f"a component of {most:g} after scaling does not fit 64 bits")
    width = 4 if most < 2**31 else 8
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def _quantise(scale: int) -> Callable:
    """Vectors of whole numbers, their dimensions, and those that take part only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, blobs, sizes = [], [], []
            for i, x in enumerate(batch.column(1)):
                if not x.is_valid:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all():
                    keep.append(i)
                    blobs.append(_packed(np.floor(scale * x)))
                    sizes.append(len(x))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2).take(at)], ["id", "vector", "size", "is_query"])

    return run


def _with_tables(frames: dict[int, Frame], samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Callable:
    """Adds each row's table, and for queries the k-th best score in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            blobs, ids, asks = batch.column(1).to_pylist(), batch.column(0).to_pylist(), np.array(batch.column(3).to_pylist(), dtype=bool)
            table, least = np.empty(n, dtype=object), np.full(n, np.nan)
            sizes = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = _matrix([blobs[i] for i in at])
                frame = frames.get(size) or Frame(np.zeros((1, size)))
                for i, row in zip(at, frame.table(x).astype("<f4"), strict=True):
                    table[i] = row.tobytes()
                if size in samples:
                    s_id, s = samples[size]
                    longest = float(np.sqrt((s * s).sum(axis=1).max()))
                    for i, q in zip(at, x, strict=True):
                        if asks[i] and longest * float(np.sqrt(q @ q)) < 2.0**52:
                            scores, _ = _best((s @ q)[s_id != ids[i]].astype(np.int64), s_id[s_id != ids[i]], k)
                            least[i] = scores[-1] if len(scores) == k else np.nan
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table.tolist(), pa.binary()), pa.array(least, from_pandas=True)], ["id", "vector", "size", "is_query", "table", "least"])

    return run


def _meet(frames: dict[int, Frame], k: int) -> Callable:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, own in part.groupby("size"):
            q, x = own[own.asks], own[~own.asks].drop_duplicates(["id", "vector"])
            if len(q) and len(x):
                mats = [_matrix(t.vector.to_list()) for t in (q, x)]
                tables = tuple(np.frombuffer(b"".join(t.table), dtype="<f4").reshape(len(t), -1).astype(np.float64) for t in (q, x))
                pivots = frames[size].pivots if size in frames else np.zeros((1, size))
                out += eliminate(mats[0], q.id.to_numpy(), mats[1], x.id.to_numpy(), pivots, k, least=q.least.fillna(-np.inf).to_numpy(), tables=tables)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest integer inner products over all other rows."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id is not null")
    whole = rows.mapInArrow(_quantise(scale), "id long, vector binary, size int, is_query boolean")
    size = whole.agg(F.count("*"), F.count_if("is_query")).first()
    # a bounded sample to place pivots and to begin with; each id once
    sample = whole.where(F.pmod(F.xxhash64("id"), F.lit(max(1, size[0] // SAMPLE))) == 0).limit(SAMPLE).toPandas().drop_duplicates("id")
    samples = {int(n): (own.id.to_numpy(), _matrix(own.vector.to_list())) for n, own in sample.groupby("size")}
    frames = {n: Frame(along_axes(x, pivots)) for n, (_, x) in samples.items()}
    tabled = whole.mapInArrow(_with_tables(frames, samples, k), "id long, vector binary, size int, is_query boolean, table binary, least double")
    row_blocks, query_blocks = max(1, -(-size[0] // ROW_BLOCK)), max(1, -(-size[1] // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.hash("id"), F.lit(n))
    x = tabled.select("id", "vector", "size", "table", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"), block(row_blocks).alias("xb"), every(query_blocks).alias("qb"))
    first = F.min(F.struct("vector", "size", "table", "least")).alias("r")
    q = tabled.where("is_query").groupBy("id").agg(first).select("id", "r.vector", "r.size", "r.table", "r.least", F.lit(True).alias("asks"), every(row_blocks).alias("xb"), block(query_blocks).alias("qb"))
    near = x.unionByName(q).groupBy("xb", "qb").applyInPandas(_meet(frames, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

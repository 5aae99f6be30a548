"""Shared helpers: cut lineage in shared storage, and vectorised hashing of words in Arrow batches.

A span of bytes is a polynomial over its bytes modulo the prime 2**61 - 1, so no structure of a text makes two spans
meet: two that differ agree for at most as many bases as they have bytes, of 2**61. A whole chunk of documents is hashed with a
handful of numpy passes, without a Python loop over words.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of whole texts that are hashed at a time; a longer text is hashed by itself.
CHUNK_BYTES = 1 << 18
#: A text longer than this is hashed in pieces that end at white space.
PIECE_BYTES = 4 << 20
_P, _M31, _M30 = np.uint64(2**61 - 1), np.uint64(2**31 - 1), np.uint64(2**30 - 1)
_BASE = 0x0B53_9D1E_6A7C_F285 % (2**61 - 1)
_INV = pow(_BASE, -1, 2**61 - 1)
#: Powers of the base are kept for this many positions; those beyond are products.
_STEP, _BLOCK = 1 << 18, 1 << 14
#: Sums of a span are exact up to so many bytes.
_EXACT = 1 << 24
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space: the complement of the word characters [^\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return folder or spark.sparkContext.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Within it Arrow batches that tasks pass to Python are bounded by bytes, as texts are rows of any length; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    mid = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * (a1 * b1) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + a0 * b0)


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """The first powers of a base."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < _STEP:
        out = np.concatenate((out, times(out, np.array([pow(base, len(out), 2**61 - 1)], dtype=np.uint64))))
    return out


def _power(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo the prime."""
    if not len(at) or (top := int(at.max())) < _STEP:
        return _powers(base)[at]
    steps = np.array([pow(base, k * _STEP, 2**61 - 1) for k in range(top // _STEP + 1)], dtype=np.uint64)
    return times(_powers(base)[at % _STEP], steps[at // _STEP])


@lru_cache(maxsize=32)
def _halves(at: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower halves of the base's powers from ``at`` on."""
    up = _power(_BASE, np.arange(at, at + _BLOCK))
    return up >> np.uint64(31), up & _M31


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span: of the bytes times the upper and the lower half of the base's powers."""
    out = np.empty((2, len(data) + 1), dtype=np.uint64)
    out[:, 0] = 0
    for at in range(0, len(data), _BLOCK):
        x = data[at : at + _BLOCK].astype(np.uint64)
        x += np.uint64(1)
        for k, half in enumerate(_halves(at)):
            t = x * half[: len(x)]
            t[0] += out[k, at]
            np.cumsum(t, out=out[k, at + 1 : at + 1 + len(x)])
    return out


def span_value(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomials of the bytes start..end modulo the prime, with the powers that they have in place."""

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hi, lo = prefix[0][b], prefix[1][b]
        hi -= prefix[0][a]
        lo -= prefix[1][a]
        # neither is reduced fully: the sum stays below 2**63
        hi = (hi & _P) + (hi >> np.uint64(61))
        lo = (lo & _P) + (lo >> np.uint64(61))
        return _reduced(((hi & _M30) << np.uint64(31)) + (hi >> np.uint64(30)) + lo)

    out = value(start, np.minimum(end, start + _EXACT))
    for i in np.flatnonzero(end - start > _EXACT):
        for a in range(int(start[i]) + _EXACT, int(end[i]), _EXACT):
            out[i] = _reduced(out[i : i + 1] + value(np.array([a]), np.array([min(a + _EXACT, int(end[i]))])))[0]
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes start..end."""
    return mix(times(span_value(prefix, start, end), _power(_INV, np.asarray(start))) + (end - start).astype(np.uint64) * GOLD)


def deletion_hash(prefix: np.ndarray, start: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes that the bytes start..end have without the one at ``at``."""
    rest = times(span_value(prefix, at + 1, end), np.array([_INV], dtype=np.uint64))
    value = times(_reduced(span_value(prefix, start, at) + rest), _power(_INV, np.asarray(start)))
    return mix(value + (end - start - 1).astype(np.uint64) * GOLD)


def rows_at_a_time(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes in the column ``text``, or of one row."""
    for batch in batches:
        column = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of whole texts of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word in the bytes of several texts."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
    begin = np.zeros(n + 1, dtype=bool)
    begin[:n] = inside
    begin &= edge
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts - 1]]  # two texts that meet without white space
    stop = edge & ~begin
    begin[both] = True
    stop[both] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every lower-cased word; a long text is read piece by piece."""
    if len(data) <= PIECE_BYTES or len(offs) != 2:
        start, end, doc = words(data, offs)
        return span_hash(prefix_hash(LOWER[data]), start, end), doc
    out, at = [], 0
    while at < len(data):
        to = min(at + PIECE_BYTES, len(data))
        while to < len(data) and not SPACE[data[to]]:
            to += int(np.argmax(SPACE[data[to : to + PIECE_BYTES]])) or min(PIECE_BYTES, len(data) - to)
        piece = data[at:to]
        start, end, _ = words(piece, np.array([0, len(piece)]))
        out.append(span_hash(prefix_hash(LOWER[piece]), start, end))
        at = to
    h = np.concatenate(out)
    return h, np.zeros(len(h), dtype=np.int64)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct word shingles of every text.

    A text with fewer words than ``width`` has its whole sequence as one shingle; a text without words has none.
    """
    h, doc = word_hashes(data, offs)
    if not len(h):
        return h, doc
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    left = first[doc] + count[doc] - np.arange(len(h))  # words from here to the end of the text
    size = np.minimum(width, count)[doc]
    at = np.flatnonzero(left >= size)
    size = size[at]
    out = size.astype(np.uint64)
    for k in range(width):
        use = size > k
        out[use] = mix(out[use] * GOLD + h[at[use] + k])
    who = doc[at]
    key = mix(out + who.astype(np.uint64) * GOLD)
    order = np.argsort(key)
    key = key[order]
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = key[1:] != key[:-1]
    keep = np.sort(order[keep])
    return out[keep], who[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Removal of every byte covered by a string of ``length`` bytes that also starts elsewhere.

The suffixes compared are those that begin near anchors. Each window of ``length`` bytes has one anchor, the leftmost
smallest gram hash in it, so equal windows have equal anchors at equal offsets, and only windows of one anchor need
comparing. An anchor's record is the run of windows that it stands for. Records whose anchor occurs once are unique;
records whose whole run of bytes occurs twice, by a hash modulo a prime of 61 bits and by length and offset, are repeated.
What is left, records at the edges of repeated passages, is resolved byte by byte: their bytes go to the anchor's bucket, the rows of a bucket
are dealt to shards, aligned at the anchor and sorted, and the sorted shards are merged by iterative interleave refinement
(Holt and McMillan), which is how Burrows-Wheeler transforms of shards are merged: round k stably moves the rows of each
class by their k-th symbol, and the round in which two neighbours part is their common prefix. No transform of the whole text
is built; only anchored rows are refined, once to the right of the anchor and once to its left. Rows that are together after ``length``
symbols are the repeated intervals. Anchors with more open records than ``hot`` are resolved by counting window hashes,
which splits over any number of tasks.

Anchors that have very many rows are seen in a sample of the documents. Their rows are counted by map-side combined
aggregates and joined back; a window over one anchor sorts the rows of the others only. The sample routes rows and
decides nothing.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose
nothing; a text of any length is scanned in pieces that overlap by ``length`` - 1 bytes; matches never cross texts; a repeated row is another occurrence of its own text; rows with a
null id are left out; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import GOLD, cut, mix, prefix_hash, rows_at_a_time, signed, span_hash, texts

LENGTH, GRAM = 200, 32
#: Bytes of records that are merged at a time, records in a shard, and records of an anchor beyond which windows are counted.
BATCH, SHARDS, HOT = 1 << 19, 4, 20_000
#: Rows of an anchor, as a sample of one document in ``SAMPLE`` lets expect, from which they are not sorted in one window; so many anchors at most.
HEAVY, SAMPLE, HEAVY_ANCHORS = 100_000, 64, 20_000
#: Bytes of a long text that are scanned at a time, and bits of a position inside them.
PIECE, _PLACE = 4 << 20, 27
_ODD = 0x9C5F_2B1D_7E43_A86B


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by minima from the left and from the right of blocks."""
    n = len(x)
    pad = -n % width
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).reshape(-1)
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


@lru_cache(maxsize=1)
def _gram_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        step = np.full(n, base, dtype=np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams. They place anchors and decide nothing, so the cheap ring modulo 2**64 will do."""
    n = len(data)
    up, down = _gram_powers(1 << max(18, (n + 1).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    return mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])


def records(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the run's bytes, document, first window, last window, anchor) of every anchor, as chunk positions."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    grams = gram_hashes(data, gram)
    key = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    start = np.arange(n - length + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - length + 1]
    inside = start + length <= offs[doc + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = anchor[lo]
    wide = mix(span_hash(prefix_hash(data), lo, hi + length) + (at - lo).astype(np.uint64) * GOLD)
    return grams[at], wide, doc[lo], lo, hi, at


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the bytes in their text) of runs of whole texts, and of the pieces of long ones."""
    for at, _, data, offs in texts(column):
        if len(data) <= PIECE:
            yield at, data, offs, 0
            continue
        for s in range(0, len(data) - length + 1, PIECE):
            piece = data[s : s + PIECE + length - 1]
            yield at, piece, np.array([0, len(piece)]), s


_PACKED = "id long, k long, h long, wide long, pack long"


def _scan(length: int, gram: int) -> Callable:
    """Rows of anchors: pack is (first window << 24 | further windows << 16 | anchor's offset << 8 | seen twice).

    Runs that occur twice in one chunk are reported at once, with a null h, and one of them stays as a partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 2):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for at, data, offs, shift in _pieces(batch.column(2), length):
                h, wide, doc, lo, hi, p = records(data, offs, length, gram)
                order = np.argsort(wide, kind="stable")
                same = wide[order][1:] == wide[order][:-1]
                repeat = np.zeros(len(h), dtype=bool)  # a later copy
                repeat[order[1:][same]] = True
                twin = repeat.copy()
                twin[order[:-1][same]] = True
                pack = (lo - offs[doc] + shift) << 24 | (hi - lo) << 16 | (p - lo) << 8 | twin
                null = pa.array(signed(h), mask=repeat)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + doc]), pa.array(keys[at + doc]), null, pa.array(signed(wide)), pa.array(pack)], ["id", "k", "h", "wide", "pack"])

    return run


def _contexts(length: int) -> Callable:
    """The bytes of each record that is still to be resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "id", "k", "pack", "bytes"]
        for batch in rows_at_a_time(batches, 2):
            out: dict = {x: [] for x in names}
            size = 0
            for i, k, text, hs, packs in zip(*(batch.column(x).to_pylist() for x in range(5)), strict=True):
                raw = text.encode()
                for h, pack in zip(hs, packs, strict=True):
                    lo = pack >> 24
                    piece = raw[lo : lo + (pack >> 16 & 255) + length]
                    for x, v in zip(names, (h, i, k, pack, piece), strict=True):
                        out[x].append(v)
                    size += len(piece)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("id", pa.int64()), ("k", pa.int64()), ("pack", pa.int64()), ("bytes", pa.binary())]))
                    out, size = {x: [] for x in names}, 0
            yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("id", pa.int64()), ("k", pa.int64()), ("pack", pa.int64()), ("bytes", pa.binary())]))

    return run


def interleave(columns: np.ndarray, size: np.ndarray, group: np.ndarray, shards: int) -> np.ndarray:
    """classes[k, row]: rows of a group with equal classes share their first k symbols; -1: no other row does.

    The rows are dealt to shards, each shard is sorted on its own, and the sorted shards are then merged by
    refinement: round k stably moves the rows of each class of the interleave by their k-th symbol. Shards
    bring their rows in order, so a round merges sorted runs; rows that stand alone have left the interleave.
    """
    n, depth = columns.shape
    classes = np.full((depth + 1, n), -1, dtype=np.int32)
    void = np.ascontiguousarray(columns).view(f"S{depth}").reshape(-1)
    shard = [np.arange(s, n, shards) for s in range(shards)]
    z = np.concatenate([s[np.argsort(void[s])] for s in shard]) if n else np.zeros(0, dtype=np.int64)
    cls = group[z]
    for k in range(depth + 1):
        if k:
            use = size[z] >= k
            z, cls = z[use], cls[use] * 256 + columns[z[use], k - 1]
        order = np.argsort(cls, kind="stable")
        z, cls = z[order], cls[order]
        new = np.ones(len(z), dtype=bool)
        new[1:] = cls[1:] != cls[:-1]
        cls = np.cumsum(new) - 1
        many = np.bincount(cls)[cls] > 1 if len(cls) else new
        z, cls = z[many], cls[many].astype(np.int64)
        if not len(z):
            break
        classes[k, z] = cls
    return classes


def repeated_windows(h: np.ndarray, pack: np.ndarray, pieces: list[bytes], length: int, gram: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows that occur more than once; window is counted from the record's first.

    The rows of an anchor are aligned at it, so a window that starts ``o`` bytes before the anchor equals
    another exactly if both share ``o`` symbols to the left and ``length - o`` to the right.
    """
    n, more, off = len(pieces), pack >> 16 & 255, pack >> 8 & 255
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    depth = length - gram
    left = np.zeros((n, depth), dtype=np.uint8)
    right = np.zeros((n, length), dtype=np.uint8)
    for mat, width, sign, base in ((left, off, -1, begin + off - 1), (right, sizes - off, 1, begin + off)):
        width = np.minimum(width, mat.shape[1])
        row = np.repeat(np.arange(n), width)
        col = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        mat[row, col] = flat[base[row] + sign * col]
    _, group = np.unique(h, return_inverse=True)
    before = interleave(left, off, group, shards)
    after = interleave(right, sizes - off, group, shards)
    rows, wins = [], []
    for o in range(depth + 1):
        has = np.flatnonzero((off >= o) & (off - more <= o) & (before[o] >= 0) & (after[length - o] >= 0))
        if len(has) < 2:
            continue
        key = before[o, has].astype(np.int64) << 32 | after[length - o, has]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = has[count[at] > 1]
        rows.append(hit)
        wins.append(off[hit] - o)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(rows or [none]), np.concatenate(wins or [none])


_FOUND = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("run", pa.int64())])


def _runs(ids: np.ndarray, keys: np.ndarray, pack: np.ndarray, rows: np.ndarray, wins: np.ndarray) -> pa.RecordBatch:
    """Windows as runs (first << 8 | further windows)."""
    order = np.lexsort((wins, rows))
    rows, wins = rows[order], wins[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (wins[1:] != wins[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows))[: len(first)] - 1
    r = rows[first]
    return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(keys[r].astype(np.int64)), pa.array(((pack[r] >> 24) + wins[first]) << 8 | (wins[last] - wins[first]))], schema=_FOUND)


def _resolve(length: int, gram: int) -> Callable:
    """Over rows sorted by anchor: whole anchors are gathered to about BATCH bytes and merged."""

    def solve(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts)
        h, ids, keys, pack = (t.column(x).to_numpy() for x in ("h", "id", "k", "pack"))
        rows, wins = repeated_windows(h, pack, t.column("bytes").to_pylist(), length, gram)
        need = (pack[rows] & 1) == 0
        return _runs(ids, keys, pack, rows[need], wins[need])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            h = t.column("h").to_numpy()
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
            if held and len(h) and held[-1].column("h")[-1].as_py() == h[0]:
                starts = starts[1:]
            bytes_to = np.append(0, np.cumsum(np.fromiter(map(len, t.column("bytes").to_pylist()), dtype=np.int64, count=len(h))))
            done = 0
            for s in starts:
                if size + bytes_to[s] - bytes_to[done] >= BATCH:
                    held.append(t.slice(done, s - done))
                    yield solve([x for x in held if x.num_rows])
                    held, size, done = [], 0, s
            held.append(t.slice(done))
            size += bytes_to[-1] - bytes_to[done]
        if any(x.num_rows for x in held):
            yield solve([x for x in held if x.num_rows])

    return run


def _window_hashes(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack = batch.column("pack").to_numpy()
            more = (pack >> 16 & 255) + 1
            pieces = batch.column("bytes").to_pylist()
            if not pieces:
                continue
            sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(pieces)), more)
            win = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            at = begin[row] + win
            w = span_hash(prefix_hash(np.frombuffer(b"".join(pieces), dtype=np.uint8)), at, at + length)
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(row)), batch.column("id").take(pa.array(row)), batch.column("k").take(pa.array(row)), pa.array(((pack[row] >> 24) + win) << 8), pa.array((pack[row] & 1) == 0), pa.array(signed(w))], ["h", "id", "k", "run", "need", "w"])

    return run


def _back(raw: bytes, at: int) -> int:
    """The first byte of the character that the byte belongs to."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _on(raw: bytes, at: int) -> int:
    """The first byte of the next character, if the byte lies inside one."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _apply(length: int, whole: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 1):
            out: dict = {"id": [], "n_bytes": [], "spans": [], "kept": []}
            for i, text, cov, found in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                raw = (text or "").encode()
                runs = np.array([*[(x >> 24, x >> 16 & 255) for x in cov or ()], *[(x >> 8, x & 255) for x in found or ()]], dtype=np.int64).reshape(-1, 2)
                spans, kept = [], raw
                if len(runs):
                    runs = runs[np.argsort(runs[:, 0])]
                    start, end = runs[:, 0], np.maximum.accumulate(runs[:, 0] + runs[:, 1] + length)
                    new = np.append(True, start[1:] > end[:-1])
                    first = np.flatnonzero(new)
                    a, b = start[first], end[np.append(first[1:], len(runs)) - 1]
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
                    a, b = a.tolist(), b.tolist()
                    if whole:
                        a, b = [_back(raw, x) for x in a], [_on(raw, x) for x in b]
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
                for x, v in zip(out, (i, len(raw), spans, kept), strict=True):
                    out[x].append(v)
            kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([*(pa.array(v, kinds[x]) for x, v in out.items()), batch.column(4)], [*out, "row"])

    return run


def _by_windows(recs: DataFrame) -> DataFrame:
    """Adds how often a record's run and its anchor occur (same, all, rows), and whether it is the first of its run; sorted by anchor."""
    by_h, by_run = Window.partitionBy("h"), Window.partitionBy("h", "wide")
    out = recs.withColumn("first", F.row_number().over(by_run.orderBy("id", "k", "pack")) == 1).withColumn("same", F.sum("c").over(by_run))
    return out.withColumn("all", F.sum("c").over(by_h)).withColumn("rows", F.count("*").over(by_h)).select("id", "k", "h", "pack", "same", "all", "rows", "first")


def _by_counts(recs: DataFrame) -> DataFrame:
    """The same for anchors with very many rows, by aggregates with map-side combination; the joins back are split by Spark where a key is hot."""
    head = F.struct("id", "k", "pack")
    runs = recs.groupBy("h", "wide").agg(F.sum("c").alias("same"), F.count("*").alias("n"), F.min(head).alias("head"))
    whole = runs.groupBy("h").agg(F.sum("same").alias("all"), F.sum("n").alias("rows"))  # a row for each heavy anchor
    out = recs.join(runs.drop("n"), ["h", "wide"]).join(F.broadcast(whole), "h")
    return out.select("id", "k", "h", "pack", "same", "all", "rows", (head == F.col("head")).alias("first"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, heavy: int = HEAVY, sample: int = SAMPLE, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the byte spans removed and the bytes that are left.

    The columns ``carry`` come along, in a struct ``row``. With ``whole_characters`` what is left is valid UTF-8: a character
    of which a span takes a part goes with it.
    """
    if not gram < length <= gram + 255:
        raise ValueError("length must exceed gram by 1 to 255")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*carry or [F.lit(0).alias("none")]).alias("row")).where("id is not null")
    again = cut(docs.groupBy("id", F.unhex(F.sha2("text", 256)).alias("sha")).count().where("count > 1").select("id", "sha"))
    if not again.isEmpty():
        # each string of a row that is repeated also starts in its copy: all of it goes, and for other rows one copy says as much as many
        named, key = docs.withColumn("sha", F.unhex(F.sha2("text", 256))), ["id", "sha"]
        twice = named.join(again, key, "left_semi").select("id", "text", F.lit(True).alias("again"), "row")
        once = named.join(again, key, "left_anti").select("id", "text", F.lit(False).alias("again"), "row")
        kept = once.unionByName(twice.dropDuplicates(["id", "text"]).select("id", "text", "again", "row"))
        out = _remove_repeats(kept.withColumn("row", F.struct("again", F.col("row").alias("own"))), length, gram, hot, heavy, sample, whole_characters)
        out = out.where("not row.again").select("id", "n_bytes", "spans", "kept", F.col("row.own").alias("row"))
        raw = F.encode("text", "UTF-8")
        n = F.octet_length("text").cast("long")
        span = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
        whole = twice.select("id", n.alias("n_bytes"), F.when(n >= length, span).otherwise(F.slice(span, 1, 0)).alias("spans"), F.when(n >= length, F.lit(b"")).otherwise(raw).alias("kept"), "row")
        out = out.unionByName(whole)
    else:
        out = _remove_repeats(docs, length, gram, hot, heavy, sample, whole_characters)
    return (out if carry else out.drop("row")).withColumnRenamed("id", id_col)


def _remove_repeats(docs: DataFrame, length: int, gram: int, hot: int, heavy: int, sample: int, whole_characters: bool) -> DataFrame:
    """The same for distinct rows (id, text, row)."""
    docs = docs.select("id", F.xxhash64("text").alias("k"), "text", "row")
    anchors = docs.select("id", "k", "text").mapInArrow(_scan(length, gram), _PACKED)
    # a row stands for itself, or where its lowest bit is set for two or more
    recs = anchors.where("h is not null").withColumn("c", F.expr("1 + (pack & 1)"))
    seen = docs.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("id", "k", "text").mapInArrow(_scan(length, gram), _PACKED)
    many = cut(seen.where("h is not null").groupBy("h").count().where(F.col("count") * sample >= heavy).orderBy(F.desc("count")).limit(HEAVY_ANCHORS).select("h"))
    if many.isEmpty():
        recs = _by_windows(recs)
    else:  # at most HEAVY_ANCHORS hashes are broadcast
        recs = _by_windows(recs.join(F.broadcast(many), "h", "left_anti")).unionByName(_by_counts(recs.join(F.broadcast(many), "h", "left_semi")))
    recs = recs.where("all > 1").select("id", "k", "h", "pack", F.expr("same > 1").alias("repeated"), F.expr("all > same and (same = 1 or first)").alias("open"), (F.col("rows") > hot).alias("hot"))
    recs = recs.unionByName(anchors.where("h is null").select("id", "k", "h", "pack", F.lit(True).alias("repeated"), F.lit(False).alias("open"), F.lit(False).alias("hot")))
    need = F.expr("(pack & ~1L) | cast(repeated as int)")  # the lowest bit now says that the record is decided
    marks = recs.groupBy("id", "k").agg(
        F.collect_list(F.when(F.col("repeated"), F.col("pack"))).alias("cov"),
        *[F.collect_list(F.when(F.col("open") & (F.col("hot") == flag), what)).alias(name) for flag, s in ((False, ""), (True, "hot_")) for name, what in ((s + "h", F.col("h")), (s + "p", need))],
    )
    marks = cut(marks)

    def contexts(h: str, p: str) -> DataFrame:
        # all columns of docs, so that the texts are shuffled once for this and for the last join
        open_ = docs.join(marks.where(F.size(h) > 0).select("id", "k", h, p), ["id", "k"])
        return open_.select("id", "k", "text", h, p, "row").mapInArrow(_contexts(length), "h long, id long, k long, pack long, bytes binary")

    found = contexts("h", "p").repartition("h").sortWithinPartitions("h").mapInArrow(_resolve(length, gram), "id long, k long, run long")
    if not marks.where(F.size("hot_h") > 0).isEmpty():
        # not cut: within one query Spark shuffles the texts once for all that reads them, while each further job would do so again
        wins = contexts("hot_h", "hot_p").mapInArrow(_window_hashes(length), "h long, id long, k long, run long, need boolean, w long")
        twice = wins.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(wins.where("need").join(twice, ["h", "w"], "left_semi").select("id", "k", "run"))
    found = found.groupBy("id", "k").agg(F.collect_list("run").alias("found"))
    whole = docs.join(marks.select("id", "k", "cov"), ["id", "k"], "left").join(found, ["id", "k"], "left").select("id", "text", "cov", "found", "row")
    kind = docs.schema["row"].dataType.simpleString()
    return whole.mapInArrow(_apply(length, whole_characters), f"id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, row {kind}")

"""Harmonic packing of token sequences.

A document is cut so that every piece has exactly a class's length: whole sequences first, then the largest
class that still fits, down to the rest of a few tokens. Class k holds lengths of capacity // k, and its
sequences take k pieces each, so a piece's place follows from its number in its class alone. Workers number
their own pieces; one sum over (worker, class) counts tells each where it starts. The last, unfilled sequence of
each class is dissolved: those pieces, fewer than a few thousand at any input size, go first-fit into the last ones.

The price of exact classes is that texts are cut often, into 3.2 to 3.5 pieces on the supplied tables; what is bought is
that no task needs another's pieces.

Tokens come from the byte-level BPE whose vocabulary file is a parameter. Words repeat far more than texts do:
a batch is split where the vocabulary's pattern always splits, at ASCII white space, distinct pieces of text are
encoded once, and the ids are gathered back. Texts with other white space, whose runs may join, are encoded whole.

Defined cases: a null or empty text is the separator alone; a null id stays null; a repeated row is packed as often
as it occurs; special-token strings in a text are ordinary text, as the vocabulary's own notes have it (``encode_special_tokens``);
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import SPACE, cut, prefix_hash, rows_at_a_time, span_hash, texts, words

CAPACITY, SEPARATOR = 1024, 0
#: Pieces shorter than this are a class of their exact length; a class may leave at most this many tokens of a sequence empty.
SMALL, WASTE = 32, 4
CHUNK, CACHE = 1 << 20, 1_000_000
#: Bytes of Unicode white space beyond ASCII, with some other characters of the same first bytes.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary file's merges as ranks; the file writes bytes as printable characters."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t != "<|endoftext|>"}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _spelled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one span after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _differ(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the spans whose bytes lie one after the other in ``a`` and ``b`` differ; no span is empty."""
    return np.add.reduceat(a != b, np.cumsum(size) - size, dtype=np.int64) > 0 if len(size) else np.zeros(0, dtype=bool)


class Units:
    """Ids of the distinct pieces of text seen lately, found by hash and compared by their bytes."""

    def __init__(self, path: str) -> None:
        self.encode = encoder(path).encode_ordinary
        (self.line,) = self.encode("\n")
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        # of each piece: place and number of its ids, place and number of its bytes
        self.at, self.n, self.byte_at, self.size = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.ids, self.bytes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)

    def look_up(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) in self.ids of every unit."""
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self.clear()
        place = np.searchsorted(self.hash, u)
        new = np.ones(len(u), dtype=bool)
        old = place < len(self.hash)
        new[old] = self.hash[place[old]] != u[old]
        if new.any():
            at = first[new]
            ids, n = self._encoded(data, start[at], end[at])
            size, where = end[at] - start[at], place[new]  # both are sorted
            self.at = np.insert(self.at, where, len(self.ids) + np.cumsum(n) - n)
            self.byte_at = np.insert(self.byte_at, where, len(self.bytes) + np.cumsum(size) - size)
            self.n, self.size, self.hash = np.insert(self.n, where, n), np.insert(self.size, where, size), np.insert(self.hash, where, u[new])
            self.ids, self.bytes = np.concatenate((self.ids, ids)), np.concatenate((self.bytes, _spelled(data, start[at], size)))
            place = np.searchsorted(self.hash, u)
        at, n = self.at[place][back], self.n[place][back]
        # units of equal hash and other bytes are encoded by themselves
        other = self.size[place][back] != end - start
        same = np.flatnonzero(~other)
        size = (end - start)[same]
        other[same] = _differ(_spelled(data, start[same], size), _spelled(self.bytes, self.byte_at[place][back][same], size), size)
        if other.any():
            ids, n[other] = self._encoded(data, start[other], end[other])
            at[other] = len(self.ids) + np.cumsum(n[other]) - n[other]
            self.ids = np.concatenate((self.ids, ids))
        return at, n

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, ids of each): in one call, with a line break between units.

        A line break between two units without white space at their ends is a token by itself and joins with nothing;
        other units are encoded alone.
        """
        size = end - start + 1
        line = _spelled(np.append(data, np.uint8(10)), start, size)
        ends = np.cumsum(size)
        line[ends - 1] = 10
        raw = line.tobytes()
        alone = SPACE[data[end - 1]]
        alone[[int(np.searchsorted(ends, m.start(), side="right")) for m in ODD_SPACE.finditer(raw)]] = True
        joined = raw if not alone.any() else line[np.repeat(~alone, size)].tobytes()
        ids = np.array(self.encode(joined.decode()), dtype=np.uint32)
        breaks = np.flatnonzero(ids == self.line)
        n = np.zeros(len(start), dtype=np.int64)
        n[~alone] = np.diff(breaks, prepend=-1) - 1
        ids = np.delete(ids, breaks)
        if alone.any():
            own = [self.encode(data[s:e].tobytes().decode()) for s, e in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]
            where = np.repeat(np.cumsum(n)[alone], [len(x) for x in own])
            ids = np.insert(ids, where, np.array([i for x in own for i in x], dtype=np.uint32))
            n[alone] = [len(x) for x in own]
        return ids, n


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the spans whose encodings join to the text's: a word with the one blank before it, other white space by itself."""
    start, end, doc = words(data, offs)
    n = len(start)
    if not n:
        has = np.flatnonzero(np.diff(offs))
        return offs[has], offs[has + 1]
    same = np.append(False, doc[1:] == doc[:-1])
    gap = np.where(same, np.append(0, end[:-1]), offs[doc])  # where the white space before the word begins
    blank = (gap < start) & (data[np.maximum(start - 1, 0)] == 32)
    lone = (gap < start) & ~blank  # its last character stands alone
    run = gap < start - 1  # and what comes before that as well
    tail = np.flatnonzero(np.append(~same[1:], True) & (end < offs[doc + 1]))
    void = np.flatnonzero((np.bincount(doc, minlength=len(offs) - 1) == 0) & (np.diff(offs) > 0))
    a = np.concatenate((start - blank, (start - 1)[lone], gap[run], end[tail], offs[void]))
    b = np.concatenate((end, start[lone], (start - 1)[run], offs[doc[tail] + 1], offs[void + 1]))
    order = np.argsort(a)
    return a[order], b[order]


def encode_chunk(cache: Units, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, ids of each text)."""
    raw = data.tobytes()
    start, end = units(data, offs)
    at, n = cache.look_up(data, span_hash(prefix_hash(data), start, end), start, end)
    doc = np.searchsorted(offs, start, side="right") - 1
    ends = np.cumsum(n)
    ids = cache.ids[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    count = np.bincount(doc, weights=n, minlength=len(offs) - 1).astype(np.int64)
    odd = {int(np.searchsorted(offs, m.start(), side="right") - 1) for m in ODD_SPACE.finditer(raw)}
    if odd:
        parts = np.split(ids, np.cumsum(count)[:-1])
        for d in odd:
            parts[d] = np.array(cache.encode(raw[offs[d] : offs[d + 1]].decode()), dtype=np.uint32)
            count[d] = len(parts[d])
        ids = np.concatenate(parts)
    return ids, count


def per_sequence(length: int, capacity: int) -> int:
    return capacity // length


@lru_cache(maxsize=4)
def cuts(capacity: int) -> list[list[int]]:
    """Piece lengths for every rest below the capacity."""
    sizes = sorted({capacity // k for k in range(1, capacity // SMALL + 1) if capacity % k <= WASTE}, reverse=True)
    out: list[list[int]] = [[]]
    for r in range(1, capacity):
        s = next((x for x in sizes if SMALL <= x <= r), r)
        out.append([s, *out[r - s]])
    return out


def _pieces(path: str, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, plan = Units(path), cuts(capacity)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        sep = np.array([SEPARATOR], dtype=np.uint32).tobytes()
        for batch in rows_at_a_time(batches, 1):
            for at, to, data, offs in texts(batch.column(1), CHUNK):
                ids, count = encode_chunk(cache, data, offs)
                flat, place = ids.astype("<u4").tobytes(), 0
                row, start, length, crc, blobs = [], [], [], [], []
                for d, n in enumerate(count.tolist()):
                    own = flat[4 * place : 4 * (place + n)] + sep
                    place += n
                    whole, rest = divmod(n + 1, capacity)
                    s = 0
                    for size in [capacity] * whole + plan[rest]:
                        piece = own[4 * s : 4 * (s + size)]
                        row.append(d)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        if with_ids:
                            blobs.append(piece)
                        s += size
                size = np.array(length, dtype=np.int64)
                order = np.argsort(size, kind="stable")
                s = size[order]
                number = np.empty(len(s), dtype=np.int64)
                number[order] = np.arange(len(s)) - np.searchsorted(s, s) + seen[s]
                seen += np.bincount(size, minlength=capacity + 1)
                row = np.array(row, dtype=np.int64)
                cols = [batch.column(0).take(pa.array(at + row)), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(count[row] + 1), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(number)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(blobs, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    return run


def _first_fit(capacity: int) -> Callable:
    """The dissolved sequences' pieces: longest first, each into the first sequence with room."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "number"], ascending=[False, True])
        room: list[int] = []
        seq, off = [], []
        first = 0  # sequences before it are full
        for n in part.length.tolist():
            while first < len(room) and room[first] == 0:
                first += 1
            k = next((i for i in range(first, len(room)) if room[i] >= n), len(room))
            if k == len(room):
                room.append(capacity)
            seq.append(k)
            off.append(capacity - room[k])
            room[k] -= n
        return part.assign(seq=seq, offset=off)[["length", "number", "seq", "offset"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for every piece; ids are little-endian 32-bit."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long" + ", ids binary" * with_ids
    pieces = cut(docs.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, with_ids), schema))
    own = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    # a row for each class, a few dozen at any size
    k = F.floor(F.lit(capacity) / F.col("length"))
    classes = own.groupBy("length").agg(F.sum("n").alias("total")).withColumn("k", k).withColumn("bins", F.floor(F.col("total") / F.col("k")))
    order = Window.orderBy(F.desc("length"))
    classes = cut(classes.withColumn("from", F.sum("bins").over(order) - F.col("bins")).withColumn("all", F.sum("bins").over(Window.partitionBy())))
    numbered = pieces.join(base, ["part", "length"]).withColumn("number", F.col("number") + F.col("base")).drop("part", "base").join(F.broadcast(classes), "length")
    full = F.col("number") < F.col("bins") * F.col("k")
    last = numbered.where(~full).select("length", "number", "all")
    placed = last.groupBy(F.col("all")).applyInPandas(lambda part: _first_fit(capacity)(part), "length long, number long, seq long, offset long")
    placed = placed.select("length", "number", "seq", F.col("offset").alias("rest"))
    out = numbered.join(placed, ["length", "number"], "left")
    seq = F.when(full, F.col("from") + F.floor(F.col("number") / F.col("k"))).otherwise(F.col("all") + F.col("seq")).cast("long")
    off = F.when(full, F.col("number") % F.col("k") * F.col("length")).otherwise(F.col("rest")).cast("long")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", seq.alias("sequence_id"), off.alias("offset"), *(["ids"] if with_ids else []))

"""N-gram scoring by a weighted backoff automaton whose model is as large as the corpus and never in one place.

Documents are dealt to blocks of about ``BLOCK_BYTES``. A block counts its n-grams of every order once and sends
them, sorted and packed, to buckets of about ``BUCKET_BYTES`` of text; only buckets that a block has n-grams for get a row.
Buckets add them up and answer each block with the totals of its own n-grams; word buckets also with what each word as a
history gave to its bigrams. From the answers the block builds the slice of the automaton that its texts can reach: a state
for each history of up to ``order`` - 1 tokens, arcs for the n-grams seen in training, and from every state one failure arc to the
state of the history without its first token, down to the root. The weights of a state sum to one:

    order 1   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    above     P(w | h) = (c(h, w) + S P(w | h')) / (c(h) + S),     h' is h without its first token

The failure weight S / (c(h) + S) needs nothing but the state's count, so histories, of which there are as many as the corpus is
long, get no messages of their own. A model of order 2 alone uses absolute discounting instead, for which bigrams tell their
histories what they take:

    P(w | v) = max(c(v, w) - D, 0) / c(v) + L(v) P(w),   L(v) = 1 - sum of (c(v, w) - D) / c(v) over seen w

All n-grams of training are kept (``MIN_COUNT`` is 1). They travel as sorted hashes with ``SPARE`` bits more than the corpus has bits of
length, at most 64, so one n-gram in 2**SPARE may meet another at any size. One traversal from left to right carries the states of all orders and adds up the logarithms.

Defined cases: a null or empty text is the end token alone; rows with a null id are left out; a repeated row
counts, and returns, as often as it occurs; without training rows N and V are 0; a text of any length is one block's at most; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import GOLD, mix, texts, word_hashes

BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
DISCOUNT, MIN_COUNT, SPARE = 0.75, 1, 24
#: S of order 2, and of the orders above; the likelihood of held-out texts grew up to about these values.
STRENGTH = (1000.0, 4.0)
END, BOS = np.uint64(0xE0D), np.uint64(0xB05)
_ROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_ROW_SQL = "key long, kind int, block long, payload binary"
#: Kinds of rows: n-grams go by their order, the answers to them ANSWER further on.
GIVEN, TOTALS, ANSWER = 0, -1, 100


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane: the upper bytes of small numbers are runs of zeros then."""
    head = ";".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(2, "little") + head + b"".join(planes))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    at = 2 + int.from_bytes(raw[:2], "little")
    out = []
    for part in raw[2:at].decode().split(";"):
        kind, n = part.split(":")
        size = np.dtype(kind).itemsize * int(n)
        planes = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(-1, int(n)) if size else np.zeros((1, 0), dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


class Tokens:
    """The tokens of a block: hash, previous hash (BOS at a text's start), text and whether it trains."""

    def __init__(self, column: pa.ChunkedArray, train: np.ndarray) -> None:
        h, doc = [], []
        for at, to, data, offs in texts(column):
            x, d = word_hashes(data, offs)
            ends = np.searchsorted(d, np.arange(to - at), side="right")
            h.append(np.insert(x, ends, END))
            doc.append(at + np.insert(d, ends, np.arange(to - at)))
        self.h = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, dtype=np.int64)
        self.n_docs = len(train)
        self.train = train[self.doc]
        self.prev = np.empty_like(self.h)
        self.prev[1:] = self.h[:-1]
        self.prev[np.searchsorted(self.doc, np.arange(self.n_docs))] = BOS

    def unigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted words, place of each token among them, training counts); BOS counts texts."""
        word, place = np.unique(np.append(self.h, BOS), return_inverse=True)
        count = np.bincount(place[:-1][self.train], minlength=len(word))
        count[place[-1]] = (self.train & (self.h == END)).sum()
        return word, place, count

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, tokens that end an n-gram of this order, place of each among the keys, training counts); texts begin with one BOS."""
        key = mix(self.prev * GOLD + self.h)
        at = np.arange(len(self.h)) - np.searchsorted(self.doc, self.doc)
        for _ in range(order - 2):
            key[1:] = mix(key[:-1] * GOLD + self.h[1:])
        ends = np.flatnonzero(at >= order - 2)
        key, place = np.unique(key[ends] >> np.uint64(64 - bits), return_inverse=True)
        return key, ends, place, np.bincount(place[self.train[ends]], minlength=len(key))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, histories, 40 bits of the words, place of each token, training counts)."""
        key, first, place = np.unique(bigram_key(self.prev, self.h >> np.uint64(24)), return_index=True, return_inverse=True)
        return key, self.prev[first], self.h[first] >> np.uint64(24), place, np.bincount(place[self.train], minlength=len(key))


def bigram_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * GOLD + word)


def _spread(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each bucket's entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def _count(buckets: int, order: int, bits: int):
    """A block's counts, a row for each order and bucket that it has n-grams for."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        t = Tokens(block.column("text"), block.column("train").to_numpy().astype(bool))
        out: dict = {x: [] for x in _ROW.names}

        def put(kind: int, bucket: int, payload: bytes) -> None:
            for x, v in zip(_ROW.names, (bucket, kind, key[0].as_py(), payload), strict=True):
                out[x].append(v)

        def put_keys(kind: int, k: np.ndarray, count: np.ndarray) -> None:
            for b, at in enumerate(_spread(k % np.uint64(buckets), buckets)):
                if len(at):
                    put(kind, b, pack(np.diff(k[at] // np.uint64(buckets), prepend=np.uint64(0)), count[at].astype(np.uint32)))

        word, _, count = t.unigrams()
        put_keys(1, word, count)
        if order > 2:
            for n in range(2, order + 1):
                k, _, _, count = t.grams(n, bits)
                put_keys(n, k, count)
            return pa.Table.from_pydict(out, _ROW)
        k, history, w, _, count = t.bigrams()
        del t
        for b, at in enumerate(_spread(k % np.uint64(buckets), buckets)):
            if len(at):
                at = at[np.lexsort((w[at], history[at]))]
                put(2, b, pack(np.diff(history[at], prepend=np.uint64(0)), (w[at] >> np.uint64(32)).astype(np.uint8), w[at].astype(np.uint32), count[at].astype(np.uint32)))
        return pa.Table.from_pydict(out, _ROW)

    return run


def _sum(buckets: int):
    """Totals of the n-grams of a bucket to the blocks that have them, and the bucket's share of N and V."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        kind = part.column("kind").to_numpy()
        out: dict = {x: [] for x in _ROW.names}
        rows = []
        for n in sorted(set(kind.tolist())):
            mine = part.filter(pa.array(kind == n))
            asked = [unpack(x) for x in mine.column("payload").to_pylist()]
            ends = np.cumsum([len(d) for d, _ in asked])
            k, place = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in asked]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([c for _, c in asked]), minlength=len(k)).astype(np.int64)
            del asked
            for block, lo, hi in zip(mine.column("block").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                rows.append((key[0].as_py(), ANSWER + n, block, pack(total[place[lo:hi]].astype(np.uint32), np.array([key[0].as_py()]))))
            if n == 1:
                real = k * np.uint64(buckets) + np.uint64(key[0].as_py()) != BOS
                rows.append((int(total[real].sum()), TOTALS, int((total[real] > 0).sum()), b""))
        for row in rows:
            for x, v in zip(_ROW.names, row, strict=True):
                out[x].append(v)
        return pa.Table.from_pydict(out, _ROW)

    return run


def _add(buckets: int):
    """Totals of n-grams to the blocks that have them, and what bigrams take to their histories; words pass."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        kind = part.column("kind").to_numpy()
        out: dict = {x: [] for x in _ROW.names}

        def put(kind: int, to: int, block: int, payload: bytes) -> None:
            for x, v in zip(_ROW.names, (to, kind, block, payload), strict=True):
                out[x].append(v)

        mine = part.filter(pa.array(kind == 2))
        asked = [unpack(x) for x in mine.column("payload").to_pylist()]
        if asked:
            ends = np.cumsum([len(x[0]) for x in asked])
            history = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
            k = bigram_key(history, np.concatenate([x[1].astype(np.uint64) << np.uint64(32) | x[2] for x in asked]))
            count = np.concatenate([x[3] for x in asked])
            del asked
            _, first, place = np.unique(k, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=count, minlength=len(first)).astype(np.int64)
            total[total < MIN_COUNT] = 0
            for block, lo, hi in zip(mine.column("block").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                own = total[place[lo:hi]][np.argsort(k[lo:hi])]  # the block has them by key
                put(ANSWER + 2, buckets + block, block, pack(own.astype(np.uint32), np.array([key[0].as_py()])))
            kept = np.flatnonzero(total)
            v, at = np.unique(history[first[kept]], return_inverse=True)
            taken = np.bincount(at, weights=total[kept] - DISCOUNT, minlength=len(v))
            for b, at in enumerate(_spread(v % np.uint64(buckets), buckets)):
                if len(at):
                    put(GIVEN, b, -1, pack(v[at], taken[at]))
        return pa.concat_tables([part.filter(pa.array(kind == 1)).cast(_ROW), pa.Table.from_pydict(out, _ROW)])

    return run


def _add_words(buckets: int):
    """Totals of words, what they gave as histories, and the bucket's share of N and V."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            return part.cast(_ROW)
        kind = part.column("kind").to_numpy()
        mine = part.filter(pa.array(kind == 1))
        given = [unpack(x) for x in part.filter(pa.array(kind == GIVEN)).column("payload").to_pylist()]
        asked = [unpack(x) for x in mine.column("payload").to_pylist()]
        words = [np.cumsum(d, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket) for d, _ in asked]
        word, place = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([c for _, c in asked]), minlength=len(word)).astype(np.int64)
        taken = np.zeros(len(word))
        for v, s in given:
            np.add.at(taken, np.searchsorted(word, v), s)
        real = word != BOS
        ends = np.cumsum([len(x) for x in words])
        out: dict = {x: [] for x in _ROW.names}
        rows = [(buckets + block, ANSWER + 1, block, pack(count[place[lo:hi]], taken[place[lo:hi]], np.array([bucket]))) for block, lo, hi in zip(mine.column("block").to_pylist(), [0, *ends[:-1]], ends, strict=True)]
        rows.append((int(count[real].sum()), TOTALS, int((count[real] > 0).sum()), b""))
        for row in rows:
            for x, v in zip(_ROW.names, row, strict=True):
                out[x].append(v)
        return pa.Table.from_pydict(out, _ROW)

    return run


class Automaton:
    """A slice of the backoff automaton: states for words and histories, arcs for kept n-grams, failure arcs down to the root."""

    def __init__(self, unigram: np.ndarray, count: np.ndarray, taken: np.ndarray | None) -> None:
        self.root = unigram  # arcs that leave the root
        self.count = count  # of each one-word state
        self.taken = taken  # what discounted bigrams leave to its arcs

    def traverse(self, word: np.ndarray, state: np.ndarray, arcs: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """Log10 weight of every step, left to right: the state before each token is its history in the text.

        ``arcs`` holds for orders 2 and on the count on the arc that matches the token, 0 where the step takes the failure
        arc; ``histories`` for orders 3 and on the count of the state that the arc leaves, 0 where there is no such state.
        """
        weight = self.root[word]
        if self.taken is not None:
            of = np.maximum(self.count, 1)
            fail = np.where(self.count > 0, 1 - self.taken / of, 1.0)
            weight = np.where(arcs[0] > 0, (arcs[0] - DISCOUNT) / of[state], 0.0) + fail[state] * weight
        else:
            for n, (arc, total) in enumerate(zip(arcs, [self.count[state], *histories], strict=True)):
                s = STRENGTH[min(n, 1)]
                weight = (arc + s * weight) / (total + s)
        return np.log10(weight)


def _answered(answers: pa.Table, kind: np.ndarray, n: int, keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """What the buckets say of the block's keys, in the order of the keys."""
    out: list[np.ndarray] = []
    spread = _spread(keys % np.uint64(buckets), buckets)
    for payload in answers.filter(pa.array(kind == ANSWER + n)).column("payload").to_pylist():
        *values, bucket = unpack(payload)
        out = out or [np.zeros(len(keys), dtype=np.result_type(v.dtype, np.int64)) for v in values]
        for all_, v in zip(out, values, strict=True):
            all_[spread[bucket[0]]] = v
    return out


def _score(buckets: int, order: int, bits: int):
    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(block.column("text"), block.column("train").to_numpy().astype(bool))
        if not len(t.h):
            return pa.table({"id": block.column("id"), **{x: np.zeros(0, dtype=np.int64) for x in ("n_tokens", "n_known", "train_tokens")}, **{x: np.zeros(0) for x in ("base_score", "score")}})
        kind = answers.column("kind").to_numpy()
        n_train, n_words = (answers.column(x)[0].as_py() for x in ("n_train", "n_words"))
        word, place, _ = t.unigrams()
        count, *taken = _answered(answers, kind, 1, word, buckets)
        arcs, histories = [], []
        if order == 2:
            k, _, _, at, _ = t.bigrams()
            arcs.append(_answered(answers, kind, 2, k, buckets)[0][at])
        for n in range(2, order + 1) if order > 2 else ():
            k, ends, at, _ = t.grams(n, bits)
            arc, total = np.zeros(len(t.h), dtype=np.int64), np.zeros(len(t.h), dtype=np.int64)
            if len(ends):
                arc[ends] = _answered(answers, kind, n, k, buckets)[0][at]
                if n > 2:
                    total[ends] = arcs[-1][ends - 1]
            arcs.append(arc)
            histories += [total] if n > 2 else []
        base = (count + 0.5) / (n_train + 0.5 * (n_words + 1))
        model = Automaton(base, count, taken[0] if taken else None)
        bos, place = place[-1], place[:-1]
        state = np.empty_like(place)
        state[1:] = place[:-1]
        starts = np.searchsorted(t.doc, np.arange(t.n_docs))
        state[starts] = bos
        steps = model.traverse(place, state, arcs, histories)
        known = np.add.reduceat((count[place] > 0).astype(np.int64), starts)
        n = np.diff(np.append(starts, len(place)))
        return pa.table({"id": block.column("id"), "n_tokens": n, "n_known": known, "train_tokens": np.full(t.n_docs, n_train), "base_score": np.add.reduceat(np.log10(base)[place], starts), "score": np.add.reduceat(steps, starts)})

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = 2, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, least_blocks: int = 8) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row, learning from rows where ``train``."""
    if order < 2:
        raise ValueError("the order must be at least 2")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")).where("id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = (max(least_blocks, math.ceil(size / x)) for x in (block_bytes, bucket_bytes))
    bits = min(64, SPARE + size.bit_length())
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    counts = dealt.groupBy("block").applyInArrow(_count(buckets, order, bits), _ROW_SQL)
    if order > 2:
        answers = counts.groupBy("key").applyInArrow(_sum(buckets), _ROW_SQL)
    else:
        answers = counts.groupBy("key").applyInArrow(_add(buckets), _ROW_SQL).groupBy("key").applyInArrow(_add_words(buckets), _ROW_SQL)
    # one row of two numbers
    totals = answers.where(F.col("kind") == TOTALS).agg(F.struct(F.coalesce(F.sum("key"), F.lit(0)).alias("n"), F.coalesce(F.sum("block"), F.lit(0)).alias("v")).alias("t")).scalar()
    own = answers.where(F.col("kind") > ANSWER).withColumn("t", totals).select("key", "kind", "block", "payload", F.col("t.n").alias("n_train"), F.col("t.v").alias("n_words"))
    out = dealt.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_score(buckets, order, bits), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)

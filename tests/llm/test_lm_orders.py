"""The automaton of order 3 and 4 against brute force, many buckets, structured words and long texts."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import lm
from tesserae.llm.common import word_hashes


def model(texts, order):
    """log10 probabilities by dictionaries, straight from the formulas."""
    counts = [collections.Counter() for _ in range(order + 1)]
    heads = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        tokens = [0, *(t or "").encode().lower().split(), None]
        counts[1].update(tokens[1:])
        for n in range(2, order + 1):
            for i in range(len(tokens) - n + 1):
                counts[n][tuple(tokens[i : i + n])] += 1
                heads[n][tuple(tokens[i : i + n - 1])] += 1
    total, kinds = sum(counts[1].values()), len(counts[1])
    types = collections.Counter(h[0] for h in counts[2])

    def p(history, w):
        n = len(history) + 1
        if n == 1:
            return (counts[1][w] + 0.5) / (total + 0.5 * (kinds + 1))
        below, c, of = p(history[1:], w), counts[n][(*history, w)], heads[n][tuple(history)]
        if order > 2:
            s = lm.STRENGTH[0 if n == 2 else 1]
            return (c + s * below) / (of + s)
        return below if not of else max(c - lm.DISCOUNT, 0) / of + lm.DISCOUNT * types[history[0]] / of * below

    def score(t):
        tokens = [0, *(t or "").encode().lower().split(), None]
        return sum(math.log10(p(tuple(tokens[max(0, i - order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))

    return p, score, [*counts[1], "unseen"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, order):
    rnd = random.Random(order)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.choices(words, weights=range(12, 0, -1), k=rnd.randint(1, 40)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "W1  w2\tnew w1 w1"), rows[0], (203, rows[1][1]), (206, rows[4][1])]
    p, own, vocabulary = model([t for i, t in rows if i % 5 != 1], order)
    for history in ((0,), (b"w1",), (0, b"w0"), (b"w0", b"w1"), (b"w2", b"never")):
        if len(history) < order:
            assert abs(sum(p(history, w) for w in vocabulary) - 1) < 1e-9
    data = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "w1", 0)], "doc_id long, text string, block int")
    found = lm.score(data, F.col("doc_id") % 5 != 1, order=order, block_bytes=900, bucket_bytes=300).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in found) == sorted((i, round(own(t), 6)) for i, t in rows)


def test_copies_are_told_apart(spark):
    """A held-out copy of a training text is far likelier under long histories than one that is new."""
    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randrange(300)}" for _ in range(60))
    rows = [(i, text()) for i in range(300)]
    rows += [(1001 + 5 * k, rows[2 + 5 * k][1]) for k in range(20)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    per = {n: {r.doc_id: r.score / r.n_tokens for r in lm.score(data, F.col("doc_id") % 5 != 1, order=n).collect()} for n in (2, 3)}
    gap = lambda s: min(s[1001 + 5 * k] for k in range(20)) - max(s[i] for i in range(1, 300, 5))
    assert gap(per[3]) > 0.9 and gap(per[3]) > gap(per[2])


def test_payloads_and_empty_buckets():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, dtype=np.uint8), np.array([1.5, -2.0]), np.array([7])]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    block = pa.table({"text": ["a b"], "train": [True]})
    out = lm._count(1000, 3, 64)((pa.scalar(4),), block)
    assert out.num_rows <= 4 + 3 + 2 and set(out.column("kind").to_pylist()) == {1, 2, 3}


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_structured_words_differ(spark, n):
    """A word and its letter swap, which agree under any polynomial modulo a power of two."""
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{a} {b} {a}".encode(), dtype=np.uint8)
    h, _ = word_hashes(data, np.array([0, len(data)]))
    assert h[0] != h[1] and h[0] == h[2]
    rows = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    found = {r.doc_id: r.n_known for r in lm.score(rows, F.col("doc_id") == 0).collect()}
    assert found == {0: 2, 1: 1, 2: 2}

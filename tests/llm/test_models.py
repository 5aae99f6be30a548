"""Scoring, classification and search, against brute force and held-out accuracy, with the odd rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import langid, lm, quality, topk

SF = "/root/testdata/sf0.01"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40 if i < 60 else 0]], 1, 2) for i in range(90)]
    rows += [(100, None, 1, 2), (110, [None] * 8, 1, 2), (120, [float("nan")] * 8, 1, 2), (130, [float("inf")] * 8, 1, 2), (140, [], 1, 2), (150, [1.0, 2.0], 1, 2), (None, [1.0] * 8, 1, 2), rows[7]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, score long")
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(data, F.col("vec_id") % 10 == 0, pivots=5).collect()]
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v, *_ in rows if i is not None and i < 90}
    expected = []
    for i in sorted(q):
        if i % 10 == 0:
            best = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(found) == sorted(expected)
    assert topk.top_k(data.limit(0), F.lit(True)).count() == 0


def test_elimination_stops_early():
    """Rows whose bounds cannot reach the k-th score are not evaluated, and the result is that of all rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (5000, 6)).astype(float)
    x[:20] *= 40
    ids = np.arange(5000)
    pivots = topk.farthest_first(x[:500], 16)
    found = topk.eliminate(x[:3], ids[:3], x, ids, pivots, 5)
    for i in range(3):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(5000) if j != i)[:5]
        assert [(v, s) for q, v, s in found if q == i] == [(j, -s) for s, j in best]


def test_language_model(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, weights=range(30, 0, -1), k=rnd.randint(1, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "W1  w2\tnew"), rows[0], (None, "w1")]
    data = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    found = lm.score(data, F.col("doc_id") % 5 != 1, block_bytes=2000).collect()
    rows = rows[:-1]
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    uni, bi, head = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in tokens:
        if i % 5 != 1:
            uni.update(t)
            bi.update(zip([0, *t[:-1]], t))
            head.update([0, *t[:-1]])
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    given = collections.Counter()
    for (a, _), c in bi.items():
        given[a] += c - lm.DISCOUNT if c >= lm.MIN_COUNT else 0

    def step(a, w):
        rest = 1 - given[a] / head[a] if head[a] else 1.0
        return (bi[a, w] - lm.DISCOUNT if bi[a, w] >= lm.MIN_COUNT else 0) / max(head[a], 1) + rest * p(w)

    vocabulary = [*uni, "unseen"]
    for a in (0, b"w1", b"w29"):
        assert abs(sum(step(a, w) for w in vocabulary) - 1) < 1e-9
    expected = sorted((i, len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10(p(w)) for w in t), 6), round(sum(math.log10(step(a, w)) for a, w in zip([0, *t[:-1]], t)), 6)) for i, t in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == expected
    assert lm.score(data.limit(0), F.lit(True)).count() == 0
    none = lm.score(data.where("doc_id = 3"), F.lit(False)).first()
    assert (none.train_tokens, none.n_known) == (0, 0)


def test_bigrams_seen_once_count(spark):
    data = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "b"), (3, "a b"), (4, "c b")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score(data, F.col("doc_id") < 3).collect()}
    # a 2, b 2, c 1, end 3: 8 tokens of 4 kinds; every text is (start, its words, end)
    p = {"a": 2.5 / 10.5, "b": 2.5 / 10.5, "c": 1.5 / 10.5, "end": 3.5 / 10.5}
    start_a, a_b, b_end = 1.25 / 3 + 1.5 / 3 * p["a"], 0.25 / 2 + 1.5 / 2 * p["b"], 1.25 / 2 + 0.75 / 2 * p["end"]
    start_c, c_b = 1.5 / 3 * p["c"], 0.75 * p["b"]
    assert found[3] == pytest.approx(math.log10(start_a * a_b * b_end), abs=1e-9)
    assert found[4] == pytest.approx(math.log10(start_c * c_b * b_end), abs=1e-9)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    model = langid.fit(docs, fold)
    found = langid.predict(docs.withColumn("score", F.lit("clash")), model).join(docs.where(~fold), "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "é"), (None, "the thing")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(odd.union(odd.limit(1)), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred in model.languages and None in out
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.predict(odd.limit(0), model).count() == 0
    alone = langid.fit(docs.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, alone).collect()} == {"en", "und"}
    empty = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 4, 7, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2)


def test_wrong_bits_are_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.r_[np.zeros((langid.WIDTH, code.shape[1])), np.zeros((1, code.shape[1]))], np.ones(code.shape[1]))
    for i in range(5):
        model.weights[-1] = 4 * code[i]
        model.weights[-1][:2] *= -1
        assert model.decode(np.zeros((1, langid.WIDTH)))[0][0] == i


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    model = quality.fit(docs, labels, fold)
    out = quality.score(docs, model).select("row.doc_id", "score").join(labels.where(~fold), "doc_id").toPandas()
    rank, good = out.score.rank(), out.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and ((out.score >= 0.5) == good).mean() > 0.93
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "the", 3)], "doc_id long, text string, score int")
    scored = quality.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == 3 and scored[0].row.score == 3
    for few in (labels.limit(0), labels.where("quality = 1").limit(5)):
        plain = quality.fit(docs, few, F.lit(True))
        assert quality.score(odd, plain).first().score == plain.prior


def test_most_candidates_are_excluded():
    """On near-uniform vectors, where single distances exclude next to none; results stay those of all rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1))[:, None])
    ids, seen = np.arange(4000), []
    pivots = topk.along_axes(x[:2000], topk.PIVOTS)
    alone = np.abs(topk.distances(x[:20], pivots)[:, None, :] - topk.distances(x, pivots)[None]).max(axis=2)
    exact = topk.distances(x[:20], x)
    joint = topk.Frame(pivots)
    bound = topk.Frame.bounds(joint.table(x[:20]), joint.table(x))
    true = x[:20] @ x.T
    assert (bound >= true - 1e-3).all() and (alone <= exact + 1e-2).all()
    found = topk.eliminate(x[:20], ids[:20], x, ids, pivots, 5, seen=seen)
    for i in range(20):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5]
        assert [(v, s) for q, v, s in found if q == i] == [(j, -s) for s, j in best]
    assert sum(seen) < 0.25 * 20 * 4000


def test_large_components_and_several_vectors(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**29, 3.0]), (2, [2.0**29, 4.0]), (3, [-(2.0**30), 0.0]), (4, [1.0, 1.0]), (4, [5.0, 1.0]), (4, [1.0, 1.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3, scale=1).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2, 2**59 + 4), (2, 1, 2**59 + 3), (3, 4, 5 * 2**30 + 1)]


def test_long_texts_are_learned_from(spark):
    """Where all texts are long, languages and quality are learned from them all the same."""
    rnd = random.Random(2)
    words = {"xx": ["zu", "der", "und", "nicht"], "yy": ["the", "of", "and", "was"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randrange(50)) for _ in range(n))
    rows = [(i, text(lang, 7000), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    new = spark.createDataFrame([(i, text(lang, 30), lang) for i, lang in enumerate(("xx", "yy") * 5)], docs.schema)
    assert all(r.lang_pred == r.lang for r in langid.predict(new, model).join(new, "doc_id").collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    good = quality.fit(docs, labels, F.lit(True))
    found = {r.row.doc_id: r.score for r in quality.score(docs, good).collect()}
    assert good.weights and all((found[i] > 0.5) == (i % 2 == 1) for i in found)


def test_languages_by_brute_force(spark):
    """Margins, weighted losses and shares of a fitted model, text by text in Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0")
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.col("doc_id") % 2 == 0)
    for r in langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode())
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        x = np.zeros(langid.WIDTH)
        for a, b, c in zip(low, low[1:], low[2:]):
            x[((((a * 31 + b) * 257 + c) * 2654435761) % 2**32) >> 20] += 1
        x = np.sqrt(x)
        x /= max(np.sqrt((x * x).sum()), 1e-9)
        margin = x @ model.weights[:-1] + model.weights[-1]
        loss = [sum(t * math.log1p(math.exp(-max(-30, min(30, m * k)))) for t, m, k in zip(model.trust, margin, code)) for code in model.code]
        share = [math.exp(min(loss) - v) for v in loss]
        best = max(range(len(loss)), key=lambda i: share[i])
        assert r.lang_pred == model.languages[best] and abs(r.score - share[best] / sum(share)) < 1e-3


def test_quality_by_brute_force(spark):
    """Both compressed sizes of every text by a compressor made anew, and the calibration by hand; repeated rows, an empty table."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    some = docs.where("doc_id % 7 = 0")
    found = quality.score(some.union(some.limit(3)), model).select("row.doc_id", "row.text", "score").collect()
    assert len(found) == some.count() + 3 and quality.score(docs.limit(0), model).count() == 0
    size = lambda d, t: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    for r in found[:40]:
        t = (r.text or "").encode()
        a, b, n = size(model.good, t), size(model.bad, t), len(t) + quality._SMOOTH
        z = model.weights[0] + model.weights[1] * (b - a) / n + model.weights[2] * min(a, b) / n
        assert abs(r.score - (1 / (1 + math.exp(-z)) if t else model.prior)) < 1e-3

"""Rows that are repeated many times, and articles among articles that are comments or adverts."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import minhash, quality, suffix, topk, wrapper
from tests.llm.test_dedup import removed


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def many(spark, rows, copies):
    one = spark.createDataFrame(rows, "doc_id long, text string")
    return one.union(one.where("doc_id in (1, 2)").withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(copies)))).drop("n")).repartition(6)


def test_near_duplicates_of_rows_with_twenty_thousand_copies(spark):
    rnd = random.Random(1)
    text = words(rnd, 120)
    rows = [(1, text), (2, text + " " + words(rnd, 3)), (3, words(rnd, 90)), (4, text.upper()), (5, "")]
    found = minhash.near_duplicates(many(spark, rows, 20_000))
    groups = {(r.doc_id, r.component_id, r.kept, r.n) for r in found.groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()}
    assert groups == {(1, 1, True, 20_000), (2, 1, False, 20_000), (3, 3, True, 1), (4, 1, False, 1), (5, 5, True, 1)}


@pytest.mark.parametrize("copies", [2, 20_000])
def test_passages_of_rows_with_many_copies(spark, copies):
    rnd = random.Random(2)
    passage = words(rnd, 60)[:260]
    rows = [(1, words(rnd, 100) + passage), (2, "é short"), (3, "x " + passage + words(rnd, 30)), (4, words(rnd, 50)), (5, passage[:210]), (5, words(rnd, 70)), (1, words(rnd, 80))]
    out = suffix.remove_repeats(many(spark, rows, copies))
    found = {(r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)): r.n for r in out.groupBy("doc_id", "n_bytes", "kept", "spans").agg(F.count("*").alias("n")).collect()}
    plain = [*rows, rows[0], rows[1], rows[6]]
    expected = {}
    for (i, t), gone in zip(plain, removed(plain, 200), strict=True):
        raw = t.encode()
        spans = sum(bool(gone[j]) and (j == 0 or not gone[j - 1]) for j in range(len(raw)))
        expected[i, len(raw), bytes(b for b, g in zip(raw, gone, strict=True) if not g), spans] = copies if i in (1, 2) else 1
    assert found == expected


def page(body):
    return f"<html><body><nav>Home News</nav>{body}<footer>All rights</footer></body></html>"


ARTICLE = "<p>The first paragraph of the article, which is long enough.</p><p>The second paragraph of it.</p>"
TEXT = "The first paragraph of the article, which is long enough.\n\nThe second paragraph of it."


@pytest.mark.parametrize("body", [
    f"<div class=post>{ARTICLE}</div><article class='comment'><p>Nice one</p></article><article class='comment'><p>Not so nice one, I would say at length here</p></article>",
    f"<div class=post>{ARTICLE}</div><article class='advert'><p>Buy this now</p></article>",
    f"<article class='post'>{ARTICLE}<article class='comment-12'><p>Nice one</p></article></article>",
    f"<main class='with-sidebar'>{ARTICLE}<aside>More</aside></main>",
    f"<main>{ARTICLE}<div class='site-footer'><p>Contact</p></div><section id='reader-comments'><p>Nice</p></section></main>",
])
def test_comments_and_adverts_may_be_articles(spark, body):
    frame = spark.createDataFrame([(1, "http://h/a", page(body))], "page_id long, url string, html string")
    assert wrapper.extract(frame).first().text == TEXT


def test_names_that_only_hold_a_cue():
    assert not any(wrapper._is_boilerplate(x) for x in ("promo-code-guide", "job-search", "with-sidebar", "formula", "shareholder-news", "", "post"))
    assert all(wrapper._is_boilerplate(x) for x in ("site-header", "comment-list", "comment-12", "ad", "x cookie-notice", "social_share", "main-nav", "page-footer", "related-posts"))


def test_components_beyond_64_bits_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e17, 0.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(rows, F.col("vec_id") == 2).collect()
    kept = spark.createDataFrame([(1, [1e13, 0.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(kept, F.col("vec_id") == 2).first().score == 256 * 256 * 10**13


def test_fit_does_not_depend_on_how_repeated_ids_lie(spark):
    """Ids with many texts: one of them counts, the same for every order and number of partitions."""
    rnd = random.Random(12)
    stock = [[words(rnd, 1) for _ in range(60)] for _ in range(2)]
    prose = lambda label: " ".join(rnd.choice(stock[label]) for _ in range(80))
    docs = [(i, prose(i % 2)) for i in range(400) for _ in range(60 if i < 6 else 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality long")
    models = [quality.fit(x, labels, F.lit(True), sample=150) for x in (frame.repartition(1), frame.repartition(7), frame.orderBy(F.desc("text")))]
    learned = [(m.good, m.bad, m.weights, m.prior) for m in models]
    assert models[0].weights and all(x == learned[0] for x in learned)

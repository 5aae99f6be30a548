"""The registered queries over whole small tables: their columns, folds and digests against brute force or SQL."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

from tesserae.llm import registry
from tests.llm.test_dedup import removed
from tests.llm.test_lm_orders import model
from tests.test_oracles import rows

SF = "/root/testdata/sf0.001"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    found, expected = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)


def test_all_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_lm_score(spark, docs):
    out = registry.QUERIES["op4_lm_score"](spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    train = [t for i, t in docs.items() if fold(i, 5) != 1]
    _, own, vocabulary = model(train, 3)
    known = set(vocabulary)
    found = out.collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        tokens = [*docs[r.doc_id].encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.n_known) == (fold(r.doc_id, 5) == 1, len(tokens), sum(t in known for t in tokens))
        assert r.train_tokens == sum(len(t.encode().split()) + 1 for t in train)
        assert abs(r.score - own(docs[r.doc_id])) < 1e-6 * max(1, len(tokens))


def test_suffix_dedup(spark, docs):
    masks = removed(list(docs.items()), 200)
    found = {r.doc_id: r for r in registry.QUERIES["op10_suffix_dedup"](spark, SF).collect()}
    assert len(found) == len(docs)
    for (i, t), m in zip(docs.items(), masks, strict=True):
        raw = t.encode()
        kept = bytes(b for b, gone in zip(raw, m, strict=True) if not gone)
        spans = sum(bool(m[j]) and (j == 0 or not m[j - 1]) for j in range(len(m)))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(raw), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_language_and_quality(spark, docs):
    out = registry.QUERIES["op6_language_id"](spark, SF).collect()
    langs = {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").collect() if r.lang}
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id]))) and r.lang_pred in langs | {"und"}
    out = registry.QUERIES["op8_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_packing_and_pages(spark, docs):
    out = registry.QUERIES["op9_packing"](spark, SF).toPandas()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    sums = out.groupby("doc_id").agg(n=("length", "sum"), m=("doc_tokens", "first"))
    assert (sums.n == sums.m).all() and sorted(sums.index) == sorted(docs)
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = registry.QUERIES["op5_html_extract"](spark, SF).collect()
    assert sorted(r.page_id for r in found) == sorted(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in found)


def test_chat_has_the_extra_conversation(spark):
    found = {r.conv_id: r for r in registry.QUERIES["op7_chat_format"](spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert found[-7].n_turns == 2 and found[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (found[-7].loss_chars, found[-7].loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())

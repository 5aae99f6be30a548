"""Each stage of the pipeline on odd rows, and the whole against what brute force keeps."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tesserae.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id long, k int"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.0, "r", 1, 2) for i, t, lang in rows], SCHEMA)


def prose(spark, n=12):
    """Texts that the classifier keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    return [r.row.text for r in quality.score(docs, model).orderBy(F.desc("score"), "row.doc_id").limit(n).collect()]


ODD = [(None, "null id", "en"), (900, None, None), (901, "", "en"), (902, " \n", "en"), (903, "one", None)]


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_odd_rows(spark, stage):
    long = " ".join(f"w{i}" for i in range(200_000))
    data = docs_of(spark, [*ODD, ODD[-1], (904, long, "en"), (905, "w1 w2 é" * 3, "de")])
    out = stage(spark, data, SF)
    if stage is not pipeline.packed:
        assert tuple(out.columns) == pipeline.COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in data.schema[:5]]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {None, 900, 901, 902, 903, 904, 905}
    if stage is not pipeline.good_quality:
        assert ids >= {None, 900, 901, 903, 905}
    empty = stage(spark, data.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_quality_of_odd_rows(spark):
    data = docs_of(spark, [*ODD, ODD[-1]])
    model = quality.fit(data, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    assert model.weights == []  # no labelled text is there, so the share of good labels decides
    assert pipeline.good_quality(spark, data, SF).count() == (6 if model.prior >= 0.5 else 0)


def test_one_of_each(spark):
    rnd = random.Random(3)
    words = [[f"v{rnd.randrange(300)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i, w in enumerate(words):
        for j in range(4):
            own = list(w)
            own[7 * j] = f"new{j}"
            rows.append((10 * i + j, " ".join(own), "en"))
    rows += [rows[0], *ODD]
    found = sorted((r.doc_id for r in pipeline.one_of_each(spark, docs_of(spark, rows), SF).where("doc_id is not null").collect()))
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t, _ in rows if i is not None and (t or "").split()}
    linked = {frozenset(p) for p in itertools.combinations(shingles, 2) if 100 * len(shingles[p[0]] & shingles[p[1]]) >= 80 * len(shingles[p[0]] | shingles[p[1]])}
    drop = {max(p) for p in linked}  # every member of a group here is near all others
    assert found == sorted({i for i, *_ in rows if i is not None} - drop) and len(drop) == 12


def test_passages_go_in_whole_characters(spark):
    passage = "é" * 150  # 300 bytes, shared from the middle of a character on in no text, but cut at odd bytes where runs differ
    rows = [(1, "a" + passage + "b x", "en"), (2, "é" + passage[1:] + "c y", "en"), (3, "kept alone", "fr"), (4, passage, "en")]
    out = {r.doc_id: r for r in pipeline.without_passages(spark, docs_of(spark, rows), SF).collect()}
    assert 4 not in out and out[3].text == "kept alone" and out[3].lang == "fr"
    for i in (1, 2):
        assert "�" not in out[i].text and out[i].text in dict((x, t) for x, t, _ in rows)[i] or out[i].text in ("ab x", "c y")
        assert out[i].n_chars == len(out[i].text) and "é" not in out[i].text


def test_no_benchmark(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    rows = [(1, "so " + items[0] + " then", "en"), (2, items[1].upper(), "en"), (3, "nothing of that kind is in this text at all", "en"), (3, "again " + items[2], "en"), *ODD]
    assert {r.doc_id for r in pipeline.no_benchmark(spark, docs_of(spark, rows), SF).collect()} == {None, 900, 901, 902, 903}


def test_settings_and_folders_are_put_back(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = pipeline.run(spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    folder = out.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").replace("//", "/")
    import os

    assert sorted(os.listdir(folder)) == ["4"]
    assert not prose(spark, 1) == []

"""Row numbers, running totals and records over many ranges and splits."""

import gzip

import pytest
from pyspark.sql import functions as F

from tesserae.operators.ranges import borders, numbered, running_total
from tesserae.sources import files


def test_numbers_of_many_rows(spark):
    """Wide rows, so that a range exchange would sample other borders each time."""
    rows = spark.range(0, 400_000, 2, 13).select((F.col("id") * 7919 % 400_009).alias("at"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("pad"))
    out = numbered(rows, "at", "n", parts=37)
    assert out.columns == ["at", "pad", "n"]
    one = out.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count("*")).first()
    assert tuple(one) == (200_000, 0, 199_999, 200_000)
    expected = {v: k for k, v in enumerate(sorted(i * 7919 % 400_009 for i in range(0, 400_000, 2)))}
    assert all(expected[r["at"]] == r.n for r in out.select("at", "n").collect())


def test_totals_by_text_and_over_nulls(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 1000 > 0, F.md5(F.col("id").cast("string"))).alias("k"), "id", (F.col("id") % 7).alias("v"))
    assert len(borders(rows, "k", 20)) == 19
    found = running_total(rows, ["k", "id"], "v", "t", parts=20).toPandas().sort_values(["k", "id"], na_position="first")
    assert (found.t == found.v.cumsum()).all()
    few = spark.createDataFrame([(None, 1), ("b", 2), ("a", 4)], "k string, v long")
    assert {r.k: r.t for r in running_total(few, ["k"], "v", "t", parts=5).collect()} == {None: 1, "a": 5, "b": 7}
    assert numbered(few.limit(0), "v", "n").count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_fastq_of_many_splits(spark, tmp_path, packed):
    """Quality lines that look like headers, records across splits, lines longer than a split, several files."""
    want = []
    for f in range(3):
        own = [(f"r{f}_{i}", "ACGT" * (i % 40 if i % 5000 else 20_000), "@" * 4 * (i % 40 if i % 5000 else 20_000)) for i in range(20_000 if f else 7)]
        want += own
        text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in own)
        (gzip.open(tmp_path / f"{f}.fq.gz", "wt") if packed else open(tmp_path / f"{f}.fq", "w")).write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        out = files.fastq(spark, str(tmp_path)).select("record_no", "read_id", "sequence", "qual", F.size("quals").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r)[1:4] for r in sorted(out)] == want
    assert [r.record_no for r in sorted(out)] == list(range(len(want))) and all(r.n == len(r.qual) for r in out)

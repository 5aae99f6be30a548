"""Rows of whole reads are dealt by their letters, so what one task reads does not grow with the table."""

import gzip

from pyspark.sql import functions as F

from tesserae import cli
from tesserae.operators import ranges
from tesserae.plans import bindings


def test_parts_by_size(spark):
    few = spark.sparkContext.defaultParallelism
    assert ranges.parts_of(spark, None) == ranges.parts_of(spark, 0) == 1 and ranges.parts_of(spark, few * ranges.LEAST) == few
    assert ranges.parts_of(spark, 100 * ranges.PART) == 101
    rows = spark.range(5000).select((F.col("id") * 2477 % 5000).alias("no")).repartition(3)
    found = ranges.sorted_by(rows, "no", 30 * ranges.PART).withColumn("part", F.spark_partition_id()).collect()
    assert [r.no for r in found] == list(range(5000))
    sizes = [sum(r.part == k for r in found) for k in range(31)]
    assert max(sizes) < 3 * 5000 / 31


def test_documents_in_order(spark, tmp_path, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(ranges, "PART", 20_000)
    own = bindings.sequences(spark, sf_dir, ordered=True)
    own.select(F.col("chrom_idx").cast("string").alias("value")).write.text(str(tmp_path / "out"))
    parts = [p.read_text().split() for p in sorted((tmp_path / "out").glob("part-*"))]
    expected = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]
    assert [int(x) for p in parts for x in p] == expected
    assert len(parts) > 8 and max(map(len, parts)) < len(expected) / 4


def test_prepared_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PART", 4000)
    monkeypatch.setattr(ranges, "LEAST", 1000)
    size = lambda k: 60 if k % 2 else 200
    (tmp_path / "r.fq").write_text("".join(f"@r{k}\n{'ACGT' * (size(k) // 4)}\n+\n{'I' * size(k)}\n" for k in range(400)))
    cli.main(["--parts", "reads", "prepare", str(tmp_path / "r.fq"), str(tmp_path / "o"), "--batch-size", "5", "--min-read-length", "100"])
    failed = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in sorted((tmp_path / "o.fail.fq.gz").glob("part-*.fq.gz"))]
    assert [x for p in failed for x in p[::4]] == [f"@r{k}" for k in range(400) if k % 2]
    assert max(sum(map(len, p)) for p in failed) < 3 * 4000  # 24,000 letters; one part of them before
    batches = {int(p.parent.name[6:]): p for p in (tmp_path / "o.batch").glob("batch=*/*.fq.gz")}
    assert sorted(batches) == list(range(1, 81)) and len({p.name for p in batches.values()}) > 8
    for k, p in batches.items():
        assert gzip.decompress(p.read_bytes()).decode().splitlines()[::4] == [f"@r{i}" for i in range(5 * k - 5, 5 * k) if i % 2 == 0]
    assert f'"batches": {len(batches)}' in (tmp_path / "o.catalog.yaml").read_text()

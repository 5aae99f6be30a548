"""Parts of whole reads are cut by bytes and not by rows, so long reads that follow one another are dealt over many tasks."""

import gzip

from pyspark.sql import functions as F

from tesserae import cli
from tesserae.operators import ranges
from tesserae.plans import bindings

LONG = [10] * 900 + [2000] * 100


def sizes_of(folder, pattern):
    return [sum(map(len, gzip.decompress(p.read_bytes()).decode().split("\n")[1::2])) for p in sorted(folder.glob(pattern))]


def test_long_documents_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PART", 20_000)
    rows = [(k, "a" * n) for k, n in enumerate(LONG)] + [(None, "n" * 10), (2000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    own = bindings.sequences(spark, str(tmp_path), ordered=True).withColumn("part", F.spark_partition_id()).collect()
    assert [r.chrom_idx for r in own] == [None, *range(1000), 2000]
    assert all(r.seq == ("A" * LONG[r.chrom_idx] if r.chrom_idx is not None and r.chrom_idx < 1000 else "C" * 10 if r.chrom_idx is None else None) for r in own)
    parts = {}
    for r in own:
        parts[r.part] = parts.get(r.part, 0) + len(r.seq or "")
    assert len(parts) > 8 and max(parts.values()) < 1.25 * 20_000 + 2 * 2000  # nearly all 200,000 letters lay in one or two parts before


def test_long_reads_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PART", 40_000)
    lines = lambda k, n: f"@r{k}\n{'C' * n}\n+\n{('!' if k % 2 else 'I') * n}\n"
    (tmp_path / "r.fq").write_text("".join(lines(k, n) for k, n in enumerate(LONG)))
    cli.main(["--parts", "reads", "prepare", str(tmp_path / "r.fq"), str(tmp_path / "o"), "--batch-size", "4", "--min-qscore", "5"])
    failed = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in sorted((tmp_path / "o.fail.fq.gz").glob("part-*.fq.gz"))]
    assert [x for p in failed for x in p[::4]] == [f"@r{k}" for k in range(1, 1000, 2)]
    bound = 1.25 * 40_000 + 2 * 2 * 4000  # and the borders' own rows, a batch of two at most
    assert max(sizes_of(tmp_path / "o.fail.fq.gz", "part-*.fq.gz")) < bound
    batches = {int(p.parent.name[6:]): p for p in (tmp_path / "o.batch").glob("batch=*/*.fq.gz")}
    assert sorted(batches) == list(range(1, 251))
    tasks = {}
    for k, p in batches.items():
        text = gzip.decompress(p.read_bytes()).decode().splitlines()
        assert text[::4] == [f"@r{i}" for i in range(4 * k - 4, 4 * k, 2)]
        tasks[p.name] = tasks.get(p.name, 0) + sum(map(len, text[1::2]))
    assert max(tasks.values()) < bound

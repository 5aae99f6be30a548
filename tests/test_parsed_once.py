"""Commands take their input apart once, however often its rows are used."""

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.sources import bam, files


@pytest.fixture
def seen(spark, monkeypatch):
    """How many rows the readers ``fasta`` and ``sam`` have given."""
    count = spark.sparkContext.accumulator(0)

    def counted(reader):
        def read(*args):
            rows = reader(*args)

            def tally(batches):
                for batch in batches:
                    count.add(batch.num_rows)
                    yield batch

            return rows.mapInArrow(tally, rows.schema)

        return read

    monkeypatch.setattr(files, "fasta", counted(files.fasta))
    monkeypatch.setattr(files, "sam", counted(files.sam))
    return count


def run(spark, *words):
    args = cli.parser().parse_args([str(w) for w in words])
    args.run(spark, args)


def test_genome_commands(spark, tmp_path, seen):
    text = "".join(f">c{k}\n" + ("ACGATCGTTA" * 6 + "\n") * (k + 1) for k in range(7))
    (tmp_path / "g.fa").write_text(text)
    run(spark, "refgenome", "prepare", tmp_path / "g.fa", tmp_path / "own")
    assert seen.value == 7
    assert (tmp_path / "own.chromsizes").read_text() == "".join(f"c{k}\t{60 * (k + 1)}\n" for k in range(7))
    assert (tmp_path / "own.metadata.csv").read_text() == "chrom,length\n" + "".join(f"c{k},{60 * (k + 1)}\n" for k in range(7))
    run(spark, "refgenome", "virtual-digest", tmp_path / "g.fa", "DpnII", tmp_path / "cut")
    assert seen.value == 14
    stats = spark.read.csv(str(tmp_path / "cut.digest_stats.csv"), header=True)
    assert stats.columns[:2] == ["chrom", "num_fragments"] and stats.agg(F.sum(F.col("num_fragments").cast("long"))).first()[0] == spark.read.parquet(str(tmp_path / "cut.fragments.parquet")).count()


def test_alignment_commands(spark, tmp_path, seen):
    lines = [f"r{k // 2}\t0\tc\t{k + 1}\t30\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:{k}" for k in range(10)]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    bam.write(rows, str(tmp_path / "in.bam"), ["@HD\tVN:1.6", "@SQ\tSN:c\tLN:1000"])
    run(spark, "alignments", "reformat-bam", tmp_path / "in.bam", tmp_path / "named.bam")
    assert seen.value == 10
    run(spark, "alignments", "create-table", tmp_path / "named.bam", tmp_path / "table")
    assert seen.value == 20
    table = spark.read.parquet(str(tmp_path / "table"))
    assert {r.align_base_qscore for r in table.collect()} == {40}
    table.select("align_idx", (F.col("align_idx") % 2 == 0).alias("pass_filter")).write.parquet(str(tmp_path / "own"))
    run(spark, "alignments", "filter-bam", tmp_path / "named.bam", tmp_path / "own", tmp_path / "kept.bam")
    assert seen.value == 30


def test_small_packed_files_are_many_splits():
    assert bam.split_of(48 << 20, 12) == (1 << 20) + 1 and bam.split_of(1000, 12) == bam.LEAST and bam.split_of(1 << 40, 12) == bam.SPLIT


def test_documents_with_letters_by_their_text(spark):
    from tesserae.plans import bindings

    sf_dir = "/root/testdata/sf0.001"
    some = bindings.sequences(spark, sf_dir, lettered=True)
    assert "translate" not in next(x for x in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(some) == key(bindings.sequences(spark, sf_dir).where(F.length("seq") > 0)) == key(bindings.sequences(spark, sf_dir, ordered=True, lettered=True))

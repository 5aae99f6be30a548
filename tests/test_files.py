"""File formats, and every command from files to files."""

import gzip
import json

import pytest

from tesserae import cli
from tesserae.sources import files

READS = [("r1", "ACGTAC", "IIIIII"), ("r2", "GGG", "@@I"), ("r3", "TTTTT", "#####")]


def write_fastq(path):
    text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in READS)
    with (gzip.open(path, "wt") if str(path).endswith("gz") else open(path, "w")) as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("name", ["a.fastq", "a.fastq.gz"])
def test_fastq(spark, tmp_path, name):
    rows = files.fastq(spark, write_fastq(tmp_path / name)).orderBy("record_no").collect()
    assert [(r.read_id, r.sequence, r.qual) for r in rows] == READS
    assert rows[1].quals == [31, 31, 40]


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">b one\nACG\nT\n>a\nGATC\n")
    rows = files.fasta(spark, str(tmp_path / "g.fa")).orderBy("chrom_idx").collect()
    assert [tuple(r) for r in rows] == [("b", 0, "ACGT"), ("a", 1, "GATC")]


SAM = "@HD\tVN:1.6\n" + "".join(
    "\t".join(map(str, x)) + "\n"
    for x in [
        ("q1", 0, "c", 11, 60, "2S5M1D2M1S", "*", 0, 0, "ACGTACGTAC", "IIIIIIIIII", "AS:i:7", "HP:i:1", "PS:i:9"),
        ("q2", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*"),
        ("q1", 2064, "c", 101, 30, "9S4M1I1M2H", "*", 0, 0, "ACGTACGTACGTACG", "I" * 15, "AS:i:5"),
    ]
)


def test_alignment_commands(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a])
    (tmp_path / "a.sam").write_text(SAM)
    run("alignments", "reformat-bam", tmp_path / "a.sam", tmp_path / "b.sam", "--set-bx-flag")
    names = [x.split("\t")[0] for x in (tmp_path / "b.sam").read_text().splitlines()]
    assert names == ["@HD", "q1:0:0", "q2:1:1", "q1:0:2"]
    (tmp_path / "tags.txt").write_text("#readname\thaplotype\tphaseset\nq1:0:2\tH2\t77\nq1:0:0\tnone\tnone\n")
    run("alignments", "create-table", tmp_path / "b.sam", tmp_path / "t.parquet", "--alignment-haplotypes", tmp_path / "tags.txt")
    rows = spark.read.parquet(str(tmp_path / "t.parquet")).orderBy("align_idx").collect()
    assert [(r.align_type, r.chrom, r.start, r.end, r.read_length, r.read_start, r.read_end, r.strand, r.align_score, r.haplotype) for r in rows] == [
        ("primary", "c", 10, 18, 10, 2, 9, True, 7, -1),
        ("unmapped", "NULL", 0, 0, 3, 0, 0, True, 0, -1),
        ("supplementary", "c", 100, 105, 17, 9, 15, False, 5, 2),
    ]
    (tmp_path / "g.fa").write_text(">c\n" + "GATCAAAA" * 20 + "\n")
    run("refgenome", "prepare", tmp_path / "g.fa", tmp_path / "g2")
    assert (tmp_path / "g2.chromsizes").read_text() == "c\t160\n"
    with pytest.raises(OSError):
        run("refgenome", "prepare", tmp_path / "g.fa", tmp_path / "g2")
    run("refgenome", "virtual-digest", tmp_path / "g.fa", "GATC", tmp_path / "v", "--digest-type", "regex")
    run("refgenome", "fragments-to-hicref", tmp_path / "v.fragments.parquet", tmp_path / "hic.txt")
    assert (tmp_path / "hic.txt").read_text().startswith("c 8 16 24 ")
    run("alignments", "assign-fragments", tmp_path / "t.parquet", tmp_path / "v.fragments.parquet", tmp_path / "p.parquet", "--min-overlap-length", "1")
    run("alignments", "assign-consensus-haplotype", tmp_path / "p.parquet", tmp_path / "p2.parquet")
    run("alignments", "filter-bam", tmp_path / "b.sam", tmp_path / "p2.parquet", tmp_path / "f.sam", "--clean-read-name")
    assert [x.split("\t")[0] for x in (tmp_path / "f.sam").read_text().splitlines()] == ["@HD", "q1", "q1"]
    run("alignments", "to-contacts", tmp_path / "p2.parquet", tmp_path / "c.parquet")
    run("contacts", "merge", tmp_path / "m.parquet", tmp_path / "c.parquet", tmp_path / "c.parquet")
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 2
    with pytest.raises(OSError, match="nowhere"):
        run("contacts", "merge", tmp_path / "n.parquet", tmp_path / "nowhere")
    run("contacts", "downsample", tmp_path / "c.parquet", tmp_path / "d", "0.01", "--unit", "Kb", "--tolerance", "1.5")
    assert spark.read.parquet(str(tmp_path / "d.0.01Kb.contacts.parquet")).count() == 1
    for kind, out in (("salsa_bed", "x.salsa.bed"), ("pairs", "x.pairs"), ("paired_end_fastq", "x.1.fastq"), ("merged_no_dups", "x.mnd.txt"), ("cooler", "x.cool")):
        run("contacts", "export", tmp_path / "c.parquet", kind, tmp_path / "x", "--chromsizes", tmp_path / "g2.chromsizes", "--fasta", tmp_path / "g.fa", "--fragments", tmp_path / "v.fragments.parquet", "--resolution", "50", "--read-length", "4")
        assert (tmp_path / out).exists()
    assert spark.read.parquet(str(tmp_path / "x.cool/pixels")).collect()[0].asDict() == {"bin1_id": 0, "bin2_id": 2, "count": 1}
    assert len((tmp_path / "x.salsa.bed").read_text().splitlines()) == 2
    with pytest.raises(ValueError, match="fasta"):
        run("contacts", "export", tmp_path / "c.parquet", "merged_no_dups", tmp_path / "y")
    summary = "read_subset,num_sequences,total_bases,mean,min,max,N50,Q25,Q50,Q75\nall,80,240400,3005.0,110,9100,4100,1500.5,2500.0,3600.5\n"
    (tmp_path / "s.csv").write_text(summary)
    run("contacts", "summarize", tmp_path / "c.parquet", tmp_path / "s.csv", tmp_path / "con.parquet", tmp_path / "long.csv", "--user-metadata", json.dumps({"a": "b"}))
    text = (tmp_path / "long.csv").read_text()
    assert "user_metadata,,,a,b" in text and "reads,,count,all,80" in text and "concatemer_order,,count,2,1" in text
    run("utils", "parquet-to-csv", tmp_path / "c.parquet", tmp_path / "c.csv")
    assert (tmp_path / "c.csv").exists()


def test_read_command(spark, tmp_path):
    cli.main(["reads", "prepare", write_fastq(tmp_path / "r.fastq"), str(tmp_path / "o"), "--batch-size", "1", "--min-read-length", "4", "--min-qscore", "5"])
    assert spark.read.parquet(str(tmp_path / "o.read_metadata.parquet")).where("pass_filter").count() == 1
    assert (tmp_path / "o.batch/batch=1").exists() and not (tmp_path / "o.batch/batch=2").exists()
    assert spark.read.text(str(tmp_path / "o.fail.fq.gz")).count() == 8
    assert (tmp_path / "o.summary.csv").read_text().count("\n") == 4
    assert "driver: parquet" in (tmp_path / "o.catalog.yaml").read_text()

"""FASTA files by lines, their index, and ranges of them, against a plain parser."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tesserae.sources import files, genome


def plain(text):
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return [tuple(x) for x in out]


def ragged(rnd):
    """Contigs with lines of any length, headers with > in them, blank lines, and contigs without bases."""
    end = rnd.choice(["\n", "\r\n"])
    out = [] if rnd.random() < 0.7 else ["ACGT", ""]
    for i in range(rnd.randrange(1, 12)):
        out.append(f">chr{i} len={i} A>G variant")
        out += ["".join(rnd.choice("ACGTacgtN") for _ in range(rnd.randrange(90))) for _ in range(rnd.choice([0, 1, 5, 60]))]
    return end.join(out) + rnd.choice(["", end])


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_a_plain_parser(spark, tmp_path, seed):
    text = ragged(random.Random(seed))
    path = tmp_path / "g.fa"
    path.write_text(text, newline="")
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(text.encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, name in ((700, "g.fa"), (1 << 27, "g.fa"), (700, "g.fa.gz")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = files.fasta(spark, str(tmp_path / name)).orderBy("chrom_idx").collect()
            assert [r.chrom_idx for r in rows] == list(range(len(rows))) and [(r.chrom, r.seq) for r in rows] == plain(text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_pieces_have_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 100)
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(2000))
    (tmp_path / "g.fa").write_text(">a\n" + "\n".join(seq[i : i + 60] for i in range(0, 2000, 60)) + "\n>b x\n>c\nACG\n")
    rows = files.fasta_pieces(spark, str(tmp_path / "g.fa")).orderBy("chrom_idx", "at").collect()
    assert all(seq[r["at"] : r["at"] + len(r.seq)] == r.seq for r in rows if r.chrom == "a") and "".join(r.seq for r in rows if r.chrom == "a") == seq
    assert [(r.chrom, r["at"], r.seq) for r in rows if r.chrom != "a"] == [("b", 0, ""), ("c", 0, "ACG")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [7, 60, 10_000])
def test_ranges_by_index(spark, tmp_path, end, width, monkeypatch):
    rnd = random.Random(width)
    contigs = {f"c{i}": "".join(rnd.choice("ACGTN") for _ in range(rnd.choice([1, 59, 60, 61, 700, 3001]))) for i in range(9)}
    text = "".join(f">{n} of x > y{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in contigs.items()) + f">none{end}"
    (tmp_path / "g.fa").write_bytes(text.encode())
    monkeypatch.setattr(genome, "BLOCK", 512)
    for split in (97, 1 << 20):
        own = {r.name: r for r in genome.index(spark, str(tmp_path / "g.fa"), split=split).collect()}
        assert {n: r.length for n, r in own.items()} == {**{n: len(s) for n, s in contigs.items()}, "none": 0}
        assert all(text.encode()[own[n].offset : own[n].offset + 1].decode() == s[0] for n, s in contigs.items())
    asked = [(n, at, rnd.choice(list(contigs)), rnd.randrange(3000)) for n in contigs for at in (0, 5, 58, 650, 2990, 9000)] * 3
    rows = spark.createDataFrame(asked, "x string, p long, y string, q long").repartition(3)
    found = genome.fetch(rows, genome.Indexed(genome.index(spark, str(tmp_path / "g.fa"), split=300)), {"s": ("x", F.col("p"), 50), "t": ("y", F.col("q"), 11)}).collect()
    assert len(found) == len(asked)
    assert all(r.s == contigs[r.x][r.p : r.p + 50] and r.t == contigs[r.y][r.q : r.q + 11] for r in found)
    # the index that other tools leave beside a file is taken as it is
    (tmp_path / "g.fa.fai").write_text("".join(f"{r.name}\t{r.length}\t{r.offset}\t{r.line_bases}\t{r.line_width}\n" for r in own.values()))
    assert sorted(genome.genome(spark, str(tmp_path / "g.fa")).index.select("name", "offset").collect()) == sorted((r.name, r.offset) for r in own.values())


def test_lines_of_different_lengths_and_unknown_names_are_errors(spark, tmp_path):
    for lines in (["ACG", "AC", "ACG"], ["ACG", "AC", "ACGT", "A"], ["AC", "ACG"]):
        (tmp_path / "g.fa").write_text(">a\n" + "\n".join(lines) + "\n")
        with pytest.raises(Exception, match="lines of different lengths in a"):
            genome.index(spark, str(tmp_path / "g.fa")).collect()
    found = genome.stored(spark.createDataFrame([("a", "ACGT"), ("b", "")], "chrom string, seq string"))
    asked = spark.createDataFrame([("a", 1), ("b", 0), ("z", 1)], "x string, p long")
    assert [r.s for r in genome.fetch(asked.where("x < 'z'"), found, {"s": ("x", F.col("p"), 9)}).orderBy("x").collect()] == ["CGT", ""]
    with pytest.raises(Exception, match="chromosome not in the genome: z"):
        genome.fetch(asked, found, {"s": ("x", F.col("p"), 9)}).collect()

"""Block gzip text: split, written by tasks, indexed; FASTQ through it and as a stream."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.sources import bam, bgzf, files


def packed(text, sizes):
    """Block gzip of a text, with members of the given sizes in turn."""
    out, at, k = b"", 0, 0
    data = text.encode()
    while at < len(data):
        out += bam.member_of(data[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
    return out + bam.LAST_MEMBER


@pytest.mark.parametrize("seed", range(4))
def test_lines_of_splits(tmp_path, seed):
    rnd = random.Random(seed)
    for case in range(5):
        lines = ["x" * rnd.choice([0, 1, 5, 40]) + str(i) * (rnd.random() < 0.8) for i in range(rnd.randrange(1, 25))]
        text = "\n".join(lines) + rnd.choice(["", "\n"])
        expected = text.removesuffix("\n").split("\n") if text else []
        path = tmp_path / f"{seed}-{case}.gz"
        # members that end at a line's end, in it, and after one byte
        path.write_bytes(packed(text, rnd.choice([[1, 3], [7, 1], [20], [100], [2, 90]])))
        assert gzip.decompress(path.read_bytes()).decode() == text
        for split in (150, 1000, 1 << 20):
            reader = bgzf.BgzfReader({"paths": str(path), "split": split})
            assert [x for p in reader.partitions() for b in reader.read(p) for x in b.column("value").to_pylist()] == expected


def fastq_text(n, seed=0, sizes=(0, 1, 50, 400)):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice(sizes)
        out.append(f"@r{seed}_{i} x\n{''.join(rnd.choice('ACGT') for _ in range(size))}\n+\n{''.join(rnd.choice('@+IF5') for _ in range(size))}\n")
    return "".join(out)


def test_written_parts_are_split_and_read_back(spark, tmp_path, monkeypatch):
    text = fastq_text(3000)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "i long, value string").repartition(3).sort("i").coalesce(2)
    bgzf.write(rows, str(tmp_path / "out"), ".fq.gz")
    parts = sorted((tmp_path / "out").glob("*.fq.gz"))
    assert parts and not (tmp_path / "out" / bgzf.ATTEMPTS).exists() and "".join(gzip.decompress(p.read_bytes()).decode() for p in parts) == text
    for p in parts:  # the index points at members
        raw, entries = p.read_bytes(), (tmp_path / "out" / f"{p.name}.gzi").read_bytes()
        n = struct.unpack_from("<Q", entries)[0]
        assert n >= 1 and len(entries) == 8 + 16 * n
        for k in range(n):
            place, plain = struct.unpack_from("<QQ", entries, 8 + 16 * k)
            size = bam.member_size(raw[place : place + 64])
            own = zlib.decompress(raw[place + 18 : place + size - 8], wbits=-15)
            assert own and gzip.decompress(raw)[plain : plain + len(own)] == own
    monkeypatch.setattr(bgzf.lines, "__defaults__", (20_000,))
    found = files.fastq(spark, str(tmp_path / "out"))
    (tmp_path / "plain.fq").write_text(text)
    plain = files.fastq(spark, str(tmp_path / "plain.fq"))
    key = lambda df: [tuple(r) for r in df.orderBy("record_no").collect()]
    assert len(bgzf.BgzfReader({"paths": "\n".join(map(str, parts)), "split": 20_000}).partitions()) > 4
    assert key(found.select("record_no", "read_id", "sequence", "qual")) == key(plain.select("record_no", "read_id", "sequence", "qual"))


def test_reads_prepare_writes_block_gzip(spark, tmp_path):
    (tmp_path / "r.fq").write_text(fastq_text(90, 3, (1, 50, 400)))
    cli.main(["reads", "prepare", str(tmp_path / "r.fq"), str(tmp_path / "o"), "--batch-size", "40", "--min-read-length", "40"])
    source = {r.read_id: r for r in files.fastq(spark, str(tmp_path / "r.fq")).collect()}
    batches = sorted((tmp_path / "o.batch").glob("batch=*/*.fq.gz"))
    assert {p.parent.name for p in batches} == {"batch=1", "batch=2", "batch=3"} and all(bam.is_bam(str(p)) and (p.parent / f"{p.name}.gzi").exists() for p in batches)
    passed = [r for p in batches for r in files.fastq(spark, str(p)).orderBy("record_no").collect()]
    failed = files.fastq(spark, str(tmp_path / "o.fail.fq.gz")).collect()
    assert (tmp_path / "o.fail.fq.gz").is_file() and bam.is_bam(str(tmp_path / "o.fail.fq.gz"))
    assert all(len(r.sequence) >= 40 for r in passed) and all(len(r.sequence) < 40 for r in failed) and len(passed) + len(failed) == 90
    assert all((source[r.read_id].sequence, source[r.read_id].qual) == (r.sequence, r.qual) for r in [*passed, *failed])
    assert [int(r.read_id.split("_")[1]) for r in passed] == sorted(int(r.read_id.split("_")[1]) for r in passed)


def test_an_attempt_that_fails_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string")
    rows = spark.range(0, 1000, 1, 2).select(bad.alias("value"))
    with pytest.raises(Exception, match="lost"):
        bgzf.write(rows, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    bgzf.write(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert bgzf.found([str(tmp_path / "none")]) == []


def test_batches_are_bounded_by_letters_and_small_files_share_a_task(tmp_path):
    long = tmp_path / "long.gz"
    long.write_bytes(packed("".join("ACGT" * 25_000 + "\n" for _ in range(60)), [60_000]))
    reader = bgzf.BgzfReader({"paths": str(long)})
    sizes = [sum(map(len, b.column("value").to_pylist())) for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 6_000_000 and max(sizes) <= bgzf.HELD + 100_000
    names = []
    for k in range(600):
        names.append(str(tmp_path / f"{k:03d}.gz"))
        (tmp_path / f"{k:03d}.gz").write_bytes(packed(f"line {k}\n", [20]))
    reader = bgzf.BgzfReader({"paths": "\n".join(names)})
    assert len(reader.partitions()) == 3
    assert [x for p in reader.partitions() for b in reader.read(p) for x in b.column("value").to_pylist()] == [f"line {k}" for k in range(600)]


def test_mean_quality_of_texts_and_of_scores(spark):
    from tesserae.functions import scalars

    rnd = random.Random(1)
    texts = ["".join(chr(33 + rnd.randrange(60)) for _ in range(rnd.choice([1, 7, 300]))) for _ in range(50)] + ["IIII", None]
    rows = spark.createDataFrame([(x,) for x in texts], "qual string").select("qual", files.quality_scores(F.col("qual")).alias("quals"))
    for r in rows.select("qual", scalars.text_qscore(F.col("qual")).alias("a"), scalars.mean_qscore(F.col("quals")).alias("b")).where("qual is not null").collect():
        assert r.a == pytest.approx(r.b, rel=1e-12, abs=1e-12)
    assert rows.where("qual is null").select(scalars.text_qscore(F.col("qual"))).first()[0] is None

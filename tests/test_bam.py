"""BAM files written and read back, whole and in splits, and by the commands."""

import io
import random
import re
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import Row

from tesserae import cli
from tesserae.sources import bam, files

HEAD = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100000", "@SQ\tSN:chr2\tLN:5000"]


def sam_lines(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 7, 300, 301]) if i % 97 else 90_000  # longer than a member
        seq = "".join(rnd.choice("ACGTN") for _ in range(size)) or "*"
        qual = "".join(chr(33 + rnd.randrange(60)) for _ in range(size)) or "*"
        mapped = size > 3 and i % 5 > 0
        more = ["AS:i:-7", "HP:i:1", "XA:A:x", "XF:f:1.5", "XZ:Z:a b:c", "XB:B:S,1,65535", "XC:B:f,0.5"][: i % 8]
        fields = [f"read{i}:é".replace("é", "e"), 0 if mapped else 4, rnd.choice(["chr1", "chr2"]) if mapped else "*", 11 + i % 4000 if mapped else 0, i % 61, f"2S{size - 3}M1S" if mapped else "*", "=" if mapped and i % 3 == 0 else "*", 5 if mapped and i % 3 == 0 else 0, 0, seq, qual if i % 11 else "*", *more]
        out.append("\t".join(map(str, fields)))
    return out


@pytest.mark.parametrize("split", [1 << 16, 200_000, 1 << 25])
def test_round_trip_in_splits(spark, tmp_path, split):
    lines, path = sam_lines(1500), str(tmp_path / "a.bam")
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").repartition(3)
    bam.write(rows, path, HEAD)
    assert bam.is_bam(path) and bam.header_lines(path) == HEAD
    found = bam.lines(spark, path, split)
    if split < 1 << 20:
        assert found.rdd.getNumPartitions() > 5
    assert [r.value for r in found.orderBy("line_no").collect()] == lines
    assert found.select("line_no").distinct().count() == len(lines)


def test_one_record_and_none(spark, tmp_path):
    for n in (0, 1):
        rows = spark.createDataFrame(list(enumerate(sam_lines(n, 5))), "line_no long, value string")
        bam.write(rows, str(tmp_path / f"{n}.bam"), HEAD)
        assert bam.lines(spark, str(tmp_path / f"{n}.bam")).count() == n
    (tmp_path / "x.bam").write_bytes(bam.member_of(b"no" + struct.pack("<i", 1) * 9) + bam.LAST_MEMBER)
    with pytest.raises(ValueError, match="not a BAM"):
        bam.header.__wrapped__(str(tmp_path / "x.bam"))


def test_commands_read_and_write_bam(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a])
    lines = [x for x in sam_lines(60, 3) if "\t90" not in x]
    (tmp_path / "a.sam").write_text("".join(x + "\n" for x in [*HEAD, *lines]))
    run("alignments", "reformat-bam", tmp_path / "a.sam", tmp_path / "b.bam")
    run("alignments", "reformat-bam", tmp_path / "a.sam", tmp_path / "b.sam")
    run("alignments", "reformat-bam", tmp_path / "b.bam", tmp_path / "c.out", "--input-is-bam", "--output-is-bam")
    assert bam.is_bam(str(tmp_path / "c.out"))
    as_text, as_bam = (files.sam(spark, str(tmp_path / x)).orderBy("line_no").drop("line_no").collect() for x in ("b.sam", "b.bam"))
    assert as_text == as_bam and as_text[3].qname.endswith(":3:3")
    with pytest.raises(ValueError, match="not a BAM"):
        run("alignments", "reformat-bam", tmp_path / "a.sam", tmp_path / "d", "--input-is-bam")


def long_lines(sizes, seed=2):
    rnd = np.random.default_rng(seed)
    out = []
    for i, size in enumerate(sizes):
        seq = rnd.choice(np.frombuffer(b"ACGT", dtype=np.uint8), size).tobytes().decode()
        # qualities hold every byte, so what looks like the start of a record is in them, too
        qual = (33 + rnd.integers(0, 94, size).astype(np.uint8)).tobytes().decode()
        fields = [f"r{i}", 0, "chr1", 11, 60, f"{size}M", "*", 0, 0, seq, qual, f"AS:i:{size}", *(["ZZ:Z:" + "x" * (i % 300)] if i % 2 else [])]
        out.append("\t".join(map(str, fields)))
    return out


def test_reads_of_megabases_in_splits_of_any_size(spark, tmp_path):
    sizes = [200] * 150 + [1_000_000] + [150] * 150 + [4_000_000, 100] + [300_000] * 3 + [120] * 200
    lines, path = long_lines(sizes), str(tmp_path / "long.bam")
    bam.write(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string").repartition(2), path, HEAD)
    names = [x.split("\t")[0] for x in lines]
    expected = [(x, len(y), hash(y)) for x, y in zip(names, lines, strict=True)]
    places = None
    for split in (70_000, 400_000, 600_000, 700_000, 3_000_000, 1 << 25):
        own = []
        reader = bam.BamReader({"path": path, "split": split})
        for part in reader.partitions():
            for batch in reader.read(part):
                own += [(p, v.split("\t")[0], len(v), hash(v)) for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        assert [r[1:] for r in own] == expected, split
        places = places or [r[0] for r in own]
        assert places == [r[0] for r in own] == sorted(set(places))
    assert bam.lines(spark, path, 600_000).count() == len(lines)


def test_records_inside_records_are_not_taken(tmp_path):
    """A record whose tag holds the bytes of other records is one record, wherever a split begins."""
    refs = {"chr1": 0}
    inner = bam.record_of("in\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGT\tIIII", refs)
    fake = ",".join(str(b) for b in inner * 3 + b"\1" * 500)
    lines = [f"a{i}\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGT\tIIII\tXX:B:C,{fake}" for i in range(400)]
    head = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + b"".join(bam.record_of(x, refs) for x in lines)
    path = tmp_path / "a.bam"
    path.write_bytes(b"".join(bam.member_of(data[i : i + 5000]) for i in range(0, len(data), 5000)) + bam.LAST_MEMBER)
    for split in (700, 3000, 1 << 20):
        reader = bam.BamReader({"path": str(path), "split": split})
        found = [v for p in reader.partitions() for b in reader.read(p) for v in b.column(1).to_pylist()]
        assert found == lines


def test_operations_beyond_sixteen_bits(spark, tmp_path):
    cigar = "5S" + "".join("1M1I1M2D" for _ in range(20_000)) + "7S"
    size = 5 + 3 * 20_000 + 7
    assert len(re.findall("[A-Z]", cigar)) > 80_000
    lines = [f"r{i}\t0\tchr1\t101\t60\t{c}\t*\t0\t0\t{'ACGTN' * (n // 5)}{'A' * (n % 5)}\t*\tAS:i:5\tXZ:Z:q" for i, (c, n) in enumerate([("3M", 3), (cigar, size), ("10M", 10)])]
    path = str(tmp_path / "cg.bam")
    bam.write(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), path, HEAD)
    assert [r.value for r in bam.lines(spark, path).orderBy("line_no").collect()] == lines
    raw = bam.record_of(lines[1], {"chr1": 0, "chr2": 1})
    assert struct.unpack_from("<H", raw, 16)[0] == 2 and b"CGBI" in raw
    found = files.sam(spark, path).where("qname = 'r1'").first()
    assert (found.start, found.end, found.read_length, found.read_start, found.read_end) == (100, 100 + 80_000, size, 5, size - 7)


def test_only_accepted_attempts_become_parts(tmp_path, monkeypatch):
    import pyspark

    class Context:
        def __init__(self, part, attempt):
            self.part, self.attempt = part, attempt

        def partitionId(self):  # noqa: N802
            return self.part

        def taskAttemptId(self):  # noqa: N802
            return self.attempt

    folder = tmp_path / "out"
    writer = bam.BamWriter({"path": str(folder), "refs": "chr1"})
    row = lambda name: Row(value=f"{name}\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGT\tIIII")

    def attempt(part, number, rows):
        monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Context(part, number)))
        return writer.write(rows)

    def lost():
        yield row("lost")
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        attempt(0, 1, lost())
    twice = attempt(1, 3, iter([row("b")]))  # a speculative copy that is not accepted
    messages = [attempt(0, 2, iter([row("a")])), attempt(1, 4, iter([row("b")])), None]
    assert not list(folder.glob("part-*")) and twice.part == messages[1].part
    writer.commit(messages)
    assert sorted(p.name for p in folder.iterdir()) == ["part-00000000", "part-00000001"]
    attempt(2, 5, iter([row("c")]))
    writer.abort([None])
    assert sorted(p.name for p in folder.iterdir()) == ["part-00000000", "part-00000001"]


def test_parts_follow_their_numbers():
    from tesserae.operators.metadata import part_number

    names = ["part-100000-x", "part-99999-x", "part-header", "part-last", "part-00002-x", "_SUCCESS"]
    assert sorted((n for n in names if n.startswith("part-")), key=part_number) == ["part-header", "part-00002-x", "part-99999-x", "part-100000-x", "part-last"]


def test_standard_input_and_output(spark, tmp_path, monkeypatch):
    lines = [x for i, x in enumerate(sam_lines(99, 8)) if i % 11 and i % 8]
    text = "".join(x + "\n" for x in [*HEAD, *lines]).encode()

    def run(data, *args):
        out = io.TextIOWrapper(io.BytesIO())
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(data)))
        monkeypatch.setattr(sys, "stdout", out)
        cli.main([str(x) for x in args])
        return out.buffer.getvalue()

    packed = run(text, "alignments", "reformat-bam", "-", "-", "--output-is-bam")
    (tmp_path / "a.bam").write_bytes(packed)
    assert bam.is_bam(str(tmp_path / "a.bam")) and bam.lines(spark, str(tmp_path / "a.bam")).count() == len(lines)
    plain = run(packed, "alignments", "reformat-bam", "-", "-", "--input-is-bam").decode().splitlines()
    assert plain[: len(HEAD)] == HEAD and [x.split("\t")[1:] for x in plain[len(HEAD) :]] == [x.split("\t")[1:] for x in lines]
    run(packed, "alignments", "create-table", "-", tmp_path / "t.parquet")
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == len(lines)

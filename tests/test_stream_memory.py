"""A batch of a stream is taken apart once and kept on storage, not in executors; what Python holds of it is bounded by letters."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import reads
from tesserae.sources.bam import opened
from tesserae.streaming import fastq
from tesserae.streaming import reads as streams

BOUNDS = {"min_read_length": 5, "max_read_length": 40, "min_qscore": 2, "max_qscore": 50}


def text_of(lengths):
    return "".join(f"@r{k} x\n{'ACGT' * n}"[: len(f"@r{k} x\n") + n] + f"\n+\n{'I' * n}\n" for k, n in enumerate(lengths))


def run(spark, tmp_path, lengths, own=lambda x: x, left_out=()):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(text_of(lengths))
    records = own(reads.read_metadata(fastq.fastq_stream(spark, str(tmp_path / "in")).drop(*left_out), **BOUNDS))
    streams.prepare(records, str(tmp_path / "out"), str(tmp_path / "check"), **BOUNDS).awaitTermination()
    found = {x: {r.read_id: r for r in spark.read.parquet(str(tmp_path / "out" / x)).drop("batch").collect()} for x in ("read_metadata", "pass", "fail")}
    assert set(found["pass"]) | set(found["fail"]) == set(found["read_metadata"]) == {f"r{k}" for k in range(len(lengths))} and not set(found["pass"]) & set(found["fail"])
    assert found["pass"].keys() == {k for k, r in found["read_metadata"].items() if r.pass_filter}
    for k, n in enumerate(lengths):
        r = (found["pass"] | found["fail"])[f"r{k}"]
        assert r.sequence == ("ACGT" * n)[:n] and r.qual == "I" * n and found["read_metadata"][f"r{k}"].read_length == n
    return found


def test_batches_of_long_reads_are_bounded_by_letters(tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "HELD", 10_000, raising=False)
    (tmp_path / "a.fq").write_text(text_of([2000] * 300 + [10] * 100))
    store, own = opened(str(tmp_path))
    reader = fastq.FastqStreamReader({"path": str(tmp_path)})
    size = store.get_file_info(f"{own}/a.fq").size
    batches = list(reader.read(type("Split", (), {"value": (str(tmp_path / "a.fq"), 0, size)})()))
    assert [x for b in batches for x in b.column("read_id").to_pylist()] == [f"r{k}" for k in range(400)]
    assert max(sum(len(x) for c in ("sequence", "qual") for x in b.column(c).to_pylist()) for b in batches) < 10_000 + 2 * 2000


def test_batch_is_kept_on_storage_and_parsed_once(spark, tmp_path, monkeypatch):
    count, seen = spark.sparkContext.accumulator(0), []

    def tally(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    def looked_at(flagged):
        seen.append((flagged.storageLevel.useMemory, spark.sparkContext._jsc.getPersistentRDDs().size(), set(flagged.columns)))
        return reads.metadata_columns(flagged)

    monkeypatch.setattr(streams, "metadata_columns", looked_at)
    run(spark, tmp_path, [k % 60 + 1 for k in range(200)], lambda x: x.mapInArrow(tally, x.schema))
    assert count.value == 200
    assert seen == [(False, 0, {"read_id", "sequence", "qual", "read_length", "qscore", "pass_filter"})]
    assert not (tmp_path / "out" / "_kept").exists()


def test_reads_without_letters_fail(spark, tmp_path):
    found = run(spark, tmp_path, [8, 0, 4, 0, 30, 50], left_out=["quals"])
    assert set(found["pass"]) == {"r0", "r4"} and found["read_metadata"]["r1"].qscore is None and found["read_metadata"]["r1"].pass_filter is False


def test_qualities_need_no_array(spark):
    rows = spark.createDataFrame([("a", "ACGTACGT", "IIII++++"), ("b", "", "")], "read_id string, sequence string, qual string")
    own = reads.read_metadata(rows, **BOUNDS)
    assert "transform(" not in own._jdf.queryExecution().optimizedPlan().toString()
    a, b = own.orderBy("read_id").collect()
    with_array = reads.read_metadata(rows.where("read_id = 'a'").withColumn("quals", F.transform(F.split("qual", ""), lambda c: (F.ascii(c) - 33).cast("short"))), **BOUNDS).first()
    assert a.qscore == pytest.approx(with_array.qscore) and a.pass_filter == with_array.pass_filter and b.qscore is None

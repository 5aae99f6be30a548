"""FASTQ files as a stream: splits, batches, and a restart, against the batch reader."""

import gzip
import random
import time

import pytest

from tesserae.sources import files
from tesserae.streaming import fastq
from tests.test_bgzf import fastq_text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_record_is_in_one_split(tmp_path, end):
    text = fastq_text(300, 4).replace("\n", end)
    for cut in (0, len(end)):  # with and without the last line's end
        (tmp_path / "a.fq").write_text(text[: len(text) - cut], newline="")
        plain = text.replace(end, "\n").split("\n")
        expected = [(plain[i][1:].split()[0], plain[i + 1], plain[i + 3]) for i in range(0, len(plain) - 3, 4)]
        size = (tmp_path / "a.fq").stat().st_size
        for split in (50, 333, 4096, 1 << 20):
            found = []
            for at in range(0, size, split):
                with (tmp_path / "a.fq").open("rb") as f:
                    found += list(fastq.records(f, at, min(at + split, size)))
            assert found == expected


def test_stream_in_batches_with_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(k):
        text = fastq_text(40, k, (1, 50, 400))
        if k % 2:
            (tmp_path / f"{k}.gz").write_bytes(gzip.compress(text.encode()))
            (tmp_path / f"{k}.gz").rename(folder / f"{k}.fq.gz")
        else:
            (tmp_path / f"{k}").write_text(text)
            (tmp_path / f"{k}").rename(folder / f"{k}.fq")
        time.sleep(0.02)

    def run(*arriving):
        query = fastq.fastq_stream(spark, str(folder), split=5000).select("read_id", "sequence", "qual").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            for ks in arriving:
                for k in ks:
                    arrive(k)
                query.processAllAvailable()
            return [p.batchId for p in query.recentProgress if p.numInputRows]
        finally:
            query.stop()

    assert len(run([0, 1], [2], [3, 4])) >= 3
    arrive(5)
    assert len(run([], [6, 7])) >= 2
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted((r.read_id, r.sequence, r.qual) for k in range(8) for r in files.fastq(spark, str(folder / f"{k}.fq{'.gz' * (k % 2)}")).collect())
    assert found == batch and len(found) == 320


def test_no_files(spark, tmp_path):
    reader = fastq.FastqStreamReader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    with pytest.raises(ValueError, match="no FASTQ record"):
        (tmp_path / "x").write_bytes(b"ACG\nx\n+\ny\n" * random.randint(1, 3))
        with (tmp_path / "x").open("rb") as f:
            list(fastq.records(f, 0, None))

"""FASTQ files of a folder as a stream, with places in the folder as offsets.

A file counts from when it is there; it is to arrive whole, as with Spark's own file sources, and later than those before it. Files are taken in the
order of their time of change, then name, and an offset is the last file taken, so a restarted query goes on after it. A batch takes what has come since the
one before; plain files are read by splits of bytes, compressed ones a file by a task. A record belongs to the split in which its header begins: a line is a header if it begins
with ``@`` and the line after the next one with ``+``, which no line of a sequence does.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tesserae.sources.bam import opened
from tesserae.sources.files import quality_scores

#: Bytes of a split; the most rows of a batch, and its letters, about.
SPLIT, ROWS, HELD = 64 << 20, 2000, 1 << 20
NAMES = ["read_id", "sequence", "qual"]
_BEGIN = {"time": -1, "name": ""}


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) from byte ``at`` on."""
    held = b""
    while data := f.read(1 << 20):
        parts = (held + data).split(b"\n")
        held = parts.pop()
        for line in parts:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if held:
        yield at, held.rstrip(b"\r")


def records(f, start: int, end: int | None) -> Iterator[tuple[str, str, str]]:
    """(read_id, sequence, qual) of the records whose header begins in start..end."""
    if start:
        f.seek(start - 1)
    lines = _lines(f, max(0, start - 1))
    if start:
        next(lines, None)  # the line that lies across the start; it is empty if one begins there
    window: list[tuple[int, bytes]] = []
    inside = not start
    for line in lines:
        window.append(line)
        if len(window) < (4 if inside else 3):
            continue
        if not inside:
            if not (window[0][1].startswith(b"@") and window[2][1].startswith(b"+")):
                window.pop(0)
                continue
            inside = True
            continue
        if end is not None and window[0][0] >= end:
            return
        head = window[0][1]
        if not head.startswith(b"@"):
            raise ValueError(f"no FASTQ record at byte {window[0][0]}")
        name = head[1:].decode().split()
        yield name[0] if name else "", window[1][1].decode(), window[3][1].decode()
        window = []
    # the last record's quality may be an empty line without an end
    if len(window) == 3 and window[0][1].startswith(b"@") and not window[1][1] and (end is None or window[0][0] < end):
        name = window[0][1][1:].decode().split()
        yield name[0] if name else "", "", ""


class FastqStream(DataSource):
    """``spark.readStream.format("fastq_files")`` of a folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "fastq_files"

    def schema(self) -> str:
        return "read_id string, sequence string, qual string"

    def streamReader(self, schema) -> FastqStreamReader:  # noqa: N802
        return FastqStreamReader(self.options)


class FastqStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.seen = (_BEGIN["time"], _BEGIN["name"])

    def _files(self, after: dict) -> list[tuple[int, str, int]]:
        """(time, name, size) of the files after an offset."""
        store, own = opened(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(own, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        files = sorted((x.mtime_ns, x.base_name, x.size) for x in found)
        return [x for x in files if x[:2] > (after["time"], after["name"])]

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(_BEGIN)

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = max([self.seen, *(x[:2] for x in self._files(_BEGIN))])  # never backwards, though files may go
        return {"time": self.seen[0], "name": self.seen[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        last = end["time"], end["name"]
        out = []
        for time, name, size in self._files(start):
            if (time, name) <= last and size:
                path = f"{self.path.rstrip('/')}/{name}"
                cuts = [0] if name.endswith(".gz") else range(0, size, self.split)
                out += [InputPartition((path, at, None if name.endswith(".gz") else min(at + self.split, size))) for at in cuts]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        store, own = opened(path)
        with store.open_input_file(own) as raw:
            f = gzip.GzipFile(fileobj=raw) if own.endswith(".gz") else raw
            held, size = [], 0
            for r in records(f, start, end):
                held.append(r)
                size += len(r[1]) + len(r[2])
                if size >= HELD or len(held) == ROWS:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], NAMES)


def fastq_stream(spark: SparkSession, folder: str, *, split: int = SPLIT) -> DataFrame:
    """A stream of reads (read_id, sequence, qual, quals) from the FASTQ files that are in a folder and those that come."""
    spark.dataSource.register(FastqStream)
    stream = spark.readStream.format("fastq_files").option("split", split).load(folder)
    return stream.select(*NAMES, quality_scores(stream["qual"]).alias("quals"))

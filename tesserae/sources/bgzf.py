"""Text in block gzip: files that any gzip reader reads, and that tasks read and write in parts.

A file is a row of gzip members of at most 64 KB (see ``bam``). A split begins at a member and reads the lines that begin after its first line's end,
and the one that begins where it ends, as line readers do. A part has an index beside it, the places of its members before and after
compression, in the usual binary form.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tesserae.sources.bam import ATTEMPTS, LAST_MEMBER, MEMBER, first_member, is_bam, member_of, members, opened

#: Packed bytes of a split, and of the small files that one task reads; the most files of a task; letters of a batch of rows, about.
SPLIT, FILES, HELD = 8 << 20, 256, 1 << 20
#: Rows that Spark hands to a writing task at a time; of reads these are a few MB.
WRITTEN = 500
#: What a reader gives: lines, the number and outermost lines of each split, or FASTQ records of four lines that lie in one split.
SHAPES = {
    "lines": "file string, block long, value string",
    "edges": "file string, block long, n long, head array<string>, tail array<string>",
    "records": "record_no long, l0 string, l1 string, l3 string",
}
_EDGES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])
_RECORDS = pa.schema([("record_no", pa.int64()), ("l0", pa.string()), ("l1", pa.string()), ("l3", pa.string())])


def lines_of(f, start: int, end: int, size: int) -> Iterator[str]:
    """The lines of a split, without their ends."""
    at = first_member(f, start, size) if start else 0
    if at >= end:
        return
    held, skip = b"", start > 0
    for member, content in members(f, at, size):
        # a line that begins in this split ends here, or one begins where the split ends, which is its own still
        parts = (held + content).split(b"\n")
        held = parts.pop()
        for line in parts[: 1 if member >= end else None]:
            if not skip:
                yield line.rstrip(b"\r").decode()
            skip = False
        if member >= end and parts:
            return
    if held and not skip:
        yield held.rstrip(b"\r").decode()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _line_batches(lines: Iterator[str], path: str, start: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size >= HELD or len(held) == 10_000:
            yield _batch(path, start, held)
            held, size = [], 0
    if held:
        yield _batch(path, start, held)


def _edges(lines: Iterator[str], path: str, start: int) -> Iterator[tuple]:
    """The number of a split's lines, its first three and its last three."""
    n, head, tail = 0, [], deque(maxlen=3)
    for line in lines:
        n += 1
        if n <= 3:
            head.append(line)
        tail.append(line)
    if n:
        yield path, start, n, head, list(tail)


def _record_batches(lines: Iterator[str], base: int, first: int) -> Iterator[pa.RecordBatch]:
    """Records whose four lines lie in a split that begins with line ``base`` of its file; the file's first record is number ``first``."""
    out, size, held = [], 0, []
    for line, value in enumerate(lines, base):
        if line % 4 == 0:
            held = []
        held.append(value)
        if line % 4 == 3 and len(held) == 4:
            out.append((first + line // 4, held[0], held[1], held[3]))
            size += len(held[1]) + len(held[3])
            if size >= HELD or len(out) == 10_000:
                yield _rows(out, _RECORDS)
                out, size = [], 0
    if out:
        yield _rows(out, _RECORDS)


class BgzfSource(DataSource):
    """``format("bgzf")``: reads ``paths`` in one of SHAPES; writes ``value``, a file for each task or for each ``batch`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return SHAPES[self.options.get("shape", "lines")]

    def reader(self, schema) -> BgzfReader:
        return BgzfReader(self.options)

    def writer(self, schema, overwrite: bool) -> BgzfWriter:
        return BgzfWriter(self.options, "batch" in schema.names)


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split = options["paths"].split("\n"), int(options.get("split", SPLIT))
        self.shape, self.places = options.get("shape", "lines"), options.get("places")

    def partitions(self) -> list[InputPartition]:
        """Splits of large files; small files lie together in one partition."""
        known = {}
        if self.places:  # a row for each split, as there are here
            store, own = opened(self.places)
            for r in ds.dataset(own, filesystem=store, format="parquet").to_table().to_pylist():
                known[r["file"], r["block"]] = r["base"], r["first"]
        out, held, packed = [], [], 0
        for path in self.paths:
            store, own = opened(path)
            size = store.get_file_info(own).size
            for at in range(0, size, self.split):
                n = min(at + self.split, size) - at
                if held and (packed + n > self.split or len(held) == FILES):
                    out.append(InputPartition(held))
                    held, packed = [], 0
                held.append((path, at, at + n, size, known.get((path, at))))
                packed += n
        return [*out, InputPartition(held)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        edges: list[tuple] = []
        for path, start, end, size, place in partition.value:
            store, own = opened(path)
            with store.open_input_file(own) as f:
                lines = lines_of(f, start, end, size)
                if self.shape == "lines":
                    yield from _line_batches(lines, path, start)
                elif self.shape == "edges":
                    edges += _edges(lines, path, start)
                elif place:
                    yield from _record_batches(lines, *place)
        if edges:
            yield _rows(edges, _EDGES)


def _batch(path: str, start: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(held, pa.string())], ["file", "block", "value"])


@dataclass
class Moves(WriterCommitMessage):
    """(file of an attempt, its place) of what a task has written."""

    files: list[tuple[str, str]]


class _Part:
    """One file being written, and its index."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.store, self.path, self.out = store, path, store.open_output_stream(path, compression=None)
        self.held, self.places, self.packed, self.plain = bytearray(), [], 0, 0

    def add(self, data: bytes) -> None:
        self.held += data
        at = 0
        while len(self.held) - at >= MEMBER:
            self._member(bytes(self.held[at : at + MEMBER]))
            at += MEMBER
        del self.held[:at]

    def _member(self, data: bytes) -> None:
        if self.plain:  # the first member needs no entry
            self.places.append((self.packed, self.plain))
        raw = member_of(data)
        self.out.write(raw)
        self.packed, self.plain = self.packed + len(raw), self.plain + len(data)

    def close(self) -> None:
        if self.held:
            self._member(bytes(self.held))
        self.out.write(LAST_MEMBER)
        self.out.close()
        with self.store.open_output_stream(f"{self.path}.gzi", compression=None) as f:
            f.write(struct.pack(f"<{1 + 2 * len(self.places)}Q", len(self.places), *(x for p in self.places for x in p)))


class BgzfWriter(DataSourceWriter):
    """Attempts write files of their own; those of accepted attempts become parts (see ``bam.BamWriter``)."""

    def __init__(self, options: dict, batches: bool) -> None:
        self.path, self.suffix, self.batches = options["path"], options.get("suffix", ".gz"), batches

    def write(self, rows: Iterator) -> Moves:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, own = opened(self.path)
        store.create_dir(f"{own}/{ATTEMPTS}", recursive=True)
        name = f"part-{context.partitionId():08d}"
        moves: list[tuple[str, str]] = []
        part, batch = None, None
        for row in rows:
            at = row.batch if self.batches else None
            if part is None or at != batch:
                if part is not None:
                    part.close()
                batch = at
                path = f"{own}/{ATTEMPTS}/{name}-{context.taskAttemptId()}-{len(moves)}{self.suffix}"
                part = _Part(store, path)
                place = f"{own}/batch={batch}/{name}{self.suffix}" if self.batches else f"{own}/{name}{self.suffix}"
                moves += [(path, place), (f"{path}.gzi", f"{place}.gzi")]
            part.add(row.value.encode() + b"\n")
        if part is not None:
            part.close()
        return Moves(moves)

    def commit(self, messages: list[Moves | None]) -> None:
        store, own = opened(self.path)
        for m in messages:
            for attempt, place in m.files if m is not None else []:
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                store.move(attempt, place)
        self._clear()

    def abort(self, messages: list[Moves | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, own = opened(self.path)
        if store.get_file_info(f"{own}/{ATTEMPTS}").type != fs.FileType.NotFound:
            store.delete_dir(f"{own}/{ATTEMPTS}")


@contextmanager
def small_batches(spark: SparkSession, rows: int = WRITTEN, size: int | None = None) -> Iterator[None]:
    """While it lasts, Spark hands ``rows`` rows, and ``size`` bytes, at a time to Python, as rows of whole reads are long; what was set comes back."""
    name, bound = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, bound_before = spark.conf.get(name), spark.conf.get(bound)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    if size:
        spark.conf.set(bound, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(bound, bound_before)


def write(rows: DataFrame, path: str, suffix: str = ".gz") -> None:
    """Lines (value) in their order within each partition as block gzip parts under ``path``; with a column ``batch``, under a folder for each."""
    spark = rows.sparkSession
    spark.dataSource.register(BgzfSource)
    names = [x for x in ("batch", "value") if x in rows.columns]
    with small_batches(spark):
        rows.select(*names).write.format("bgzf").option("suffix", suffix).mode("append").save(path)


def lines(spark: SparkSession, paths: list[str], split: int = SPLIT, **options: str) -> DataFrame:
    """(file, block, value): the lines of block gzip files, in order within each block; other shapes by ``options``."""
    spark.dataSource.register(BgzfSource)
    return spark.read.format("bgzf").option("paths", "\n".join(paths)).option("split", split).options(**options).load()


def edges(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, n, head, tail) of every split with lines: their number, the first three and the last three."""
    return lines(spark, paths, shape="edges")


def records(spark: SparkSession, paths: list[str], places: str) -> DataFrame:
    """(record_no, l0, l1, l3): FASTQ records inside the splits, put together where they are unpacked; the table ``places`` has (file, block, base, first)."""
    return lines(spark, paths, shape="records", places=places)


def found(paths: list[str]) -> list[str]:
    """The files under ``paths`` if all of them are block gzip, else none."""
    out = []
    for path in paths:
        try:
            store, own = opened(path)
            info = store.get_file_info(own)
            root = path[: len(path) - len(own)] if path.endswith(own) else ""
            if info.type == fs.FileType.Directory:
                own_files = [x for x in store.get_file_info(fs.FileSelector(own, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and not x.base_name.endswith(".gzi")]
                out += sorted(root + x.path for x in own_files)
            else:
                out.append(path)
        except (OSError, pa.ArrowInvalid):  # a pattern, or a store of Spark's alone
            return []
    return out if out and all(is_bam(x) for x in out) else []

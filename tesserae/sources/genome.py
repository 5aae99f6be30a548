"""Genomes as FASTA files with an index, from which single ranges are read without moving the genome.

An index row tells where a contig's bases begin, and how long its lines are with and without their ends; so the place of any base in the
file is arithmetic. Ranges that are wanted are made distinct, sorted by their place and read block by block by all tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources.bam import opened

#: Bytes of a file that are scanned by one task, that are read at a time, and that wanted ranges are put together within.
SPLIT, READ, BLOCK = 64 << 20, 8 << 20, 4 << 20
#: Index rows that are broadcast, counted first; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
INDEX = "name string, length long, offset long, line_bases long, line_width long"


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is named, on one machine."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tesserae-")


@contextmanager
def kept(rows: DataFrame, path: str | None = None, **options: str) -> Iterator[DataFrame]:
    """Rows that are used several times, computed once: a table in the shared folder, or at ``path`` over what is there, of which each use reads its columns.

    It goes at the end. ``options`` are those of the writer.
    """
    spark = rows.sparkSession
    path = path or f"{scratch(spark)}/kept-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").options(**options).parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # wherever Spark can write
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


class Indexed(NamedTuple):
    """A genome on storage: its index, with a column for the file of each contig."""

    index: DataFrame


class _Contig:
    """What one split holds of a contig."""

    def __init__(self, name: str | None, offset: int | None) -> None:
        self.name, self.offset = name, offset
        self.bases = self.lines = self.full = self.last = 0
        self.line_bases = self.line_width = None

    def line(self, bases: int, width: int) -> None:
        if self.line_bases is None:
            self.line_bases, self.line_width = bases, width
        self.bases, self.lines, self.last = self.bases + bases, self.lines + 1, bases
        self.full += bases == self.line_bases


def _lines(f, start: int, end: int, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(place, length without the line's end, length with it, first bytes) of the lines that begin in start..end."""
    at = start
    if start:  # the line that lies across the start belongs to the split before
        f.seek(start - 1)
        at = start - 1
        while True:
            data = f.read(READ)
            if not data:
                return
            k = data.find(b"\n")
            if k >= 0:
                at += k + 1
                break
            at += len(data)
    begin, head, length, before = at, b"", 0, b""
    f.seek(at)
    while begin < end:
        data = f.read(READ)
        if not data:
            if length:
                bare = length - (before == b"\r")
                yield begin, bare, length, head
            return
        cuts = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10).tolist()
        p = 0
        for k in cuts:
            if begin >= end:
                return
            if len(head) < 4096:
                head += data[p : min(k, p + 4096)]
            total = length + k - p
            last = data[k - 1 : k] if k > p else before
            yield begin, total - (last == b"\r"), total + 1, head
            begin, head, length, before, p = begin + total + 1, b"", 0, b"", k + 1
        if len(head) < 4096:
            head += data[p : p + 4096]
        length += len(data) - p
        before = data[-1:] if len(data) > p else before


_FOUND = "file string, start long, k int, name string, offset long, bases long, lines long, full long, last long, line_bases long, line_width long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split holds of its contigs; number 0 goes on from the split before."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for batch in batches:
        for file, start, end, size in zip(*(batch.column(x).to_pylist() for x in ("file", "start", "stop", "size")), strict=True):
            store, own = opened(file)
            found = [_Contig(None, None)]
            with store.open_input_file(own) as f:
                for at, bare, width, head in _lines(f, start, end, size):
                    if head[:1] == b">":
                        name = head[1:bare].decode().split()
                        found.append(_Contig(name[0] if name else "", at + width))
                    elif bare:
                        found[-1].line(bare, width)
            rows = [(file, start, k, c.name, c.offset, c.bases, c.lines, c.full, c.last, c.line_bases, c.line_width) for k, c in enumerate(found) if k or c.lines]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def file_sizes(paths: list[str]) -> list[tuple[str, int]]:
    """Files and their sizes; folders stand for the files in them."""
    out = []
    for path in paths:
        store, own = opened(path)
        info = store.get_file_info(own)
        if info.type == fs.FileType.Directory:
            root = path[: len(path) - len(own)] if path.endswith(own) else ""
            out += [(root + x.path, x.size) for x in store.get_file_info(fs.FileSelector(own)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        else:
            out.append((path, info.size))
    return sorted(out)


def index(spark: SparkSession, paths: str | list[str], *, split: int = SPLIT) -> DataFrame:
    """(file, name, length, offset, line_bases, line_width) of FASTA files, in splits of bytes; a contig may lie across many.

    Lines of a contig must be of one length but for the last; others are an error.
    """
    sizes = file_sizes([paths] if isinstance(paths, str) else paths)
    ranges = [(f, at, min(at + split, n), n) for f, n in sizes for at in range(0, n, split)]
    todo = spark.createDataFrame(ranges, "file string, start long, stop long, size long").repartition(max(1, min(len(ranges), 4096)))
    found = todo.mapInArrow(_scan, _FOUND)
    heads = found.groupBy("file", "start").agg(F.max("k").alias("heads"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    base = heads.select("file", "start", F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("base"))
    numbered = found.join(base, ["file", "start"]).withColumn("no", F.col("base") + F.col("k")).where("no > 0")
    whole = numbered.groupBy("file", "no").agg(
        F.max("name").alias("name"), F.sum("bases").alias("length"), F.max("offset").alias("offset"), F.sum("lines").alias("lines"),
        F.min(F.when(F.col("line_bases").isNotNull(), F.struct("start", "line_bases", "line_width"))).alias("first"),
        F.max(F.when(F.col("lines") > 0, F.struct("start", "last"))).alias("end"), F.collect_set("line_bases").alias("widths"), F.sum("full").alias("full"),
    )
    width = F.coalesce("first.line_bases", F.lit(1))
    # all lines but the last have the first one's length: then the last one is what is left
    even = (F.col("lines") == 0) | ((F.col("end.last") == F.col("length") - width * (F.col("lines") - 1)) & (F.col("end.last") <= width) & (F.col("full") >= F.col("lines") - 1) & (F.size("widths") <= 2))
    checked = F.when(even, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lines of different lengths in "), "name")))
    return whole.select("file", "name", checked.alias("length"), "offset", width.alias("line_bases"), F.coalesce("first.line_width", F.lit(2)).alias("line_width"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index beside a FASTA file, as other tools write it."""
    return spark.read.csv(f"{path}.fai", sep="\t", schema=INDEX).select(F.lit(path).alias("file"), *[x.split()[0] for x in INDEX.split(", ")])


def genome(spark: SparkSession, path: str) -> Indexed:
    """A FASTA file with the index beside it, or with one that is made; a compressed one is unpacked into the shared folder."""
    from tesserae.sources.files import fasta

    store, own = opened(path)
    if own.endswith((".gz", ".bz2")):
        return stored(fasta(spark, path))
    there = store.get_file_info(f"{own}.fai").type == fs.FileType.File
    return Indexed(read_index(spark, path) if there else index(spark, path))


def stored(contigs: DataFrame) -> Indexed:
    """Contigs (chrom, seq) as FASTA files in the shared folder, a part for each task; nothing is shuffled."""
    spark = contigs.sparkSession
    path = f"{scratch(spark)}/genome-{uuid.uuid4().hex}"
    contigs.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), "seq").alias("value")).write.text(path)
    found = index(spark, path)
    found.write.parquet(f"{path}/_index")
    return Indexed(spark.read.parquet(f"{path}/_index"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bases of ranges that come sorted by file and place; what lies within a block is read once."""
    file, f, data, base = None, None, b"", 0
    for batch in batches:
        files, a, b, top = (batch.column(x).to_pylist() for x in ("file", "a", "b", "top"))
        out = []
        for name, x, y, most in zip(files, a, b, top, strict=True):
            if name != file:
                if f is not None:
                    f.close()
                store, own = opened(name)
                file, f, data, base = name, store.open_input_file(own), b"", 0
            if not base <= x <= y <= base + len(data):
                f.seek(x)
                base, data = x, f.read(most - x)
            out.append(data[x - base : y - base].translate(None, b"\r\n").decode())
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("a"), batch.column("b"), pa.array(out, pa.string())], ["file", "a", "b", "seq"])
    if f is not None:
        f.close()


def located(rows: DataFrame, found: Indexed, looks: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """Adds (file, a, b) under each name of ``looks``: where the bytes of the bases from 0-based start lie. looks: name -> (chromosome, start, length)."""
    table = found.index
    few = table.count() <= BROADCAST_ROWS
    for name, (chrom, start, length) in looks.items():
        own = table.select(F.col("name").alias("_n"), F.struct("file", "length", "offset", "line_bases", "line_width").alias("_i"))
        rows = rows.join(F.broadcast(own) if few else own, F.col(chrom) == F.col("_n"), "left")
        absent = F.raise_error(F.concat(F.lit("chromosome not in the genome: "), F.coalesce(F.col(chrom), F.lit("null"))))
        i = F.col("_i")
        s = F.greatest(start.cast("long"), F.lit(0))
        e = F.least(start.cast("long") + length, i["length"])
        at = lambda p, i=i: i["offset"] + F.floor(p / i["line_bases"]) * i["line_width"] + p % i["line_bases"]
        place = F.struct(i["file"].alias("file"), at(s).alias("a"), (at(e - 1) + 1).alias("b"))
        none = F.lit(None).cast("struct<file:string,a:bigint,b:bigint>")
        rows = rows.withColumn(name, F.when(F.col("_n").isNull(), absent).otherwise(F.when(s < e, place).otherwise(none))).drop("_n", "_i")
    return rows


def fetch(rows: DataFrame, found: Indexed, looks: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """Adds the bases of each look-up under its name; fewer come back at a chromosome's end, and a chromosome that is not there is an error.

    Distinct places are read once each, however many rows ask for them.
    """
    placed = located(rows, found, {f"_{n}": x for n, x in looks.items()})
    wanted = None
    for n in looks:
        own = placed.select(F.col(f"_{n}.file").alias("file"), F.col(f"_{n}.a").alias("a"), F.col(f"_{n}.b").alias("b")).where("file is not null")
        wanted = own if wanted is None else wanted.union(own)
    wanted = wanted.distinct().withColumn("block", F.floor(F.col("a") / BLOCK)).repartition("file", "block")
    top = F.max("b").over(Window.partitionBy("file", "block"))
    ordered = wanted.withColumn("top", top).sortWithinPartitions("file", "a", "b")
    texts = ordered.select("file", "a", "b", "top").mapInArrow(_read, "file string, a long, b long, seq string")
    for n in looks:
        own = texts.select(F.struct("file", "a", "b").alias(f"_{n}"), F.col("seq").alias(n))
        placed = placed.join(own, f"_{n}", "left").withColumn(n, F.coalesce(n, F.lit(""))).drop(f"_{n}")
    return placed

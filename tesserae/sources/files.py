"""Sequence, alignment and table files as DataFrames.

Text formats are read by Spark's line readers, so large files are split and compressed ones decompressed by Spark, from any
file system that Spark reaches. Records of several lines are put together by byte order, not by a driver loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.ranges import numbered
from tesserae.sources import bam, bgzf
from tesserae.sources.genome import scratch

#: Splits of input files whose places are broadcast, counted first; beyond it lines are sorted into their splits.
SPLITS = 500_000


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, head, tail) of every split in a task: its number of lines, its first three and its last three."""
    at, n, head, tail, out = None, 0, [], [], []
    for batch in batches:
        for key, line in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True), batch.column("value").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append((*at, n, head, tail))
                at, n, head, tail = key, 0, [], []
            n += 1
            if len(head) < 3:
                head.append(line)
            tail = [*tail[-2:], line]
    if at is not None:
        out.append((*at, n, head, tail))
    kinds = {"file": pa.string(), "block": pa.int64(), "n": pa.int64(), "head": pa.list_(pa.string()), "tail": pa.list_(pa.string())}
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))


_RECORD = pa.schema([("record_no", pa.int64()), ("l0", pa.string()), ("l1", pa.string()), ("l3", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines lie in one split; lines come in file order with the number of the split's first line."""
    at, line, held = None, 0, []
    for batch in batches:
        out: list[tuple] = []
        for file, block, base, first, value in zip(*(batch.column(x).to_pylist() for x in ("file", "block", "base", "first", "value")), strict=True):
            if (file, block) != at:
                at, line, held = (file, block), base, []
            if line % 4 == 0:
                held = []
            held.append(value)
            if line % 4 == 3 and len(held) == 4:
                out.append((first + line // 4, held[0], held[1], held[3]))
            line += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_RECORD)], schema=_RECORD)


def _split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): lines in order within each block; block gzip files are split, too."""
    if packed := bgzf.found([path] if isinstance(path, str) else path):
        return bgzf.lines(spark, packed)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record_no, read_id, sequence, qual, quals) of FASTQ files of four lines a record, files in the order of their names.

    A line's place in its record follows from the number of lines before it, since a quality line may look like a header.
    One scan counts the lines of every split and keeps its outermost ones; a second puts records together inside the
    splits, without a shuffle. Only records that lie across splits, one for each border, are gathered by their number.
    """
    packed = bgzf.found([path] if isinstance(path, str) else path)
    kept = f"{scratch(spark)}/splits-{uuid.uuid4().hex}"  # a row for each split, read several times
    lines = None if packed else _split_lines(spark, path)
    found = bgzf.edges(spark, packed) if packed else lines.mapInArrow(_edges, "file string, block long, n long, head array<string>, tail array<string>")
    found.write.parquet(kept)
    edges = spark.read.parquet(kept)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = edges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    first = edges.groupBy("file").agg((F.floor((F.sum("n") + 3) / 4)).alias("m")).select("file", F.coalesce(F.sum("m").over(whole), F.lit(0)).alias("first"))
    splits = base.join(first, "file")
    known = splits.select("file", "block", "base", "first")
    if packed:  # unpacked in Python already, so records are put together there
        known.write.parquet(f"{kept}-places")
        inside = bgzf.records(spark, packed, f"{kept}-places")
    else:
        if splits.count() <= SPLITS:
            placed = lines.join(F.broadcast(known), ["file", "block"])  # streams the lines, so their order stays
        else:
            own = lines.withColumn("at", F.monotonically_increasing_id())
            placed = own.repartition("file", "block").sortWithinPartitions("file", "block", "at").join(known, ["file", "block"]).sortWithinPartitions("file", "block", "at")
        inside = placed.select("file", "block", "base", "first", "value").mapInArrow(_records, "record_no long, l0 string, l1 string, l3 string")
    number = lambda k, back: F.col("base") + (F.col("n") - F.size("tail") if back else 0) + k
    both = splits.select("base", "n", "first", F.posexplode("head").alias("k", "value"), F.lit(False).alias("back")).select("base", "n", "first", number(F.col("k"), False).alias("line"), "value")
    last = splits.select("base", "n", "first", "tail", F.posexplode("tail").alias("k", "value")).select("base", "n", "first", number(F.col("k"), True).alias("line"), "value")
    start = F.col("line") - F.col("line") % 4
    across = both.union(last).where((start < F.col("base")) | (start + 4 > F.col("base") + F.col("n"))).distinct()
    joined = across.groupBy((F.col("first") + F.floor(F.col("line") / 4)).alias("record_no")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)])
    out = inside.union(joined.where("l0 is not null"))
    read_id = F.split(F.substring("l0", 2, 1 << 30), r"\s")[0]
    return out.select("record_no", read_id.alias("read_id"), F.col("l1").alias("sequence"), F.col("l3").alias("qual"), quality_scores(F.col("l3")).alias("quals"))


def quality_scores(qual: Column) -> Column:
    """Phred scores of a quality string."""
    return F.when(F.length(qual) > 0, F.transform(F.split(qual, ""), lambda c: (F.ascii(c) - 33).cast("short"))).otherwise(F.array().cast("array<short>"))


#: Bases of a row of fasta_pieces, at most.
PIECE = 1 << 20


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, block), lines) of the splits in a batch; a split's lines follow one another."""
    file, block, lines = batch.column("file"), batch.column("block"), batch.column("value").to_numpy(zero_copy_only=False)
    n = batch.num_rows
    if not n:
        return
    cuts: list[int] = []
    if file[0] != file[n - 1] or block[0] != block[n - 1]:
        files_, blocks = file.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((files_[1:] != files_[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        yield (file[a].as_py(), block[a].as_py()), lines[a:b]


def _contigs(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of contigs in every split: number 0 goes on from the split before. Without ``whole`` a row for each split: names and bases only."""
    kinds = {"file": pa.string(), "block": pa.int64(), "h": pa.int32(), "name": pa.string(), "at": pa.int64(), "seq": pa.string()}
    key, h, name, at, held, size, out, letters = None, 0, None, 0, [], 0, [], 0

    def close() -> None:
        nonlocal at, size, letters
        if whole and (held or (h and not at)):
            out.append((*key, h, name, at, "".join(held)))
            letters += size
        at, size = at + size, 0
        held.clear()

    def end_of_split() -> None:
        close()
        if not whole:
            out.append((*key, h, name, at, None))

    def batch_of() -> pa.RecordBatch:
        nonlocal letters
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))
        out.clear()
        letters = 0
        return made

    for batch in batches:
        for place, lines in _runs(batch):
            if place != key:
                if key is not None:
                    end_of_split()
                key, h, name, at = place, 0, None, 0
            begin = 0
            for head in [*(k for k, line in enumerate(lines) if line[:1] == ">"), len(lines)]:
                # the lines between two headers at once
                text = "".join("".join(lines[begin:head]).split())
                for k in range(0, len(text), PIECE):
                    part = text[k : k + PIECE]
                    if size and size + len(part) > PIECE:
                        close()
                    size += len(part)
                    if whole:
                        held.append(part)
                if head < len(lines):
                    close()
                    words = lines[head][1:].split()
                    h, name, at = h + 1, words[0] if words else "", 0
                begin = head + 1
                if letters > 8 * PIECE or len(out) > 4096:
                    yield batch_of()
    if key is not None:
        end_of_split()
    yield batch_of()


def fasta_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, chrom_idx, at, seq) of FASTA files: pieces of contigs from base ``at`` on, in the order of files and lines.

    A header is a line that begins with ``>``. One scan counts the headers of every split and the bases after the last one, a second
    cuts pieces inside the splits, so a contig is the work of as many tasks as it has splits and nothing is shuffled. Lines before a file's first
    header are left out; a contig without bases has one empty piece.
    """
    lines = _split_lines(spark, path)
    kept = f"{scratch(spark)}/splits-{uuid.uuid4().hex}"  # a row for each split, read several times
    lines.mapInArrow(lambda x: _contigs(x, False), "file string, block long, h int, name string, at long, seq string").select("file", "block", "h", "name", "at").write.parquet(kept)
    edges = spark.read.parquet(kept)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    base = edges.withColumn("heads", F.coalesce(F.sum("h").over(before), F.lit(0))).withColumn("last", F.last("name", True).over(before))
    # bases since the last header before the split: those of its own split and of the splits without one since then
    since = Window.partitionBy("file", "era").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    eras = base.withColumn("era", F.col("heads") + F.col("h")).withColumn("own", F.col("at"))
    running = eras.select("file", "block", "heads", "last", "h", (F.coalesce(F.sum("own").over(since), F.lit(0))).alias("in_era"), F.lag("era").over(order).alias("era_before"), F.lag("at").over(order).alias("at_before"), F.lag("h").over(order).alias("h_before"))
    # a split with headers begins in the era of the one before
    totals = eras.groupBy("file", F.col("era").alias("era_before")).agg(F.sum("own").alias("all"))
    placed = running.join(totals, ["file", "era_before"], "left").select("file", "block", "heads", "last", F.when(F.col("h") == 0, F.col("in_era")).otherwise(F.coalesce("all", F.lit(0))).alias("from"))
    counts = edges.groupBy("file").agg(F.sum("h").alias("n")).select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for each file
    splits = placed.join(counts, "file")
    few = splits.count() <= SPLITS
    pieces = lines.mapInArrow(lambda x: _contigs(x, True), "file string, block long, h int, name string, at long, seq string")
    both = pieces.join(F.broadcast(splits) if few else splits, ["file", "block"]).where("heads + h > 0")
    return both.select(F.when(F.col("h") == 0, F.col("last")).otherwise(F.col("name")).alias("chrom"), (F.col("first") + F.col("heads") + F.col("h") - 1).alias("chrom_idx"), (F.col("at") + F.when(F.col("h") == 0, F.col("from")).otherwise(0)).alias("at"), "seq")


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, chrom_idx, seq): one row for each contig, numbered in file order."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda p: p["seq"]), "")
    return fasta_pieces(spark, path).groupBy("chrom_idx", "chrom").agg(whole.alias("seq")).select("chrom", "chrom_idx", "seq")


def _tag(fields: Column, name: str) -> Column:
    found = F.try_element_at(F.filter(F.slice(fields, 12, 1 << 20), lambda x: x.startswith(name)), F.lit(1))
    return F.substring(found, 6, 1 << 20)


def _clip(cigar: Column, pattern: str) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")), F.lit("999999999999")), F.lit(0)).cast("long")


def _spent(cigar: Column, kinds: str) -> Column:
    ops = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(ops, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text or of a BAM file: line_no, the raw fields, and what alignment tables need of them.

    read_start and read_end count on the stored sequence, so hard clips are outside; read_length includes them.
    """
    if bam.is_bam(path):
        lines = bam.lines(spark, path)
    else:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no")).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = F.split("value", "\t")
    base = lines.select("line_no", f.alias("f")).select(
        "line_no", "f", F.col("f")[0].alias("qname"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("rname"), F.col("f")[3].cast("long").alias("pos"),
        F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"),
    )
    cigar, stored = F.col("cigar"), F.when(F.col("seq") == "*", 0).otherwise(F.length("seq"))
    consumed = _spent(cigar, "MIS=X")
    hard = _spent(cigar, "H")
    soft_first, soft_last = _clip(cigar, r"^(?:\d+H)?(\d+)S"), _clip(cigar, r"(\d+)S(?:\d+H)?$")
    return base.select(
        "line_no", "qname", "flag", "rname", "mapq", "cigar", "seq", "qual", F.col("f").alias("fields"),
        (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + _spent(cigar, "MDN=X")).alias("end"),
        F.when(cigar == "*", stored).otherwise(consumed + hard).cast("long").alias("read_length"),
        soft_first.alias("read_start"), (consumed - soft_last).alias("read_end"),
        F.when(F.col("qual") == "*", F.array().cast("array<short>")).otherwise(quality_scores(F.col("qual"))).alias("quals"),
        _tag(F.col("f"), "AS:i:").cast("long").alias("align_score"), _tag(F.col("f"), "PS:i:").cast("long").alias("ps"),
        _tag(F.col("f"), "PC:i:").cast("int").alias("pc"), _tag(F.col("f"), "HP:i:").cast("int").alias("hp"),
    )


def sam_lines(records: DataFrame) -> DataFrame:
    """SAM text of records, under their present names; a bx column becomes a tag."""
    fields = F.concat(F.array("qname"), F.slice("fields", 2, 1 << 20))
    if "bx" in records.columns:
        fields = F.concat(fields, F.array(F.concat(F.lit("BX:Z:"), F.col("bx"))))
    return records.select("line_no", F.array_join(fields, "\t").alias("value"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    if bam.is_bam(path):
        return spark.createDataFrame([(x,) for x in bam.header_lines(path)], "value string")
    return spark.read.text(path).where(F.col("value").startswith("@"))


def chromsizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, chrom_idx, size); the file's order is the order of the chromosomes."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, size long").withColumn("at", F.monotonically_increasing_id())
    return numbered(rows, "at", "chrom_idx").select("chrom", "chrom_idx", "size")


def haplotags(spark: SparkSession, path: str) -> DataFrame:
    """(read_idx, align_idx, haplotype, phase_set) of a table with #readname, haplotype and phaseset."""
    from tesserae.functions.scalars import name_parts

    rows = spark.read.csv(path, sep="\t", header=True)
    _, read_idx, align_idx = name_parts(F.col("`#readname`"))
    haplotype = F.when(F.col("haplotype") == "H1", 1).when(F.col("haplotype") == "H2", 2).otherwise(-1)
    phase = F.when(F.col("phaseset") == "none", 0).otherwise(F.col("phaseset").cast("long"))
    return rows.select(read_idx.alias("read_idx"), align_idx.alias("align_idx"), haplotype.cast("byte").alias("haplotype"), phase.cast("long").alias("phase_set"))


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="read_subset string, num_sequences long, total_bases long, mean double, min long, max long, N50 long, Q25 double, Q50 double, Q75 double")


def parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet tables, pruned to columns and rows by the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def append_parquet(rows: DataFrame, path: str) -> None:
    """Adds rows to a table; the first call fixes its columns and types, and later ones must have them."""
    from tesserae.operators.metadata import exists

    if exists(path):
        present = rows.sparkSession.read.parquet(path).schema
        kinds = lambda s: [(f.name, f.dataType) for f in s]
        if kinds(present) != kinds(rows.schema):
            raise ValueError(f"the table has {present.simpleString()}, the rows have {rows.schema.simpleString()}")
    rows.write.mode("append").parquet(path)


def row_counts(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Rows of every table; Spark answers from the files' footers."""
    return {p: spark.read.parquet(p).count() for p in paths}


def file_names(spark: SparkSession, paths: list[str], *, fofn: bool = False) -> list[str]:
    """Input paths; with ``fofn`` they list paths. All that are missing are named at once."""
    if fofn:
        paths = [r.value.strip() for r in spark.read.text(paths).where(F.length(F.trim("value")) > 0).collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if missing:
        raise OSError(f"missing inputs: {', '.join(missing)}")
    return paths

"""Contacts as matrices and as the text formats of other tools."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import hap_key, junction_symbol, midpoint, revcomp, strand_symbol
from tesserae.operators.contacts import contact_order, no_self_ligation
from tesserae.operators.intervals import bin_of, bin_offsets
from tesserae.operators.ranges import running_total
from tesserae.sources.genome import Indexed, fetch, scratch, stored


def fragment_bins(fragments: DataFrame, chromsizes: DataFrame, resolution: int) -> DataFrame:
    """(fragment_id, bin_id) by fragment midpoint; fragments outside every bin are left out."""
    mid = midpoint(F.col("start"), F.col("end"))
    sized = bin_offsets(chromsizes, resolution).select("chrom", "size", "first_bin")
    # a row for each chromosome
    return fragments.join(F.broadcast(sized), "chrom").select("fragment_id", bin_of(mid, F.col("size"), F.col("first_bin"), resolution).alias("bin_id")).where("bin_id is not null")


def pixels(contacts: DataFrame, fragment_bin: DataFrame, *, by_haplotype: bool = False) -> DataFrame:
    """(bin1_id, bin2_id, count[, hap_key]), upper triangle.

    Contacts are counted by fragment pair before bins are looked up, so the joins see pairs, not contacts.
    """
    keys = ["align1_fragment_id", "align2_fragment_id"]
    if by_haplotype:
        contacts = contacts.withColumn("hap_key", hap_key(F.col("align1_haplotype"), F.col("align2_haplotype")))
        keys.append("hap_key")
    pairs = contacts.groupBy(*keys).agg(F.count("*").alias("n"))
    for k in (1, 2):
        own = fragment_bin.select(F.col("fragment_id").alias(f"align{k}_fragment_id"), F.col("bin_id").alias(f"b{k}"))
        pairs = pairs.join(own, f"align{k}_fragment_id")
    out = pairs.groupBy(*keys[2:], F.least("b1", "b2").alias("bin1_id"), F.greatest("b1", "b2").alias("bin2_id"))
    return out.agg(F.sum("n").cast("int").alias("count"))


class Matrix(NamedTuple):
    """A stored matrix: pixels in the order of their bins with their numbers, and where rows and chromosomes begin."""

    pixels: DataFrame
    first_pixel: DataFrame
    chroms: DataFrame
    resolution: int


def matrix_index(found: DataFrame, chromsizes: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    """((bin_id, first), (chrom_idx, first)): the number of the first pixel of every bin's row, and of the first bin of every chromosome.

    Both are running sums, over counts by row and by chromosome, and have one entry more for the end. Rows without pixels begin where the next one does.
    """
    sized = bin_offsets(chromsizes, resolution).withColumn("bins", F.ceil(F.col("size") / resolution).cast("long"))
    # a row for each chromosome; one more entry stands for the end
    ends = sized.agg(F.count("*").alias("chrom_idx"), F.coalesce(F.sum("bins"), F.lit(0)).alias("first"))
    first_bin = sized.select(F.col("chrom_idx").cast("long").alias("chrom_idx"), F.col("first_bin").cast("long").alias("first")).union(ends)
    every = sized.where("bins > 0").select(F.explode(F.sequence(F.col("first_bin").cast("long"), (F.col("first_bin") + F.col("bins") - 1).cast("long"))).alias("bin_id")).union(ends.select("first"))
    counts = found.groupBy(F.col("bin1_id").cast("long").alias("bin_id")).agg(F.count("*").alias("n"))
    rows = every.join(counts, "bin_id", "left").select("bin_id", F.coalesce("n", F.lit(0)).alias("n"))
    first_pixel = running_total(rows, ["bin_id"], "n", "to").select("bin_id", (F.col("to") - F.col("n")).cast("long").alias("first"))
    return first_pixel, first_bin


def store_matrix(found: DataFrame, chromsizes: DataFrame, resolution: int, path: str | None = None) -> Matrix:
    """Writes pixels, sorted and numbered, and their index as Parquet tables under ``path``, or in the shared folder."""
    spark = found.sparkSession
    path = path or f"{scratch(spark)}/matrix-{uuid.uuid4().hex}"
    found.sort("bin1_id", "bin2_id").write.parquet(f"{path}/sorted")
    own = spark.read.parquet(f"{path}/sorted")
    first_pixel, _ = matrix_index(own, chromsizes, resolution)
    first_pixel.sort("bin_id").write.parquet(f"{path}/first_pixel")
    starts = spark.read.parquet(f"{path}/first_pixel")
    place = F.row_number().over(Window.partitionBy("bin1_id").orderBy("bin2_id")) - 1  # within a row of the matrix
    numbered = own.withColumn("k", place).join(starts, own["bin1_id"] == starts["bin_id"]).select(*own.columns, (F.col("first") + F.col("k")).alias("pixel"))
    numbered.sort("pixel").write.parquet(f"{path}/pixels")
    bin_offsets(chromsizes, resolution).select("chrom", "chrom_idx", "size", "first_bin").write.parquet(f"{path}/chroms")
    return Matrix(*(spark.read.parquet(f"{path}/{x}") for x in ("pixels", "first_pixel", "chroms")), resolution)


def read_range(matrix: Matrix, chrom: str, start: int, end: int) -> DataFrame:
    """The rows of the matrix for the bins that begin in start..end of a chromosome: one contiguous range of pixels, which the scan is pruned to."""
    own = matrix.chroms.where(F.col("chrom") == chrom).first()
    if own is None:
        raise ValueError(f"no chromosome in the matrix: {chrom}")
    last = -(-own["size"] // matrix.resolution)
    low, high = (own["first_bin"] + min(max(0, -(-x // matrix.resolution)), last) for x in (start, end))
    bounds = {r.bin_id: r["first"] for r in matrix.first_pixel.where(F.col("bin_id").isin(low, high)).collect()}
    return matrix.pixels.where((F.col("pixel") >= bounds[low]) & (F.col("pixel") < bounds[high]))


def salsa_rows(contacts: DataFrame) -> DataFrame:
    """Two BED rows for each contact."""
    c = contact_order(contacts)
    side = lambda n: F.struct(F.col(f"align{n}_chrom").alias("chrom"), F.col(f"align{n}_start").alias("start"), F.col(f"align{n}_end").alias("end"), F.format_string(f"read%s_%d/{n}", "read_name", "contact_idx").alias("read_pair_id"), F.col(f"align{n}_mapping_quality").alias("mapping_quality"), strand_symbol(F.col(f"align{n}_strand")).alias("strand"))
    return c.select(F.explode(F.array(side(1), side(2))).alias("r")).select("r.*")


#: Columns of a pairs file.
PAIRS_COLUMNS = ["readID", "chr1", "pos1", "chr2", "pos2", "strand1", "strand2", "pair_type", "align1_idx", "align2_idx", "distance_on_read"]


def pairs_rows(contacts: DataFrame) -> DataFrame:
    """The body of a pairs file; positions are fragment midpoints."""
    c = contact_order(contacts)
    at = lambda n: midpoint(F.col(f"align{n}_fragment_start"), F.col(f"align{n}_fragment_end"))
    strand = lambda n: strand_symbol(F.col(f"align{n}_strand"))
    values: list[Column] = [
        F.format_string("read%s_%d", "read_name", "contact_idx"), F.col("align1_chrom"), at(1), F.col("align2_chrom"), at(2), strand(1), strand(2),
        junction_symbol(F.col("contact_is_direct")), F.col("align1_align_idx"), F.col("align2_align_idx"), F.col("contact_read_distance"),
    ]
    return c.select(*[v.alias(n) for v, n in zip(values, PAIRS_COLUMNS, strict=True)])


def pairs_header(chromsizes: list[tuple[str, int]]) -> list[str]:
    return ["## pairs format 1.0", "#shape: upper triangle", *[f"#chromsize: {c} {n}" for c, n in chromsizes], "#columns: " + " ".join(PAIRS_COLUMNS)]


def _positions(contacts: DataFrame, read_length: int) -> DataFrame:
    c = no_self_ligation(contacts)
    for n in (1, 2):
        mid = midpoint(F.col(f"align{n}_fragment_start"), F.col(f"align{n}_fragment_end"))
        c = c.withColumn(f"pos{n}", F.greatest(mid, F.lit(read_length)))
    own = Window.partitionBy("read_name").orderBy("align1_align_idx", "align2_align_idx")
    number = F.row_number().over(own)
    text = F.when(number > 9999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 4, "0"))
    return c.withColumn("pair_id", F.concat_ws(":", "read_name", text))


def _with_ends(contacts: DataFrame, genome: DataFrame | Indexed, read_length: int) -> DataFrame:
    """Adds the bases before both positions, from an indexed genome; contigs that are rows are stored as one first."""
    found = genome if isinstance(genome, Indexed) else stored(genome)
    return fetch(_positions(contacts, read_length), found, {f"seq{n}": (f"align{n}_chrom", F.col(f"pos{n}") - read_length, read_length) for n in (1, 2)})


def paired_reads(contacts: DataFrame, genome: DataFrame | Indexed, read_length: int = 50) -> DataFrame:
    """(pair_id, seq1, seq2): pseudo paired ends; the reverse strand is complemented."""
    c = _with_ends(contacts, genome, read_length)
    for n in (1, 2):
        c = c.withColumn(f"seq{n}", F.when(F.col(f"align{n}_strand"), F.col(f"seq{n}")).otherwise(revcomp(F.col(f"seq{n}"))))
    return c.select("pair_id", "seq1", "seq2")


def fastq_lines(reads: DataFrame, n: int) -> DataFrame:
    """FASTQ records of one end, with a constant quality."""
    seq = F.col(f"seq{n}")
    return reads.select(F.concat(F.lit("@"), F.col("pair_id"), F.lit(f" {n}:N:0:1\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq))).alias("value"))


def merged_no_dups(contacts: DataFrame, genome: DataFrame | Indexed, read_length: int = 50) -> DataFrame:
    """Lines of 16 fields; here the forward strand is the one that is complemented."""
    c = _with_ends(contacts, genome, read_length)
    for n in (1, 2):
        c = c.withColumn(f"seq{n}", F.when(F.col(f"align{n}_strand"), revcomp(F.col(f"seq{n}"))).otherwise(F.col(f"seq{n}")))
    side = lambda n: [F.col(f"align{n}_strand").cast("int").cast("string"), F.col(f"align{n}_chrom"), F.col(f"pos{n}").cast("string"), F.col(f"align{n}_fragment_id").cast("string")]
    mapped = lambda n: [F.lit("60"), F.lit(f"{read_length}M"), F.col(f"seq{n}")]
    names = [F.concat(F.col("pair_id"), F.lit(f":{n}")) for n in (1, 2)]
    return c.select(F.concat_ws(" ", *side(1), *side(2), *mapped(1), *mapped(2), *names).alias("value"))

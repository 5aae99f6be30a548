"""Alignment tables from SAM records, and renaming, selection and counts of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranges import numbered
from tesserae.functions.scalars import align_type, joined_name, mean_qscore, name_parts, text_qscore
from tesserae.schemas import ALIGNMENTS, conform


def reformat(records: DataFrame, *, set_bx: bool = False) -> DataFrame:
    """Renames SAM records (line_no, qname, ..) to name:read_idx:align_idx; both ids count from 0 in file order.

    A read's number is that of its first record among first records. ``line_no`` may have gaps; ids do not.
    """
    first = records.groupBy("qname").agg(F.min("line_no").alias("first_line"))
    heads = numbered(first, "first_line", "read_idx").select("qname", "read_idx")
    out = numbered(records, "line_no", "align_idx").join(heads, "qname")
    name = joined_name(F.col("qname"), F.col("read_idx"), F.col("align_idx"))
    out = out.withColumn("bx", F.col("qname")) if set_bx else out
    return out.withColumn("qname", name)


def create_table(records: DataFrame) -> DataFrame:
    """ALIGNMENTS of reformatted SAM records (see sources.sam); an aligned record needs a score and base qualities."""
    name, read_idx, align_idx = name_parts(F.col("qname"))
    kind = align_type(F.col("flag"))
    mapped = kind != "unmapped"
    need = lambda c, what: F.when(mapped & c.isNull(), F.raise_error(F.concat(F.lit(f"aligned record without {what}: "), F.col("qname")))).otherwise(c)
    score = need(F.col("align_score"), "alignment score")
    score_of = F.when(F.size("quals") > 0, mean_qscore(F.col("quals")))
    if "qual" in records.columns:
        score_of = F.when((F.col("qual") != "*") & (F.length("qual") > 0), text_qscore(F.col("qual")))
    quality = need(F.rint(score_of), "base qualities")
    zero = lambda c: F.when(mapped, c).otherwise(0)
    out = records.select(
        read_idx.alias("read_idx"), align_idx.alias("align_idx"), kind.alias("align_type"), F.when(mapped, F.col("rname")).otherwise("NULL").alias("chrom"),
        zero(F.col("start")).alias("start"), zero(F.col("end")).alias("end"), (F.col("flag").bitwiseAND(F.lit(0x10)) == 0).alias("strand"), name.alias("read_name"),
        "read_length", zero(F.col("read_start")).alias("read_start"), zero(F.col("read_end")).alias("read_end"), zero(F.col("mapq")).alias("mapping_quality"),
        zero(score).alias("align_score"), F.coalesce(quality, F.lit(0)).alias("align_base_qscore"),
        F.coalesce("ps", F.lit(0)).alias("phase_set"), F.coalesce("pc", F.lit(0)).alias("phase_qual"), F.coalesce("hp", F.lit(-1)).alias("haplotype"),
    )
    return conform(out, ALIGNMENTS)


def select_passing(records: DataFrame, assigned: DataFrame, *, clean_read_name: bool = False) -> DataFrame:
    """The SAM records of passing alignments; each must be found."""
    name, _, align_idx = name_parts(F.col("qname"))
    wanted = assigned.where("pass_filter").select("align_idx").distinct()
    out = records.withColumn("align_idx", align_idx).join(wanted, "align_idx", "left_semi")
    expected, found = wanted.count(), out.select("align_idx").distinct().count()
    if expected != found:
        raise ValueError(f"{found} of {expected} passing alignments found in the records")
    return (out.withColumn("qname", name) if clean_read_name else out).drop("align_idx")


def type_summary(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("align_type").agg(F.count("*").alias("num_aligns"), F.countDistinct("read_idx").alias("num_reads"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))

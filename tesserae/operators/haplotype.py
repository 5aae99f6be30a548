"""Haplotypes: tags for alignments, and the consensus of a read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_tags(alignments: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Overwrites haplotypes by tags (read_idx, align_idx, haplotype, phase_set); all rows are reset first.

    Without tags the table stays as it is.
    """
    if tags is None or tags.isEmpty():
        return alignments
    tags = tags.select("read_idx", "align_idx", F.col("haplotype").alias("_h"), F.col("phase_set").alias("_p"))
    out = alignments.join(tags, ["read_idx", "align_idx"], "left")
    out = out.withColumns({"haplotype": F.coalesce("_h", F.lit(-1)).cast("byte"), "phase_set": F.coalesce("_p", F.lit(0)).cast("long"), "phase_qual": F.lit(0).cast("short")})
    return out.select(*alignments.columns)


def majority(rows: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """(keys, winner, votes, proportion): the commonest value of each group, the smallest on ties."""
    counts = rows.groupBy(*keys, vote).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("minus"), F.col(vote).alias("winner"))).alias("b")
    best = counts.groupBy(*keys).agg(F.sum("n").alias("all"), first)
    return best.select(*keys, "b.winner", (-F.col("b.minus")).alias("votes"), (-F.col("b.minus") / F.col("all")).alias("proportion"))


def consensus(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Gives all alignments of (read, chromosome, phase set) the majority haplotype where its share lies strictly between threshold and 1.

    The votes are passing, phased alignments; failed and unphased ones of the group follow. A unanimous group is left alone.
    """
    keys = ["read_name", "chrom", "phase_set"]
    votes = majority(rows.where("pass_filter and haplotype <> -1"), keys, "haplotype")
    votes = votes.where((F.col("proportion") > threshold) & (F.col("proportion") < 1.0)).select(*keys, F.col("winner").alias("_w"))
    out = rows.join(votes, keys, "left").withColumn("haplotype", F.coalesce("_w", "haplotype").cast("byte"))
    return out.select(*rows.columns)

"""Pairwise contacts of reads: expansion, selection, union, down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import midpoint
from tesserae.operators.ranges import running_total
from tesserae.schemas import CONTACTS, SIDE, conform

_SIDE = [x.split(" ")[0] for x in SIDE]


def pair_type(cis: Column, a: str = "a", b: str = "b") -> Column:
    """How the haplotypes of a pair relate; the first that holds."""
    ha, hb = F.col(f"{a}.haplotype"), F.col(f"{b}.haplotype")
    return (
        F.when(~cis, "trans").when((ha == -1) & (hb == -1), "unphased").when((ha == -1) | (hb == -1), "semi_phased")
        .when(F.col(f"{a}.phase_set") != F.col(f"{b}.phase_set"), "phased_sets_differ").when(ha == hb, "phased_h_cis").otherwise("phased_h_trans")
    )


def to_contacts(rows: DataFrame, *, with_second_phase_qual: bool = False) -> DataFrame:
    """A row for each two passing alignments of a read, in the order of the read; reads with one have none.

    Reads are gathered once and their pairs come from the gathered array, without a second shuffle.
    """
    part = F.struct("read_start", "align_idx", "read_end", *[c for c in _SIDE if c != "align_idx"])
    reads = rows.where("pass_filter").groupBy("read_name").agg(F.array_sort(F.collect_list(part)).alias("rows"), F.first("read_length").alias("read_length"), F.first("read_idx").alias("read_idx"))
    reads = reads.where(F.size("rows") > 1)
    later = F.transform("rows", lambda x, i: F.transform(F.slice("rows", i + 2, F.size("rows")), lambda y, gap: F.struct(x.alias("x"), y.alias("y"), gap.alias("gap"))))
    pairs = reads.select("read_name", "read_length", "read_idx", F.explode(F.flatten(later)).alias("p")).select("read_name", "read_length", "read_idx", "p.*")
    swap = F.col("x.fragment_id") > F.col("y.fragment_id")
    ordered = pairs.withColumn("a", F.when(swap, F.col("y")).otherwise(F.col("x"))).withColumn("b", F.when(swap, F.col("x")).otherwise(F.col("y")))
    cis = F.col("a.chrom") == F.col("b.chrom")
    mid = lambda s: midpoint(F.col(f"{s}.fragment_start"), F.col(f"{s}.fragment_end"))
    out = ordered.select(
        "read_name", "read_length", "read_idx", (F.col("gap") == 0).alias("contact_is_direct"), cis.alias("contact_is_cis"),
        (F.col("y.read_start") - F.col("x.read_end")).alias("contact_read_distance"),
        F.when(cis, F.col("b.start") - F.col("a.end")).otherwise(0).alias("contact_genome_distance"),
        (cis & (F.abs(F.col("b.fragment_id") - F.col("a.fragment_id")) <= 1)).alias("contact_fragment_adjacent"),
        F.when(cis, mid("b") - mid("a")).otherwise(0).alias("contact_fragment_distance"), pair_type(cis).alias("haplotype_pair_type"),
        *[F.col(f"{s}.{c}").alias(f"align{n}_{c}") for n, s in ((1, "a"), (2, "b")) for c in _SIDE],
    )
    second = out["align2_phase_qual"]
    return conform(out, CONTACTS) if not with_second_phase_qual else out.select(*[F.col(f.name).cast(f.dataType) for f in CONTACTS], second.cast("short"))


def quality_filter(contacts: DataFrame, *, min_mapping_quality: int = 0, min_align_base_qscore: int = 0) -> DataFrame:
    """Contacts whose both sides exceed the thresholds; 0 sets none. Reaches the scan as a pushed filter."""
    for column, least in (("mapping_quality", min_mapping_quality), ("align_base_qscore", min_align_base_qscore)):
        if least:
            contacts = contacts.where((F.col(f"align1_{column}") > least) & (F.col(f"align2_{column}") > least))
    return contacts


def no_self_ligation(contacts: DataFrame) -> DataFrame:
    return contacts.where("align1_fragment_id <> align2_fragment_id")


def merge(tables: list[DataFrame]) -> DataFrame:
    """All rows of contact tables; empty tables add nothing."""
    if not tables:
        raise ValueError("no contact tables")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def contact_order(contacts: DataFrame, name: str = "contact_idx") -> DataFrame:
    """Numbers a read's contacts from 0 by their alignments."""
    own = Window.partitionBy("read_name").orderBy("align1_align_idx", "align2_align_idx")
    return contacts.withColumn(name, (F.row_number().over(own) - 1).cast("long"))


def nearest_totals(reads: DataFrame, targets: list[int], seed: int) -> DataFrame:
    """(target, total, end_key) where the running sum of shuffled lengths comes nearest each target, the first on ties."""
    keyed = reads.withColumn("shuffle_key", F.md5(F.concat(F.col("read_name"), F.lit(f":{seed}"))))
    summed = running_total(keyed, ["shuffle_key", "read_name"], "read_length", "total")
    # each target is one aggregate over the same pass
    found = summed.agg(*[F.min_by(F.struct("total", "shuffle_key", "read_name"), F.struct(F.abs(F.col("total") - t), "total", "shuffle_key")).alias(f"t{k}") for k, t in enumerate(targets)])
    row = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("target"), F.col(f"t{k}.total").alias("total"), F.col(f"t{k}.shuffle_key").alias("end_key"), F.col(f"t{k}.read_name").alias("end_name")) for k, t in enumerate(targets)]))
    return found.select(row.alias("r")).select("r.*")


def downsample(contacts: DataFrame, targets: list[int], *, tolerance: float = 0.1, seed: int = 0, max_attempts: int = 100) -> dict[int, DataFrame]:
    """Nested samples of reads, each with about the target's number of bases, as contact tables.

    Reads are ordered by a hash of name and attempt, so a sample repeats; only a row for each target reaches the driver.
    """
    reads = contacts.groupBy("read_name").agg(F.max("read_length").alias("read_length"))
    bases = reads.agg(F.sum("read_length")).first()[0] or 0
    wanted = sorted(t for t in targets if t <= bases)
    if not wanted:
        raise ValueError(f"no target within the {bases} bases present")
    for attempt in range(max_attempts):
        ends = {r.target: r for r in nearest_totals(reads, wanted, seed + attempt).collect()}
        if all(abs(ends[t].total - t) < tolerance * t for t in wanted):
            key = F.md5(F.concat(F.col("read_name"), F.lit(f":{seed + attempt}")))
            return {t: contacts.where(F.struct(key.alias("k"), F.col("read_name").alias("n")) <= F.struct(F.lit(ends[t].end_key).alias("k"), F.lit(ends[t].end_name).alias("n"))) for t in wanted}
    raise ValueError(f"no attempt of {max_attempts} came within the tolerance")

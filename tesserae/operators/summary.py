"""Per-read statistics of contacts, and the long summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import display
from tesserae.schemas import CONCATEMERS, PAIR_TYPES, conform

SHORT_RANGE = 20_000
#: Right-closed ranges of the number of segments of a read.
ORDER_BINS = [("2", 1, 2), ("3", 2, 3), ("4", 3, 4), ("5-6", 4, 6), ("7-11", 6, 11), ("12-21", 11, 21), ("22-50", 21, 50), ("gt_50", 50, 1_000_000_000)]


def concatemers(contacts: DataFrame, *, short_range: int = SHORT_RANGE) -> DataFrame:
    """CONCATEMERS: one aggregation by read; every category is a conditional count, so absent ones are 0."""
    cis, direct, short = F.col("contact_is_cis"), F.col("contact_is_direct"), F.col("contact_fragment_distance") < short_range
    out: list[Column] = []
    for name, part in (("total", F.lit(True)), ("direct", direct), ("indirect", ~direct)):
        for kind, cond in (("contacts", F.lit(True)), ("cis_contacts", cis), ("trans_contacts", ~cis), ("short_range_cis_contacts", cis & short), ("long_range_cis_contacts", cis & ~short)):
            out.append(F.count_if(part & cond).alias(f"{name}_{kind}"))
    out += [F.count_if(F.col("haplotype_pair_type") == t).alias(f"haplotype_{t}") for t in PAIR_TYPES]
    for name, part in (("direct", direct), ("indirect", ~direct)):
        for kind in ("genome", "fragment"):
            out.append(F.coalesce(F.max(F.when(part, F.col(f"contact_{kind}_distance"))), F.lit(0)).alias(f"max_{name}_contact_{kind}_distance"))
    ends = F.size(F.array_union(F.collect_set("align1_fragment_id"), F.collect_set("align2_fragment_id")))
    rows = contacts.groupBy("read_name").agg(F.first("read_length").alias("read_length"), F.first("read_idx").alias("read_idx"), ends.alias("num_fragments"), *out)
    return conform(rows.withColumn("read_order", F.col("direct_contacts") + 1), CONCATEMERS)


def _long(section: str, rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    levels = [F.lit("")] * (3 - len(keys)) + [F.col(k).cast("string") for k in keys]
    return rows.select(F.monotonically_increasing_id().alias("_pos"), F.lit(section).alias("section"), *[x.alias(f"level_{i}") for i, x in enumerate(levels)], display(F.col(value)).alias("value"))


def _stack(rows: DataFrame, items: list[tuple]) -> DataFrame:
    """Rows (a, b, value) of a one-row frame; a null value is left out."""
    parts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.cast("double").alias("value")) for a, b, v in items])).alias("r")
    return rows.select(parts).select("r.*").where("value is not null")


def read_totals(reads: DataFrame, read_summary: DataFrame) -> DataFrame:
    """One row: counts, bases and N50 of all reads and of concatemers."""
    from tesserae.operators.reads import length_stats

    whole = read_summary.where("read_subset = 'all'").select(F.col("num_sequences").alias("n_all"), F.col("total_bases").alias("b_all"), F.col("N50").alias("n50_all"))
    own = length_stats(reads).select(F.col("num_sequences").alias("n_own"), F.col("total_bases").alias("b_own"), F.col("N50").alias("n50_own"))
    return whole.crossJoin(own)  # two frames of one row


def order_histogram(reads: DataFrame) -> DataFrame:
    """(bin, count, perc) of read_order, all bins present."""
    n = F.col("read_order")
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("bin"), F.col(f"b{i}").alias("count"), F.col("all").alias("all")) for i, (label, _, _) in enumerate(ORDER_BINS)])).alias("r")
    one = reads.agg(F.count("*").alias("all"), *[F.count_if((n > lo) & (n <= hi)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(ORDER_BINS)])
    return one.select(bins).select("r.*").withColumn("perc", F.when(F.col("all") > 0, F.lit(100.0) * F.col("count") / F.col("all")).otherwise(0.0)).drop("all")


def contact_sums(reads: DataFrame) -> DataFrame:
    """(subset, kind, count, perc): sums of the contact counters and their share of each subset's contacts."""
    names = [f.name for f in CONCATEMERS if f.name.endswith("contacts")]
    one = reads.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    rows = []
    for c in names:
        subset, kind = c.split("_", 1)
        total = F.col(f"{subset}_contacts")
        rows.append(F.struct(F.lit(subset).alias("subset"), F.lit(kind).alias("kind"), F.col(c).alias("count"), F.when(total > 0, F.lit(100.0) * F.col(c) / total).otherwise(0.0).alias("perc")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def long_summary(reads: DataFrame, read_summary: DataFrame, user_metadata: dict[str, str] | None = None) -> DataFrame:
    """(section, level_0, level_1, level_2, value), all text: the parts of a run's report, keys right-aligned."""
    spark = reads.sparkSession
    totals = read_totals(reads, read_summary)
    share = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * a / F.col(b))

    def section(n: str, first: str) -> DataFrame:
        own, whole = F.col(f"{n}_own"), F.col(f"{n}_all")
        rows = []
        for name, v in (("all", whole), ("concatemer", own), ("fail_filter", whole - own)):
            rows += [(first, name, v), ("perc", name, share(v, f"{n}_all"))]
        return _stack(totals, rows)

    density = lambda b: F.when(F.col(b) > 0, F.lit(1e9) * F.col("contacts") / F.col(b))
    total = reads.agg(F.coalesce(F.sum("total_contacts"), F.lit(0)).alias("contacts")).crossJoin(totals)
    sums, orders = contact_sums(reads), order_histogram(reads)
    tall = lambda df, keys: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in ("count", "perc")])).alias("r")).select(*keys, "r.*")
    parts = [
        _long("reads", section("n", "count"), ["a", "b"]),
        _long("read_length", _stack(totals, [("N50", "all", F.col("n50_all")), ("N50", "concatemer", F.col("n50_own"))]), ["a", "b"]),
        _long("bases", section("b", "bases"), ["a", "b"]),
        _long("contacts", tall(sums, ["subset", "kind"]), ["subset", "variable", "kind"]),
        _long("density", _stack(total, [("contacts_per_gb", "all", density("b_all")), ("contacts_per_gb", "concatemer", density("b_own"))]), ["a", "b"]),
        _long("concatemer_order", tall(orders, ["bin"]), ["variable", "bin"]),
    ]
    if user_metadata:
        rows = [(i, "user_metadata", "", "", str(k), str(v)) for i, (k, v) in enumerate(user_metadata.items())]
        parts.insert(0, spark.createDataFrame(rows, "_pos long, section string, level_0 string, level_1 string, level_2 string, value string"))
    # a few dozen rows, in the order of the sections and of what each lists
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.orderBy("_part", "_pos").drop("_part", "_pos")

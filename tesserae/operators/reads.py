"""Quality control and length statistics of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import mean_qscore, text_qscore
from tesserae.schemas import READ_METADATA


def read_metadata(records: DataFrame, *, min_read_length: int = 1, max_read_length: int = 150_000, min_qscore: float = 0, max_qscore: float = 266) -> DataFrame:
    """Adds length, mean quality and the pass flag to records (read_id, sequence, quals, best with qual); upper bounds are exclusive.

    The quality is compared as the single-precision number that is stored. With qual alone no array is made of it; an empty one has no quality then.
    """
    if "quals" not in records.columns:
        score = text_qscore(F.col("qual"))
    else:
        score = mean_qscore(F.col("quals"))
        if "qual" in records.columns:
            score = F.when(F.length("qual") > 0, text_qscore(F.col("qual"))).otherwise(score)
    out = records.withColumn("read_length", F.length("sequence").cast("long")).withColumn("qscore", score.cast("float"))
    return with_pass_flag(out, min_read_length=min_read_length, max_read_length=max_read_length, min_qscore=min_qscore, max_qscore=max_qscore)


def with_pass_flag(reads: DataFrame, *, min_read_length: int, max_read_length: int, min_qscore: float, max_qscore: float) -> DataFrame:
    n, q = F.col("read_length"), F.col("qscore")
    return reads.withColumn("pass_filter", (n >= min_read_length) & (n < max_read_length) & (q >= min_qscore) & (q < max_qscore))


def metadata_columns(reads: DataFrame) -> DataFrame:
    return reads.select(*[F.col(f.name).cast(f.dataType) for f in READ_METADATA])


def length_stats(reads: DataFrame, length: str = "read_length", keys: list[str] | None = None) -> DataFrame:
    """num_sequences, total_bases, mean, min, max, N50 and quartiles, for all reads or by ``keys``.

    N50 is the first length, ascending, at which the running sum exceeds half the total. Reads are first counted by
    length, so what is summed in order has a row for each distinct length and not for each read.
    """
    keys = keys or []
    by_length = reads.groupBy(*keys, F.col(length).cast("long").alias("n")).agg(F.count("*").alias("c"))
    run = F.sum(F.col("n") * F.col("c")).over(Window.partitionBy(*keys, F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col("n") * F.col("c")).over(Window.partitionBy(*keys, F.lit(0)))
    summed = by_length.withColumn("run", run).withColumn("total", total)
    quartiles = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
    out = summed.groupBy(*keys).agg(
        F.sum("c").alias("num_sequences"), F.sum(F.col("n") * F.col("c")).alias("total_bases"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.min(F.when(F.col("run") > F.col("total") / 2, F.col("n"))).alias("N50"), quartiles.alias("q"),
    )
    out = out.where("num_sequences > 0")
    return out.select(*keys, "num_sequences", "total_bases", (F.col("total_bases") / F.col("num_sequences")).alias("mean"), "min", "max", "N50", *[F.col("q")[k].alias(f"Q{25 * (k + 1)}") for k in range(3)])


def read_summary(metadata: DataFrame) -> DataFrame:
    """length_stats of all, passing and failing reads; a subset without reads has no row."""
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("pass_filter"), "pass").otherwise("fail"))).alias("read_subset")
    return length_stats(metadata.select("read_length", subset), keys=["read_subset"])


def pass_rate(metadata: DataFrame) -> float:
    rate = metadata.agg(F.avg(F.col("pass_filter").cast("int"))).first()[0]
    if not rate:
        raise ValueError("no read passes the filter")
    return rate

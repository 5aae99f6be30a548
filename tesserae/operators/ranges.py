"""Global order without a global task: running totals and row numbers over all rows of a table.

The borders of the ranges are quantiles that are taken once and then are literals of the plan. What a range holds is summed
with map-side combination; every row finds its range by the same literals. So the sums and the rows cannot disagree, however
often either is computed, as they could if two range exchanges drew their own samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about; and the largest number of ranges. Both only deal the work.
ROWS, PARTS = 100_000, 4096
#: Bytes of a part of rows that are dealt by their size, about; and the bytes below which a part is not worth a task.
PART, LEAST = 32 << 20, 1 << 20


def parts_of(spark: SparkSession, size: int | None) -> int:
    """Parts for rows of ``size`` bytes: as many as keep each near ``PART``, and work for all cores; the session's number of partitions has no say."""
    size = size or 0
    return max(size // PART + 1, min(spark.sparkContext.defaultParallelism, size // LEAST + 1))


def sorted_by(rows: DataFrame, by: str, size: int | None = None, *, each: Column | None = None, then: list[str] | None = None) -> DataFrame:
    """Rows in the order of ``by``, and of ``then`` among equal ones, over all partitions; a task reads as much of a large table as of a small one.

    ``size`` are the bytes of all rows, where these are of about one length; ``each`` those of a row. With ``each`` parts are cut by bytes: one holds ``PART``
    and a quarter, about, and the rows of one value, however long rows lie together. Equal values of ``by`` stay in one part.
    """
    spark, order = rows.sparkSession, [by, *(then or [])]
    if each is None:
        return rows.repartitionByRange(parts_of(spark, size), by).sortWithinPartitions(*order)
    each = F.coalesce(each, F.lit(0))
    n, size = rows.agg(F.count("*"), F.sum(each)).first()
    parts = parts_of(spark, size)
    # a value counts once for each quarter of a mean row, so quantiles of values are quantiles of bytes
    weight = (1 + F.floor(each / max(1, (size or 0) // (4 * max(1, n))))).cast("int")
    limits = borders(rows.select(F.explode(F.array_repeat(by, weight)).alias(by)), by, parts)
    part = F.greatest(range_of(F.col(by), rows.schema[by].dataType.simpleString(), limits), F.lit(0))  # nulls lie in the first part
    return rows.withColumn("_part", part).repartitionById(parts, "_part").drop("_part").sortWithinPartitions(*order)


def borders(rows: DataFrame, by: str, parts: int | None = None) -> list:
    """Ascending values that split ``rows`` by the column ``by`` into ranges of about equal size; at most ``PARTS`` values reach the driver."""
    parts = parts or min(PARTS, rows.count() // ROWS + 1)
    if parts < 2:
        return []
    share, near = [k / parts for k in range(1, parts)], max(10_000, 20 * parts)
    kind = rows.schema[by].dataType.simpleString()
    if kind in ("string", "binary"):  # quantiles of numbers: the order of strings is kept by their first six bytes
        number = F.conv(F.rpad(F.substring(F.hex(F.col(by).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("long")
        found = rows.agg(F.percentile_approx(number, share, near)).first()[0] or []
        return sorted({int(x).to_bytes(6, "big") for x in found if x is not None})
    found = rows.agg(F.percentile_approx(by, share, near)).first()[0] or []
    return sorted({x for x in found if x is not None})


def range_of(value: Column, kind: str, limits: list) -> Column:
    """The number of the range: how many limits lie at or below the value; null values come first."""
    if not limits:
        return F.lit(0)
    text = kind in ("string", "binary")
    value = F.substring(F.hex(value.cast("binary")), 1, 12) if text else value
    array = F.array(*[F.lit(x.hex().upper() if text else x) for x in limits])
    if not text:
        array = array.cast(f"array<{kind}>")
    # a binary search over the literals, since a scan of thousands for each row would cost more than the sort
    steps = F.sequence(F.lit(1), F.lit(len(limits).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(array, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    return F.when(value.isNull(), -1).otherwise(F.aggregate(steps, start, halve)["lo"])


def running_total(rows: DataFrame, order: list[str], value: str, name: str, *, parts: int | None = None) -> DataFrame:
    """Adds the running sum of ``value`` over all rows in ``order``; ranges are cut by the first column of it."""
    limits = borders(rows, order[0], parts)
    dealt = rows.withColumn("_part", range_of(F.col(order[0]), rows.schema[order[0]].dataType.simpleString(), limits))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = dealt.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum")).select("_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    summed = dealt.withColumn("_own", own).join(F.broadcast(base), F.col("_part") == F.col("_p"))
    return summed.withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_p", "_own", "_base")


def numbered(rows: DataFrame, by: str, name: str, *, parts: int | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of ``by``, whose values must differ; equal ones are numbered in any order."""
    one = running_total(rows.withColumn("_one", F.lit(1).cast("long")), [by], "_one", name, parts=parts)
    return one.withColumn(name, F.col(name) - 1).drop("_one")


def part_sizes(rows: DataFrame) -> DataFrame:
    """(part, n, before): the rows of each partition as they lie, and of those before it; for logs and checks."""
    own = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    return own.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

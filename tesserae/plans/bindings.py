"""The library's tables over the supplied ones; the same definitions as SQL for DuckDB.

events are alignments (a read is a user's day, a chromosome an event type), part cuts each chromosome into fragments,
documents are reads by their length and sequences by their letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.ranges import sorted_by
from tesserae.schemas import ALIGNMENTS, conform

_ALIGN = """
select event_id as align_idx, concat('r', cast(user_id as {text}), '_', cast({day} as {text})) as read_name,
  user_id * 100000 + {day} as read_idx, case when k % 17 = 16 then 'unmapped' when k % 17 = 15 then 'supplementary' else 'primary' end as align_type,
  event_type as chrom, s as start, s + 50 + k as "end", k % 2 = 0 as strand, 90000 as read_length,
  sec as read_start, sec + 60 * (1 + k % 10) as read_end, k as mapping_quality, (k * 37) % 211 as align_score, k % 41 as align_base_qscore,
  cast(floor(s / 10000) as bigint) as phase_set, 0 as phase_qual, case when k % 3 = 0 then -1 else k % 3 end as haplotype
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, cast(floor(value * 100) as bigint) as s,
  cast(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) as bigint) as sec from events) e
"""
_FRAG = """
select c.chrom, a.cut as start, b.cut as "end", c.chrom_idx * n.n + a.p_partkey + 1 as fragment_id, b.cut - a.cut as fragment_length
from (select p_partkey, p_partkey * 25 + p_size % 20 as cut from part) a
join (select p_partkey, p_partkey * 25 + p_size % 20 as cut from part) b on b.p_partkey = a.p_partkey + 1
cross join (select max(p_partkey) + 1 as n from part) n
cross join (select event_type as chrom, row_number() over (order by event_type) - 1 as chrom_idx from (select distinct event_type from events) t) c
"""
_SEQ = "select doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', ''{all})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents"

#: CTEs for the oracles.
ALIGN_SQL = _ALIGN.format(text="varchar", day="date_diff('day', date '1970-01-01', cast(ts as date))")
FRAG_SQL = _FRAG
SEQ_SQL = _SEQ.format(all=", 'g'")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    e = events.select("event_id", "user_id", "event_type", k.alias("k"), F.floor(F.col("value") * 100).alias("s"), day.alias("day"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("sec"))
    out = e.select(
        F.col("event_id").alias("align_idx"), F.format_string("r%s_%s", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("read_name"),
        (F.col("user_id") * 100000 + F.col("day")).alias("read_idx"), F.when(F.col("k") % 17 == 16, "unmapped").when(F.col("k") % 17 == 15, "supplementary").otherwise("primary").alias("align_type"),
        F.col("event_type").alias("chrom"), F.col("s").alias("start"), (F.col("s") + 50 + F.col("k")).alias("end"), (F.col("k") % 2 == 0).alias("strand"), F.lit(90000).alias("read_length"),
        F.col("sec").alias("read_start"), (F.col("sec") + 60 * (1 + F.col("k") % 10)).alias("read_end"), F.col("k").alias("mapping_quality"), (F.col("k") * 37 % 211).alias("align_score"), (F.col("k") % 41).alias("align_base_qscore"),
        F.floor(F.col("s") / 10000).alias("phase_set"), F.lit(0).alias("phase_qual"), F.when(F.col("k") % 3 == 0, -1).otherwise(F.col("k") % 3).alias("haplotype"),
    )
    return conform(out, ALIGNMENTS)


def chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, chrom_idx): the few event types in order."""
    from pyspark.sql import Window

    types = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("chrom")).distinct()
    return types.withColumn("chrom_idx", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("long"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cut = part.select("p_partkey", (F.col("p_partkey") * 25 + F.col("p_size") % 20).alias("cut"))
    both = cut.join(cut.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("cut").alias("end")), "p_partkey")
    n = part.agg((F.max("p_partkey") + 1).alias("n"))
    every = both.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(chroms(spark, sf_dir)))  # one row, and five
    return every.select("chrom", F.col("cut").alias("start"), "end", (F.col("chrom_idx") * F.col("n") + F.col("p_partkey") + 1).alias("fragment_id"), (F.col("end") - F.col("cut")).alias("fragment_length"))


def chromsizes(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """(chrom, chrom_idx, size), a row for each event type; chromosomes are in the order of their names."""
    from pyspark.sql import Window

    size = (made or fragments(spark, sf_dir)).groupBy("chrom").agg(F.max("end").alias("size"))
    return size.select("chrom", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("long").alias("chrom_idx"), "size")


def sequences(spark: SparkSession, sf_dir: str, *, ordered: bool = False, lettered: bool = False) -> DataFrame:
    """(chrom, chrom_idx, seq) of documents, or of those with letters; ``ordered`` sorts them before letters are derived, as a sort takes its input twice."""
    letters = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.where(F.col("text").rlike("[A-Za-z]")) if lettered else docs
    if ordered:
        docs = sorted_by(docs, "doc_id", each=F.octet_length("text"))
    return docs.select(F.col("doc_id").cast("string").alias("chrom"), F.col("doc_id").alias("chrom_idx"), letters.alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, read_length, qscore): documents by length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("read_id"), F.col("n_chars").alias("read_length"), (F.col("doc_id") % 20).cast("float").alias("qscore"))

"""Read preparation as a stream: each micro-batch is split into passing reads, failing reads and metadata.

Runs to the end of what is there (availableNow) and can be restarted from its checkpoint. A batch's files carry its number, so
a batch that is repeated after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.reads import metadata_columns, with_pass_flag
from tesserae.schemas import READ_METADATA
from tesserae.sources.bgzf import HELD, small_batches
from tesserae.sources.genome import kept

#: Packed bytes of a row group of a kept batch, which bound what its writers and readers hold.
GROUP = 8 << 20


def prepare(records: DataFrame, output: str, checkpoint: str, **bounds: float):
    """Starts the query over a stream of reads (read_id, sequence, qual, read_length, qscore); reads without a quality fail.

    A batch is taken apart once and kept on storage while its three outputs are written, so executors hold no more of a large batch than of a small one.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = with_pass_flag(batch, **bounds).withColumn("pass_filter", F.coalesce("pass_filter", F.lit(False)))
        own = own.select(*[f.name for f in READ_METADATA], "sequence", "qual")
        options = {"compression": "zstd", "parquet.block.size": str(GROUP)}
        with small_batches(batch.sparkSession, size=HELD), kept(own, f"{output}/_kept", **options) as flagged:
            metadata_columns(flagged).write.mode("overwrite").parquet(f"{output}/read_metadata/batch={number}")
            for name, part in (("pass", F.col("pass_filter")), ("fail", ~F.col("pass_filter"))):
                flagged.where(part).select("read_id", "sequence", "qual").write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(records: DataFrame, **bounds: float) -> DataFrame:
    """Reads, bases, and passing reads so far; use in complete mode."""
    flagged = with_pass_flag(records, **bounds)
    return flagged.groupBy().agg(F.count("*").alias("reads"), F.sum("read_length").alias("bases"), F.count_if("pass_filter").alias("passing"), F.sum(F.when(F.col("pass_filter"), F.col("read_length")).otherwise(0)).alias("passing_bases"))


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def in_batches(stream: DataFrame, name: str, checkpoint: str, arrivals: Iterable[Callable[[], object]], mode: str = "complete") -> DataFrame:
    """Runs a stream while data arrive, a batch or more after each arrival, and gives the table that its sink has then."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        for arrive in arrivals:
            arrive()
            query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def to_memory(stream: DataFrame, name: str, mode: str = "complete", then: Callable | None = None) -> DataFrame:
    """Runs a stream to its end into an in-memory table, for totals and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

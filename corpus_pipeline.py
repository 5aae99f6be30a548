"""Documents to packed training sequences: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. ``run`` writes each stage
as Parquet to the shared folder of ``spark.checkpoint.dir``, reads it again for the next, and deletes what the next has read.

Defined cases, for every stage: other columns of the input, whatever their names, are left behind; an empty table gives an
empty result. A row with a null id has no identity: it can be rejected for its quality and is packed, and passes the three stages
between as it is. Null and empty texts are no evidence of quality, duplicates of nothing, hold no passage and no benchmark item, and are
packed as the separator alone. Each stage's own cases are in its docstring.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, minhash, packing, quality, suffix
from tesserae.llm.common import cut, shared_folder, table

#: Fixed value: the columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids to leave out are broadcast up to this many (counted first), else shuffled.
BROADCAST_IDS = 2_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Texts are long rows: fewer of them in an Arrow batch keep executors and their workers small. ``run`` puts the setting back."""
    spark.conf.set(_BATCH, "1000")


@contextmanager
def _own_settings(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = cut(ids.select("doc_id").where("doc_id is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier, learned from all labels, rejects.

    Repeated rows are judged alike, texts of any length on all their bytes; a score of exactly one half is no rejection.
    """
    _small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs.select(*COLUMNS), model).where("score >= 0.5").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five words, similarity 0.8.

    Of repeated rows one stays; an id with several texts goes if one of them is near a smaller id's.
    """
    _small_batches(spark)
    found = cut(minhash.near_duplicates(docs, width=5, percent=80, bands=28))
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        lone = docs.where("doc_id is null")
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(lone)
    return _without(docs, found.where("not kept"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out all occurrences of passages of 200 bytes or more that occur elsewhere; documents with nothing else go.

    What is left of a text is whole characters; n_chars counts them.
    """
    _small_batches(spark)
    out = suffix.remove_repeats(docs, whole_characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    out = out.where((F.col("n_bytes") == 0) | (F.length(F.trim(F.translate(text, "\t\n\r", "   "))) > 0))
    found = out.select("doc_id", text.alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))
    return found.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold windows of benchmark items, whichever row of an id holds them."""
    _small_batches(spark)
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024; repeated rows are packed as often as they occur."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each),
    ("suffix_array_dedup", without_passages),
    ("benchmark_decontamination", no_benchmark),
    ("packing", packed),
]
#: SQL has no compression dictionary and no tokenizer.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    with _own_settings(spark):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs

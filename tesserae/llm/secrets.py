"""Secret scans by an incremental ledger of blobs.

Every version of every path is addressed by its content: the blob is the SHA-256 of its text. The ledger holds a row for each (blob, rule,
version of the rule) that has been scanned, with what was found, nothing included. A scan

    1. addresses all rows, without moving a text,
    2. takes one row for each blob, and its rules for which the ledger has no row,
    3. brings the texts of those rows alone to the scanners and appends their results to the ledger,
    4. joins findings of blobs back to all paths and versions that hold them.

So copies are scanned once, however many paths they have, a second run scans new blobs only, and a new version of a rule is scanned
over all blobs but by that rule alone. A blob's row is chosen by the smallest path and version, so a text is moved under the pair of blob and
path: copies of one text are spread, and only findings, which are short, meet by blob.

Rules are regular expressions with a least length; matches are leftmost and do not overlap within a rule, those that are too short are
dropped after they have matched. The first three are the base; the others add well-known formats of credentials.

Defined cases: a null text is empty; null paths are paths of that name; repeated rows get repeated results; texts are scanned whole, whatever
their length; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import rows_at_a_time, shared_folder, small_batches


class Rule(NamedTuple):
    """What is found: matches of ``pattern`` whose group ``group`` has at least ``least`` code points. A text without any of ``needs`` (lower case) has none."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


#: The base rules of the contract, then public formats of keys, in the order of their kinds.
RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 1, ("aiza",)),
)
FOUND = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, kind string, version int, found {FOUND}"


def found_in(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) in code points of a rule's matches."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]) -> Callable:
    own = {(r.kind, r.version): (r, re.compile(r.pattern)) for r in rules}
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a repeated row lies beside its copies
        for batch in rows_at_a_time(batches, 1):
            out: list[tuple] = []
            for blob, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if blob in seen:
                    continue
                seen.add(blob)
                text, blob = text.as_py(), blob.hex()
                low = text.lower()
                for key in todo:
                    rule, compiled = own[key["kind"], key["version"]]
                    may = not rule.needs or any(x in low for x in rule.needs)
                    out.append((blob, *own[key["kind"], key["version"]][0][:2], [{"start": a, "end": b} for a, b in found_in(text, rule, compiled)] if may else []))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["blob", "kind", "version", "found"])

    return run


def addressed(rows: DataFrame, path: str, text: str, version: str | None = None) -> DataFrame:
    """(path, revision, blob, text) of all versions."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    revision = F.col(version).cast("string") if version else F.lit("")
    return rows.select(F.col(path).alias("path"), F.coalesce(revision, F.lit("")).alias("revision"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def _name() -> Column:
    return F.concat(F.coalesce(F.col("path").cast("string"), F.lit("\0")), F.lit("\0"), F.col("revision"))


def _key() -> Column:
    """The address as bytes, which are half of its letters wherever rows are shuffled by it."""
    return F.unhex("blob").alias("key")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; an empty ledger where the folder is not there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)


def unseen(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, name, todo): one row for each blob, by the bytes of its address, that some rules have not scanned in their present version."""
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int"))
    blobs = rows.select(_key(), _name().alias("name")).groupBy("key").agg(F.min("name").alias("name"))
    done = ledger.join(wanted, ["kind", "version"], "left_semi").groupBy(_key()).agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    todo = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done"))
    return blobs.join(done, "key", "left").select("key", "name", todo.alias("todo")).where(F.size("todo") > 0)


def scan(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger for rows (path, revision, blob, text).

    Where repeated rows of one path are so many that Spark splits their key, a blob may be scanned, and stand in the ledger, twice.
    """
    new = unseen(rows, ledger, rules).hint("shuffle_hash")
    texts = rows.select(_key(), "text", _name().alias("name"))
    return texts.join(new, ["key", "name"]).select("key", "text", "todo").mapInArrow(_scan(rules), LEDGER)


def update(rows: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in ``folder`` lacks, appends it there, and gives the ledger as it is then."""
    spark = rows.sparkSession
    with small_batches(spark):
        scan(rows, read_ledger(spark, folder), rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def of_blobs(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans): what the rules, as they are, found in each blob that holds anything, by start, then by the rules' order."""
    wanted = F.broadcast(ledger.sparkSession.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, place int"))
    one = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    spans = ledger.where(F.size("found") > 0).join(wanted, ["kind", "version"]).dropDuplicates(["blob", "kind"]).select(_key(), one.alias("spans"))
    return spans.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, revision, blob, spans) of all paths and versions; spans are empty where nothing was found."""
    held = of_blobs(ledger, rules)
    none = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    found = rows.select("path", "revision", _key()).join(held, "key", "left")
    return found.select("path", "revision", F.lower(F.hex("key")).alias("blob"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ledger_in(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger of this run alone, in the shared folder."""
    return update(rows, f"{shared_folder(rows.sparkSession)}/ledger-{uuid.uuid4().hex}", rules)

"""Queries whose rows go through files: the commands write them, the sources read them back.

Every one derives its files from the supplied tables, in a folder of its own below the session's shared one.
"""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.functions import scalars
from tesserae.operators import assign, metadata, ranges, reads
from tesserae.plans import bindings as b
from tesserae.plans import registry as r
from tesserae.plans.registry import query
from tesserae.sources import bam, bgzf, files, genome
from tesserae.streaming import reads as streams
from tesserae.streaming.fastq import fastq_stream

BOUNDS = {"min_read_length": 500, "max_read_length": 5000, "min_qscore": 9.5, "max_qscore": 17.5}
BATCH = 50
SAMPLE = '{"sample": "documents"}'


def _folder(spark: SparkSession) -> str:
    return f"{genome.scratch(spark)}/files-{uuid.uuid4().hex}"


def _run(spark: SparkSession, *words: str) -> None:
    """A command as it is typed; what it prints is left out."""
    args = cli.parser().parse_args(list(words))
    with contextlib.redirect_stdout(io.StringIO()):
        args.run(spark, args)


def _in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table with their place in it, over all files in the order of their names."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    base = rows.groupBy("_file").agg(F.count("*").alias("n")).select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, "_file").withColumn("place", F.col("_base") + F.col("_row")).drop("_file", "_row", "_base")


# reads: FASTQ in, batches, failed reads, metadata, summary and catalog out

_RECORDS = (
    f"with s as ({b.SEQ_SQL}), r as (select doc_id, seq, length(seq) as n, 5 + doc_id % 20 as q, row_number() over (order by doc_id) - 1 as no from s where length(seq) > 0), "
    f"f as (select *, n >= 500 and n < 5000 and q >= 9.5 and q < 17.5 as ok, cast(floor(no / {BATCH}) as bigint) as chunk from r), t as (select n as read_length, ok as pass_filter from f)"
)


def _records(spark: SparkSession, sf_dir: str, *, ordered: bool = False) -> DataFrame:
    """(chrom_idx, value): a FASTQ record for each document with letters, of one quality throughout, in order if asked."""
    own = b.sequences(spark, sf_dir, ordered=ordered, lettered=True)
    quality = F.repeat(F.expr("char(38 + chrom_idx % 20)"), F.length("seq").cast("int"))
    return own.select("chrom_idx", F.concat(F.lit("@"), "chrom", F.lit(" of documents\n"), "seq", F.lit("\n+\n"), quality).alias("value"))


def _prepared(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    bgzf.write(_records(spark, sf_dir, ordered=True).select("value"), f"{folder}/in", ".fq.gz")
    bounds = [w for name, value in BOUNDS.items() for w in (f"--{name.replace('_', '-')}", str(value))]
    _run(spark, "reads", "prepare", f"{folder}/in", f"{folder}/reads", "--batch-size", str(BATCH), "--user-metadata", SAMPLE, *bounds)
    return f"{folder}/reads"


@query(_RECORDS + " select dense_rank() over (order by chunk) as batch, count(*) as reads from f where ok group by chunk")
def K4_read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing reads of each batch file; those are numbered without gaps."""
    return spark.read.text(f"{_prepared(spark, sf_dir)}.batch").groupBy(F.col("batch").cast("long").alias("batch")).agg((F.count("*") / 4).cast("long").alias("reads"))


@query(_RECORDS + " select cast(doc_id as varchar) as read_id, md5(seq) as sequence, md5(repeat(chr(cast(38 + doc_id % 20 as integer)), n)) as quality, ok as passed from f")
def K5_read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, read back from the batches or from the file of failed reads."""
    prefix = _prepared(spark, sf_dir)
    both = files.fastq(spark, f"{prefix}.batch").withColumn("passed", F.lit(True)).unionByName(files.fastq(spark, f"{prefix}.fail.fq.gz").withColumn("passed", F.lit(False)))
    return both.select("read_id", F.md5("sequence").alias("sequence"), F.md5("qual").alias("quality"), "passed")


@query(_RECORDS + " select cast(doc_id as varchar) as read_id, n as read_length, cast(q as double) as qscore, ok as pass_filter from f")
def K1_read_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{_prepared(spark, sf_dir)}.read_metadata.parquet")
    return own.select("read_id", "read_length", F.round(F.col("qscore").cast("double"), 3).alias("qscore"), "pass_filter")


@query(
    _RECORDS
    + f""", u as (select *, 'all' as read_subset from t union all select *, case when pass_filter then 'pass' else 'fail' end from t),
v as (select *, sum(read_length) over (partition by read_subset order by read_length) as run, sum(read_length) over (partition by read_subset) as total from u) select read_subset, {r._STATS} from v group by read_subset"""
)
def S9_read_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_summary_csv(spark, f"{_prepared(spark, sf_dir)}.summary.csv")


@query(
    _RECORDS
    + """, n as (select 'metadata: {"batches": ' || count(distinct chunk) || ', "sample": "documents"}' as value from f where ok)
select value from n union all select unnest(['name: reads', 'sources:', '  batches:', '    driver: fastq', '    urlpath: "reads.batch"', '  fail:', '    driver: fastq', '    urlpath: "reads.fail.fq.gz"',
  '  read_metadata:', '    driver: parquet', '    urlpath: "reads.read_metadata.parquet"', '  summary:', '    driver: csv', '    urlpath: "reads.summary.csv"'])"""
)
def K16_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.text(f"{_prepared(spark, sf_dir)}.catalog.yaml")


@query(_RECORDS + " select avg(case when ok then 1.0::double else 0 end) as rate from f")
def A25_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    bgzf.write(_records(spark, sf_dir).select("value"), folder, ".fq.gz")
    return spark.createDataFrame([(reads.pass_rate(reads.read_metadata(files.fastq(spark, folder), **BOUNDS)),)], "rate double")


@query(_RECORDS + " select cast(doc_id as varchar) as read_id, n as read_length, cast(q as double) as qscore, md5(seq) as sequence, case when ok then 'pass' else 'fail' end as folder from f")
def T3_stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ files as a stream whose batches are written three ways: passing reads, failing reads and metadata."""
    folder = _folder(spark)
    _records(spark, sf_dir).select("value").write.text(f"{folder}/in")
    records = reads.read_metadata(fastq_stream(spark, f"{folder}/in").drop("quals"), **BOUNDS)
    streams.prepare(records, f"{folder}/out", f"{folder}/state", **BOUNDS).awaitTermination()
    parts = [spark.read.parquet(f"{folder}/out/{x}").select("read_id", F.md5("sequence").alias("sequence"), F.lit(x).alias("folder")) for x in ("pass", "fail")]
    known = spark.read.parquet(f"{folder}/out/read_metadata").select("read_id", "read_length", F.round(F.col("qscore").cast("double"), 3).alias("qscore"))
    return known.join(parts[0].unionByName(parts[1]), "read_id")


# genomes: FASTA of short lines in; one line a contig, index and sizes out


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    """Documents as FASTA files with lines of 60 bases."""
    folder = _folder(spark)
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    b.sequences(spark, sf_dir, ordered=True).select(F.concat(F.lit(">"), "chrom", F.lit(" a>b\n"), lines).alias("value")).write.text(f"{folder}/fasta")
    return folder


_GENOME = (
    f"with s as ({b.SEQ_SQL}), g as (select cast(doc_id as varchar) as chrom, row_number() over (order by doc_id) - 1 as chrom_idx, md5(seq) as seq, length(seq) as size, "
    "cast(sum(length(cast(doc_id as varchar)) + 3 + length(seq)) over (order by doc_id) - length(seq) - 1 as bigint) as \"offset\" from s)"
)


@query(_GENOME + ' select chrom, chrom_idx, seq, size, "offset" from g')
def K18_genome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of the written FASTA beside their lines of the sizes and of the index."""
    folder = _fasta(spark, sf_dir)
    _run(spark, "refgenome", "prepare", f"{folder}/fasta", f"{folder}/genome")
    contigs = files.fasta(spark, f"{folder}/genome.fa").select("chrom", "chrom_idx", F.md5("seq").alias("seq"))
    sizes = files.chromsizes(spark, f"{folder}/genome.chromsizes")
    index = genome.read_index(spark, f"{folder}/genome.fa").select(F.col("name").cast("string").alias("chrom"), F.col("length").alias("size"), "offset")
    return contigs.join(sizes, ["chrom", "chrom_idx"]).join(index, ["chrom", "size"])


@query(r._CUTS + " select chrom, start, fragment_id, fragment_id - 1 as place from f")
def O4_digest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of an enzyme lie in the file by contig and start."""
    folder = _fasta(spark, sf_dir)
    _run(spark, "refgenome", "virtual-digest", f"{folder}/fasta", "DpnII", f"{folder}/own")
    return _in_file_order(spark, f"{folder}/own.fragments.parquet").select("chrom", "start", "fragment_id", "place")


@query(f"with s as ({b.SEQ_SQL}) select cast(doc_id as varchar) as chrom, len(regexp_extract_all(seq, 'G[AG]G[CT][ACGT]C')) as sites from s")
def X2_degenerate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.sequences(spark, sf_dir).select("chrom", F.regexp_count("seq", F.lit(scalars.replace_degenerate("GRGYNC"))).cast("long").alias("sites"))


# alignments: BAM in, renamed BAM and tables out

_BAM = f"""with e as (select *, mapping_quality as k, align_type <> 'unmapped' as mapped from ({b.ALIGN_SQL}) a),
n as (select *, min(align_idx) over (partition by read_name) as head from e), t as (select read_name, dense_rank() over (order by head) - 1 as read_idx, row_number() over (order by align_idx) - 1 as align_idx, align_type,
  case when mapped then chrom else 'NULL' end as chrom, case when mapped then start else 0 end as start, case when mapped then "end" else 0 end as "end", strand, 50 + k + k % 7 as read_length,
  case when mapped then k % 7 else 0 end as read_start, case when mapped then 50 + k + k % 7 else 0 end as read_end, case when mapped then k else 0 end as mapping_quality, case when mapped then align_score else 0 end as align_score, align_base_qscore,
  case when k % 3 = 0 then 0 else phase_set end as phase_set, haplotype from n)"""


def _bam(spark: SparkSession, sf_dir: str) -> str:
    """Alignments as a BAM file in the order of their numbers, some clipped, those with a haplotype tagged."""
    folder = _folder(spark)
    rows = b.alignments(spark, sf_dir).withColumn("k", F.col("mapping_quality").cast("int")).withColumn("clip", F.col("k") % 7)
    mapped = F.col("align_type") != "unmapped"
    flag = F.when(~mapped, 4).when(F.col("align_type") == "supplementary", 2048).otherwise(0) + F.when(F.col("strand"), 0).otherwise(16)
    cigar = F.concat(F.when(F.col("clip") > 0, F.concat(F.col("clip").cast("string"), F.lit("S"))).otherwise(""), (50 + F.col("k")).cast("string"), F.lit("M"))
    n = 50 + F.col("k") + F.col("clip")
    tags = F.when(F.col("haplotype") != -1, F.array(F.concat(F.lit("HP:i:"), F.col("haplotype").cast("string")), F.concat(F.lit("PS:i:"), F.col("phase_set").cast("string")))).otherwise(F.array().cast("array<string>"))
    fields = [
        F.col("read_name"), flag, F.when(mapped, F.col("chrom")).otherwise("*"), F.when(mapped, F.col("start") + 1).otherwise(0), F.when(mapped, F.col("k")).otherwise(0), F.when(mapped, cigar).otherwise("*"),
        F.lit("*"), F.lit(0), F.lit(0), F.repeat(F.lit("A"), n), F.repeat(F.expr("char(33 + k % 41)"), n), F.concat(F.lit("AS:i:"), F.col("align_score").cast("string")),
    ]
    line = F.array_join(F.concat(F.array(*[f.cast("string") for f in fields]), tags), "\t")
    head = ["@HD\tVN:1.6\tSO:unsorted", *(f"@SQ\tSN:{x.chrom}\tLN:1000000000" for x in b.chroms(spark, sf_dir).orderBy("chrom_idx").collect())]  # a row for each chromosome
    bam.write(rows.select(F.col("align_idx").alias("line_no"), line.alias("value")), f"{folder}/in.bam", head)
    _run(spark, "alignments", "reformat-bam", f"{folder}/in.bam", f"{folder}/named.bam")
    return folder


@query(_BAM + " select *, row_number() over (order by read_name, align_idx) - 1 as place from t")
def O1_table_of_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment table of a BAM file that was read, renamed and written; rows with their place in the file."""
    folder = _bam(spark, sf_dir)
    _run(spark, "alignments", "create-table", f"{folder}/named.bam", f"{folder}/table")
    return _in_file_order(spark, f"{folder}/table").drop("phase_qual")


@query(_BAM + " select read_name || ':' || read_idx || ':' || align_idx as qname, align_idx as line_no, read_length, md5(repeat(chr(cast(33 + align_base_qscore as integer)), read_length)) as quality from t where align_type <> 'unmapped'")
def K15_filtered_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing alignments, here those with a place, selected from one BAM file into another; they keep their order."""
    folder = _bam(spark, sf_dir)
    own = files.sam(spark, f"{folder}/named.bam")
    own.select(scalars.name_parts(F.col("qname"))[2].alias("align_idx"), (F.col("flag").bitwiseAND(F.lit(4)) == 0).alias("pass_filter")).write.parquet(f"{folder}/own")
    _run(spark, "alignments", "filter-bam", f"{folder}/named.bam", f"{folder}/own", f"{folder}/kept.bam")
    found = files.sam(spark, f"{folder}/kept.bam")
    return found.select("qname", scalars.name_parts(F.col("qname"))[2].alias("line_no"), "read_length", F.md5("qual").alias("quality"))


def _assigned_file(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    b.alignments(spark, sf_dir).write.parquet(f"{folder}/alignments")
    b.fragments(spark, sf_dir).write.parquet(f"{folder}/fragments")
    _run(spark, "alignments", "assign-fragments", f"{folder}/alignments", f"{folder}/fragments", f"{folder}/assigned")
    return folder


@query(f"select align_idx, row_number() over (order by read_idx, align_idx) - 1 as place from ({b.ALIGN_SQL}) a")
def O2_assigned_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_file_order(spark, f"{_assigned_file(spark, sf_dir)}/assigned").select("align_idx", "place")


@query(f"select align_idx, row_number() over (order by read_name, align_idx) - 1 as place from ({b.ALIGN_SQL}) a")
def O3_consensus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _assigned_file(spark, sf_dir)
    _run(spark, "alignments", "assign-consensus-haplotype", f"{folder}/assigned", f"{folder}/phased")
    return _in_file_order(spark, f"{folder}/phased").select("align_idx", "place")


@query(f"select align_idx, 'unmapped' as filter_reason, false as pass_filter from ({b.ALIGN_SQL}) a where align_type = 'unmapped'")
def F16_all_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a single mapped alignment is assigned like any other."""
    rows = b.alignments(spark, sf_dir).where("align_type = 'unmapped'")
    return assign.assign_fragments(rows, b.fragments(spark, sf_dir)).select("align_idx", "filter_reason", "pass_filter")


@query(f"select read_idx, align_idx, cast(case when haplotype = -1 then -1 else haplotype end as tinyint) as haplotype, cast(case when haplotype = -1 then 0 else phase_set end as bigint) as phase_set from ({b.ALIGN_SQL}) a")
def S11_haplotag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes by alignment as a table with a header, none, H1 or H2 each."""
    own, phased = b.alignments(spark, sf_dir), F.col("haplotype") != -1
    name = scalars.joined_name(F.col("read_name"), F.col("read_idx"), F.col("align_idx")).alias("#readname")
    rows = own.select(name, F.when(phased, F.concat(F.lit("H"), F.col("haplotype").cast("string"))).otherwise("none").alias("haplotype"), F.when(phased, F.col("phase_set").cast("string")).otherwise("none").alias("phaseset"))
    path = _folder(spark)
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return files.haplotags(spark, path)


@query(f'select align_idx, 5 + 2 * (read_end - read_start) as penalty from ({b.ALIGN_SQL}) a')
def X24_gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.alignments(spark, sf_dir).select("align_idx", scalars.gap_score(F.col("read_end") - F.col("read_start"), "bwa").cast("long").alias("penalty"))


# contacts: tables in, merged tables, matrices and summaries out


@query(r._CONTACTS + " select read_name, a.align_idx as align1_align_idx, b.align_idx as align2_align_idx from contacts")
def S12_merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of contacts whose names stand in a file, merged into one."""
    folder = _folder(spark)
    r._contacts(spark, sf_dir).withColumn("part", F.col("read_idx") % 3).write.partitionBy("part").parquet(f"{folder}/parts")
    metadata.write_text(f"{folder}/names", "".join(f"{folder}/parts/part={k}\n" for k in range(3)))
    _run(spark, "contacts", "merge", "--fofn", f"{folder}/merged", f"{folder}/names")
    return files.parquet(spark, f"{folder}/merged", ["read_name", "align1_align_idx", "align2_align_idx"])


@query(f"with p as ({r.ORACLES['A16_pixels_by_haplotype']}) select bin1_id, bin2_id, count from p where hap_key = '1_2'")
def S7_matrix_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix that is stored by haplotype pair, of which one partition and three columns are read."""
    folder = _folder(spark)
    b.fragments(spark, sf_dir).write.parquet(f"{folder}/fragments")
    own = spark.read.parquet(f"{folder}/fragments")
    r._contacts(spark, sf_dir, own).write.parquet(f"{folder}/contacts")
    sizes = b.chromsizes(spark, sf_dir, own).orderBy("chrom_idx").collect()  # a row for each chromosome
    metadata.write_text(f"{folder}/sizes", "".join(f"{x.chrom}\t{x['size']}\n" for x in sizes))
    _run(spark, "contacts", "export", f"{folder}/contacts", "cooler", f"{folder}/own", "--fragments", f"{folder}/fragments", "--chromsizes", f"{folder}/sizes", "--resolution", str(r.RESOLUTION), "--by-haplotype")
    return files.parquet(spark, f"{folder}/own.cool/pixels", ["bin1_id", "bin2_id", "count"], "hap_key = '1_2'")


@query(r._LONG)
def K17_summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long summary, written by its command from contacts and a table of read statistics."""
    folder = _folder(spark)
    r._contacts(spark, sf_dir).write.parquet(f"{folder}/contacts")
    flagged = reads.with_pass_flag(b.reads(spark, sf_dir), min_read_length=500, max_read_length=5000, min_qscore=6, max_qscore=12)
    metadata.write_text(f"{folder}/reads.csv", reads.read_summary(flagged).toPandas().to_csv(index=False))  # three rows
    _run(spark, "contacts", "summarize", f"{folder}/contacts", f"{folder}/reads.csv", f"{folder}/concatemers", f"{folder}/summary.csv", "--user-metadata", '{"sample": "events"}')
    rows = spark.read.csv(f"{folder}/summary.csv", header=True)
    number, level = F.expr("try_cast(value as double)"), [F.coalesce(f"level_{k}", F.lit("")).alias(f"level_{k}") for k in range(3)]
    return rows.select("section", *level, F.when(number.isNull(), F.col("value")).alias("label"), number.alias("number"))


# tables


def _thirds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return [orders.where(F.pmod(F.coalesce("o_orderkey", F.lit(0)), F.lit(3)) == k) for k in range(3)]


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def K6_appended_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    for part in _thirds(spark, sf_dir):
        files.append_parquet(part, path)
    return spark.read.parquet(path)


@query("select o_orderkey % 3 as part, count(*) as rows from orders group by 1")
def S8_footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    for k, part in enumerate(_thirds(spark, sf_dir)):
        part.write.parquet(f"{folder}/{k}")
    found = files.row_counts(spark, [f"{folder}/{k}" for k in range(3)])
    return spark.createDataFrame([(int(p.rsplit("/", 1)[1]), n) for p, n in found.items()], "part long, rows long")


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def K7_csv_of_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(f"{folder}/orders")
    _run(spark, "utils", "parquet-to-csv", f"{folder}/orders", f"{folder}/orders.csv.gz")
    rows = spark.read.csv(f"{folder}/orders.csv.gz", header=True)
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


@query("select count(*) as rows, 0::bigint as gaps from lineitem")
def A26_part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all partitions, and how many partitions do not begin where the one before ends."""
    sizes = ranges.part_sizes(spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey"))
    end = F.lag(F.col("before") + F.col("n"), 1, 0).over(Window.orderBy("part"))  # a row for each partition
    return sizes.select("n", (F.col("before") != end).cast("long").alias("gap")).agg(F.sum("n").alias("rows"), F.sum("gap").alias("gaps"))

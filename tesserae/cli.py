"""Commands: each reads files, applies operators and writes files."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalars import bases
from tesserae.operators import align, assign, contacts, digest, export, haplotype, metadata, reads, summary
from tesserae.operators.intervals import bins
from tesserae.operators.ranges import numbered, sorted_by
from tesserae.sources import bam, bgzf, files, genome


def session(args: argparse.Namespace) -> SparkSession:
    build = SparkSession.builder.appName("tesserae").config("spark.sql.session.timeZone", "UTC")
    if args.master:
        build = build.master(args.master)
    for pair in args.conf:
        build = build.config(*pair.split("=", 1))
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR" if args.quiet else "WARN")
    return spark


def text_file(lines: DataFrame, path: str, order: list[str] | None = None, header: DataFrame | list[str] | None = None, parts: bool = False) -> str:
    """Text in the order of ``order``: sorted and written by all tasks as numbered parts, ``part-header`` first.

    With ``parts`` they stay a folder; else they are put together on storage, byte for byte, for tools that need one file.
    """
    spark = lines.sparkSession
    lines = lines.orderBy(*order) if order else lines
    folder = path if parts else f"{path}.parts"
    lines.select("value").write.text(folder)
    if header is not None:
        head = header if isinstance(header, DataFrame) else spark.createDataFrame([(x,) for x in header], "value string")
        metadata.write_text(f"{folder}/part-header", "".join(r.value + "\n" for r in head.select("value").collect()))  # a header's few lines
    if not parts:
        metadata.join_parts(folder, path)
    return path


def _tsv(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value"), *[F.col(c) for c in df.columns if c != "value"])


def prepare_genome(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = metadata.output_paths("refgenome", a.prefix)
    with genome.kept(files.fasta(spark, a.fasta)) as contigs:
        text_file(contigs.select("chrom_idx", F.concat(F.lit(">"), "chrom", F.lit("\n"), "seq").alias("value")), paths["fasta"], ["chrom_idx"], parts=a.parts)
        text_file(_tsv(digest.fasta_index(contigs)), paths["fai"], ["offset"], parts=a.parts)
        sizes = digest.chrom_sizes(contigs)
        line = lambda sep: sizes.select("chrom_idx", F.concat_ws(sep, "chrom", F.col("size").cast("string")).alias("value"))
        text_file(line("\t"), paths["chromsizes"], ["chrom_idx"])
        text_file(line(","), paths["metadata"], ["chrom_idx"], ["chrom,length"])
        total = sizes.agg(F.sum("size")).first()[0] or 0
    metadata.write_catalog("refgenome", paths, {"genome_id": a.genome_id or os.path.basename(a.prefix), "genome_size": total})


def virtual_digest(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = metadata.output_paths("virtual_digest", a.prefix)
    with genome.kept(files.fasta(spark, a.fasta)) as contigs:
        order = contigs.select("chrom", "chrom_idx")
        digest.fragments(contigs, a.cut_on, a.digest_type).join(order, "chrom").sort("chrom_idx", "start").drop("chrom_idx").write.parquet(paths["fragments"])
        stats = digest.digest_stats(spark.read.parquet(paths["fragments"]), contigs.select("chrom"))
        text_file(stats.select(F.to_csv(F.struct(*stats.columns)).alias("value")), paths["digest_stats"], header=[",".join(stats.columns)])
    metadata.write_catalog("virtual_digest", paths, {"digest_type": a.digest_type, "digest_param": a.cut_on})


def hicref(spark: SparkSession, a: argparse.Namespace) -> None:
    text_file(digest.hicref(spark.read.parquet(a.fragments)).select(F.col("line").alias("value")), a.output, ["value"], parts=a.parts)


def prepare_reads(spark: SparkSession, a: argparse.Namespace) -> None:
    """Batches follow the input: records k * batch_size and on; those without a passing read have no file."""
    paths = metadata.output_paths("reads", a.prefix)
    flags = reads.read_metadata(files.fastq(spark, a.fastq), min_read_length=a.min_read_length, max_read_length=a.max_read_length, min_qscore=a.min_qscore, max_qscore=a.max_qscore)
    with genome.kept(flags.drop("quals")) as flagged:
        reads.metadata_columns(flagged).write.parquet(paths["read_metadata"])
        reads.pass_rate(flagged)
        metadata.write_text(paths["summary"], reads.read_summary(flagged).toPandas().to_csv(index=False))  # three rows
        record = F.concat(F.lit("@"), "read_id", F.lit("\n"), "sequence", F.lit("\n+\n"), "qual").alias("value")
        passed = flagged.where("pass_filter").withColumn("chunk", F.floor(F.col("record_no") / a.batch_size))
        number = numbered(passed.select("chunk").distinct(), "chunk", "batch").withColumn("batch", F.col("batch") + 1)  # a row for each output file
        files_out = number.count()
        letters = 2 * F.col("read_length")  # of bases and of qualities
        named = passed.join(F.broadcast(number) if files_out <= genome.BROADCAST_ROWS else number, "chunk").select("batch", "record_no", "read_length", record)
        bgzf.write(sorted_by(named, "batch", each=letters, then=["record_no"]), paths["batches"], ".fq.gz")
        if not (failed := flagged.where("not pass_filter")).isEmpty():
            bgzf.write(sorted_by(failed, "record_no", each=letters).select(record), f"{paths['fail']}.parts", ".fq.gz")
            if a.parts:
                metadata.rename(f"{paths['fail']}.parts", paths["fail"])
            else:
                metadata.join_parts(f"{paths['fail']}.parts", paths["fail"], ".fq.gz")
        metadata.write_catalog("reads", paths, {"batches": files_out, **_json(a.user_metadata)})


def _json(text: str | None) -> dict:
    found = json.loads(text) if text else {}
    if not isinstance(found, dict):
        raise ValueError("user metadata must be a JSON object")
    return found


def _staged(spark: SparkSession, path: str, suffix: str = "") -> str:
    """``-`` stands for standard input: its bytes are copied, a block at a time, to a file that all tasks can read."""
    if path != "-":
        return path
    own = f"{genome.scratch(spark)}/stdin-{uuid.uuid4().hex}{suffix}"
    store, place = bam.opened(own)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place, compression=None) as f:
        shutil.copyfileobj(sys.stdin.buffer, f, 1 << 20)
    return own


def _to_stdout(path: str) -> None:
    """A finished file to standard output, a block at a time; the file goes."""
    store, own = bam.opened(path)
    with store.open_input_stream(own, compression=None) as f:
        shutil.copyfileobj(f, sys.stdout.buffer, 1 << 20)
    sys.stdout.buffer.flush()
    store.delete_file(own)


def _write_alignments(spark: SparkSession, records: DataFrame, a: argparse.Namespace, as_bam: bool) -> None:
    """SAM text, or BAM if asked for or if the output's name says so."""
    head, out = files.sam_header(spark, a.input), files.sam_lines(records)
    path = f"{genome.scratch(spark)}/stdout-{uuid.uuid4().hex}" if a.output == "-" else a.output
    if as_bam or path.endswith(".bam"):
        bam.write(out, path, [r.value for r in head.collect()])
    else:
        text_file(out, path, ["line_no"], head, a.parts and a.output != "-")
    if a.output == "-":
        _to_stdout(path)


def reformat_bam(spark: SparkSession, a: argparse.Namespace) -> None:
    a.input = _staged(spark, a.input)
    if a.input_is_bam and not bam.is_bam(a.input):
        raise ValueError(f"not a BAM file: {a.input}")
    with genome.kept(files.sam(spark, a.input).select("line_no", "qname", "fields")) as records:
        _write_alignments(spark, align.reformat(records, set_bx=a.set_bx_flag), a, a.output_is_bam)


def create_table(spark: SparkSession, a: argparse.Namespace) -> None:
    a.input = _staged(spark, a.input)
    table = align.create_table(files.sam(spark, a.input))
    if a.alignment_haplotypes:
        table = haplotype.apply_tags(table, files.haplotags(spark, a.alignment_haplotypes))
    with genome.kept(table) as found:  # a sort takes its input twice
        found.sort("read_name", "align_idx").write.parquet(a.output)
    align.type_summary(spark.read.parquet(a.output)).show()


def assign_fragments(spark: SparkSession, a: argparse.Namespace) -> None:
    assign.assign_fragments(spark.read.parquet(a.alignments), spark.read.parquet(a.fragments), mapping_quality_cutoff=a.mapping_quality_cutoff, min_overlap_length=a.min_overlap_length, containment=a.containment_cutoff).sort("read_idx", "align_idx").write.parquet(a.output)
    align.value_counts(spark.read.parquet(a.output), "filter_reason").show()


def filter_bam(spark: SparkSession, a: argparse.Namespace) -> None:
    a.input = _staged(spark, a.input)
    with genome.kept(files.sam(spark, a.input).select("line_no", "qname", "fields")) as records:
        kept = align.select_passing(records, spark.read.parquet(a.table), clean_read_name=a.clean_read_name)
        _write_alignments(spark, kept, a, bam.is_bam(a.input))


def consensus(spark: SparkSession, a: argparse.Namespace) -> None:
    haplotype.consensus(spark.read.parquet(a.table), a.threshold).sort("read_name", "align_idx").write.parquet(a.output)


def to_contacts(spark: SparkSession, a: argparse.Namespace) -> None:
    contacts.to_contacts(spark.read.parquet(a.table)).write.parquet(a.output)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """The destination comes last, or first; it is the one that is not there yet. A file of file names has its tables checked."""
    first, last = (metadata.exists(p) for p in (a.paths[0], a.paths[-1]))
    output, inputs = (a.paths[-1], a.paths[:-1]) if first and not last else (a.paths[0], a.paths[1:])
    paths = files.file_names(spark, inputs, fofn=a.fofn)
    rows = files.row_counts(spark, paths)
    if empty := sorted(p for p, n in rows.items() if not n):
        print("no contacts in: " + ", ".join(empty), file=sys.stderr)
    contacts.merge([files.parquet(spark, p) for p in paths]).write.parquet(output)


def downsample(spark: SparkSession, a: argparse.Namespace) -> None:
    unit = {"Gb": 10**9, "Mb": 10**6, "Kb": 10**3}[a.unit]
    names = {round(float(x) * unit): f"{x}{a.unit}" for x in a.increments}
    for target, sample in contacts.downsample(spark.read.parquet(a.contacts), list(names), tolerance=a.tolerance, seed=a.seed, max_attempts=a.max_attempts).items():
        sample.write.parquet(f"{a.prefix}.{names[target]}.contacts.parquet")


def summarize(spark: SparkSession, a: argparse.Namespace) -> None:
    summary.concatemers(spark.read.parquet(a.contacts)).write.parquet(a.concatemers)
    own = spark.read.parquet(a.concatemers)
    report = summary.long_summary(own, files.read_summary_csv(spark, a.read_summary), _json(a.user_metadata))
    metadata.write_text(a.output, report.toPandas().to_csv(index=False))  # a few dozen rows


FORMATS = {"cooler": ("fragments", "chromsizes"), "salsa_bed": (), "pairs": ("chromsizes",), "paired_end_fastq": ("fasta",), "merged_no_dups": ("fasta",)}


def export_contacts(spark: SparkSession, a: argparse.Namespace) -> None:
    missing = [x for x in FORMATS[a.format] if getattr(a, x) is None]
    if missing:
        raise ValueError(f"{a.format} needs: {', '.join('--' + x for x in missing)}")
    own = contacts.quality_filter(spark.read.parquet(a.contacts), min_mapping_quality=a.min_mapping_quality, min_align_base_qscore=a.min_align_base_qscore)
    if a.format == "salsa_bed":
        text_file(_tsv(export.salsa_rows(own)), f"{a.prefix}.salsa.bed", ["read_pair_id"], parts=a.parts)
    elif a.format == "pairs":
        sizes = [(r.chrom, r["size"]) for r in files.chromsizes(spark, a.chromsizes).orderBy("chrom_idx").collect()]
        text_file(_tsv(export.pairs_rows(own)), f"{a.prefix}.pairs", ["readID"], export.pairs_header(sizes), a.parts)
    elif a.format == "paired_end_fastq":
        ends = export.paired_reads(own, genome.genome(spark, a.fasta), a.read_length).persist()
        for n in (1, 2):
            text_file(export.fastq_lines(ends, n), f"{a.prefix}.{n}.fastq", ["pair_id"], parts=a.parts)
        ends.unpersist()
    elif a.format == "merged_no_dups":
        text_file(export.merged_no_dups(own, genome.genome(spark, a.fasta), a.read_length), f"{a.prefix}.mnd.txt", ["value"], parts=a.parts)
    else:
        sizes = files.chromsizes(spark, a.chromsizes)
        bins(sizes, bases(a.resolution)).write.parquet(f"{a.prefix}.cool/bins")
        found = export.pixels(own, export.fragment_bins(spark.read.parquet(a.fragments), sizes, bases(a.resolution)), by_haplotype=a.by_haplotype)
        found = found.sort("bin1_id", "bin2_id")
        (found.write.partitionBy("hap_key") if a.by_haplotype else found.write).parquet(f"{a.prefix}.cool/pixels")


def parquet_to_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    """A folder of CSV parts, each with the header; one task for each part."""
    writer = spark.read.parquet(a.input).write.option("header", True)
    (writer.option("compression", "gzip") if a.output.endswith(".gz") else writer).csv(a.output)


#: Further names of options.
ALIASES = {
    "fragments": ["--fragment-table"], "resolution": ["--cooler-resolution"], "fasta": ["--reference-fasta"], "unit": ["--downsample-unit"], "seed": ["--random-seed"], "tolerance": ["--tol"],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae")
    top.add_argument("--master", help="Spark master; else as configured")
    top.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("--quiet", action="store_true")
    top.add_argument("--parts", action="store_true", help="leave text outputs as folders of numbered parts")
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}

    def command(group: str, name: str, run, *positional: str, **options) -> None:
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        p = made[group].add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, default in options.items():
            flags = ["--" + x.replace("_", "-"), *ALIASES.get(x, [])]
            if isinstance(default, bool):
                p.add_argument(*flags, dest=x, action="store_true", default=default)
            elif isinstance(default, tuple):
                p.add_argument(*flags, dest=x, choices=default, default=default[0])
            else:
                p.add_argument(*flags, dest=x, type=type(default) if default is not None else str, default=default)
        p.set_defaults(run=run)

    command("refgenome", "prepare", prepare_genome, "fasta", "prefix", genome_id=None)
    command("refgenome", "virtual-digest", virtual_digest, "fasta", "cut_on", "prefix", digest_type=("enzyme", "regex", "bin"))
    command("refgenome", "fragments-to-hicref", hicref, "fragments", "output")
    command("reads", "prepare", prepare_reads, "fastq", "prefix", batch_size=10_000, min_read_length=1, max_read_length=150_000, min_qscore=0.0, max_qscore=266.0, user_metadata=None)
    command("alignments", "reformat-bam", reformat_bam, "input", "output", input_is_bam=False, output_is_bam=False, set_bx_flag=False)
    command("alignments", "create-table", create_table, "input", "output", alignment_haplotypes=None)
    command("alignments", "assign-fragments", assign_fragments, "alignments", "fragments", "output", mapping_quality_cutoff=1, min_overlap_length=10, containment_cutoff=99.0)
    command("alignments", "filter-bam", filter_bam, "input", "table", "output", clean_read_name=False)
    command("alignments", "assign-consensus-haplotype", consensus, "table", "output", threshold=0.8)
    command("alignments", "to-contacts", to_contacts, "table", "output")
    command("contacts", "summarize", summarize, "contacts", "read_summary", "concatemers", "output", user_metadata=None)
    command("contacts", "export", export_contacts, "contacts", "format", "prefix", fragments=None, chromsizes=None, fasta=None, resolution="1000", by_haplotype=False, min_mapping_quality=0, min_align_base_qscore=0, read_length=50)
    command("contacts", "merge", merge, fofn=False)
    made["contacts"].choices["merge"].add_argument("paths", nargs="+", metavar="table")
    command("contacts", "downsample", downsample, "contacts", "prefix", unit=("Gb", "Mb", "Kb"), tolerance=0.1, seed=0, max_attempts=100)
    made["contacts"].choices["downsample"].add_argument("increments", nargs="+")
    command("utils", "parquet-to-csv", parquet_to_csv, "input", "output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(session(args), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())

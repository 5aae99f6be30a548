"""Catalogs: small YAML files that describe the outputs of a command."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession

#: The outputs of a command and their suffixes.
KINDS = {
    "refgenome": {"fasta": ".fa", "fai": ".fa.fai", "chromsizes": ".chromsizes", "metadata": ".metadata.csv", "catalog": ".catalog.yaml"},
    "virtual_digest": {"fragments": ".fragments.parquet", "digest_stats": ".digest_stats.csv", "catalog": ".catalog.yaml"},
    "reads": {"batches": ".batch", "fail": ".fail.fq.gz", "read_metadata": ".read_metadata.parquet", "summary": ".summary.csv", "catalog": ".catalog.yaml"},
}
_DRIVERS = {".parquet": "parquet", ".csv": "csv", ".chromsizes": "tsv", ".fai": "tsv", ".fa": "fasta", ".fq.gz": "fastq", ".batch": "fastq"}


def _store(path: str):
    """(file system, path) as Spark sees them."""
    spark = SparkSession.getActiveSession()
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(path: str) -> bool:
    store, own = _store(path)
    return store.exists(own)


def write_text(path: str, text: str) -> None:
    """A small file, wherever Spark can write."""
    store, own = _store(path)
    out = store.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def part_number(name: str) -> tuple[int, str]:
    """Parts in the order of their numbers, however many digits these have; the header comes first, the end last."""
    found = re.match(r"part-(\d+)", name)
    return (int(found[1]) if found else -1 if name == "part-header" else 1 << 62), name


def rename(path: str, to: str) -> None:
    store, own = _store(path)
    store.rename(own, _store(to)[1])


def join_parts(folder: str, path: str, suffix: str = "") -> None:
    """Puts the parts of a folder with this ending into one file, the header's first, and removes the folder; bytes are copied as they are."""
    store, own = _store(folder)
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    names = sorted((str(f.getPath().getName()) for f in store.listStatus(own)), key=part_number)
    parts = [n for n in names if n.startswith("part-") and n.endswith(suffix)]
    out = store.create(_store(path)[1], True)
    try:
        for n in parts:
            part = store.open(jvm.org.apache.hadoop.fs.Path(own, n))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    store.delete(own, True)


def output_paths(kind: str, prefix: str) -> dict[str, str]:
    """The files of a command; any that exists is refused."""
    paths = {name: prefix + suffix for name, suffix in KINDS[kind].items()}
    present = [p for p in paths.values() if exists(p)]
    if present:
        raise OSError(f"outputs exist: {', '.join(present)}")
    return paths


def write_catalog(kind: str, paths: dict[str, str], metadata: dict | None = None) -> str:
    """Writes the catalog beside the outputs, with paths relative to it."""
    folder = os.path.dirname(paths["catalog"])
    lines = [f"name: {kind}", "metadata: " + json.dumps(metadata or {}), "sources:"]
    for name, path in paths.items():
        driver = next((d for s, d in _DRIVERS.items() if path.endswith(s)), None)
        if name != "catalog" and driver:
            lines += [f"  {name}:", f"    driver: {driver}", f"    urlpath: {json.dumps(os.path.relpath(path, folder or '.'))}"]
    write_text(paths["catalog"], "\n".join(lines) + "\n")
    return paths["catalog"]

"""The five tables: column names, types, defaults and domains.

No column is null: sentinels stand for missing values (haplotype -1, phase set 0, fragment 0, chromosome "NULL").
Unsigned types become the next wider signed ones. Casts come last, since ANSI casts overflow loudly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(), "boolean": T.BooleanType(), "float": T.FloatType()}


def _schema(columns: str) -> T.StructType:
    """A schema of "name type, ..", without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


FRAGMENTS = _schema("chrom string, start long, end long, fragment_id long, fragment_length long")
_ALIGN = "read_idx long, align_idx long, align_type string, chrom string, start long, end long, strand boolean, read_name string, read_length long, read_start long, read_end long, mapping_quality short, align_score long, align_base_qscore long, phase_set long, phase_qual short, haplotype byte"
ALIGNMENTS = _schema(_ALIGN)
_ASSIGNED = "pass_filter boolean, filter_reason string, fragment_id long, num_contained_fragments long, num_overlapping_fragments long, overlap_length long, fragment_start long, fragment_end long, perc_of_alignment float, perc_of_fragment float, is_contained boolean"
ASSIGNED = _schema(f"{_ALIGN}, {_ASSIGNED}")
#: What each alignment of a contact keeps; the second one has no phase quality unless asked for.
SIDE = "align_idx long, chrom string, start long, end long, strand boolean, mapping_quality short, align_score long, align_base_qscore long, phase_set long, phase_qual short, haplotype byte, fragment_id long, fragment_start long, fragment_end long".split(", ")
CONTACTS = _schema(
    "read_name string, read_length long, read_idx long, contact_is_direct boolean, contact_is_cis boolean, contact_read_distance int, contact_genome_distance int, contact_fragment_adjacent boolean, contact_fragment_distance int, haplotype_pair_type string, "
    + ", ".join([f"align1_{x}" for x in SIDE] + [f"align2_{x}" for x in SIDE if not x.startswith("phase_qual")])
)
_RANGES = ("contacts", "cis_contacts", "trans_contacts", "short_range_cis_contacts", "long_range_cis_contacts")
PAIR_TYPES = ("phased_h_cis", "phased_h_trans", "phased_sets_differ", "semi_phased", "unphased")
CONCATEMERS = _schema(
    "read_name string, read_length long, read_idx long, read_order long, num_fragments long, "
    + ", ".join(f"{s}_{x} long" for s in ("total", "direct", "indirect") for x in _RANGES)
    + ", "
    + ", ".join(f"haplotype_{x} long" for x in PAIR_TYPES)
    + ", max_indirect_contact_genome_distance int, max_direct_contact_genome_distance int, max_indirect_contact_fragment_distance int, max_direct_contact_fragment_distance int"
)
READ_METADATA = _schema("read_id string, read_length long, qscore float, pass_filter boolean")
HAPLOTAGS = _schema("read_name string, align_idx long, haplotype byte, phase_set long")

TABLES = {"fragments": FRAGMENTS, "alignments": ALIGNMENTS, "assigned": ASSIGNED, "contacts": CONTACTS, "concatemers": CONCATEMERS}
DEFAULTS = {"phase_set": 0, "phase_qual": 0, "haplotype": -1, "pass_filter": True, "filter_reason": "null", "fragment_id": 0, "num_contained_fragments": 0, "num_overlapping_fragments": 0, "overlap_length": 0, "fragment_start": 0, "fragment_end": 0, "perc_of_alignment": 0.0, "perc_of_fragment": 0.0, "is_contained": False}
ALIGN_TYPES = ("unmapped", "primary", "secondary", "supplementary")
FILTER_REASONS = ("null", "pass", "unmapped", "singleton", "low_mq", "short_overlap", "overlap_on_read", "not_on_shortest_path")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order and cast; absent ones get their default."""
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in DEFAULTS]
    if missing:
        raise ValueError(f"columns without a default are missing: {', '.join(missing)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS[f.name])).cast(f.dataType).alias(f.name) for f in schema])


def json_schemas() -> dict[str, str]:
    """JSON description of every table."""
    return {name: schema.json() for name, schema in TABLES.items()}

"""Scalar functions: column expressions, and the few helpers that only look at options."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes in both cases, and of brackets.
COMPLEMENT = ("ACGTRYSWKMBDHVNacgtryswkmbdhvn()[]", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn)(][")
#: Bases that a degenerate code stands for.
DEGENERATE = {"N": "ACGT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "W": "AT", "S": "CG", "M": "AC", "K": "GT", "R": "AG", "Y": "CT"}


def revcomp(seq: Column) -> Column:
    """Reverse complement; characters that are no code stay."""
    return F.translate(F.reverse(seq), *COMPLEMENT)


def revcomp_text(seq: str) -> str:
    return seq[::-1].translate(str.maketrans(*COMPLEMENT))


def replace_degenerate(pattern: str) -> str:
    """Upper-case degenerate codes as character classes."""
    return "".join(f"[{DEGENERATE[c]}]" if c in DEGENERATE else c for c in pattern)


def site_regex(pattern: str) -> str:
    """One regular expression for the alternatives of a motif and their reverse complements."""
    motifs = re.sub(r"[() ]", "", pattern).split("|")
    both = sorted({*motifs, *map(revcomp_text, motifs)})
    out = "(" + "|".join(replace_degenerate(x) for x in both) + ")"
    try:
        re.compile(out)
    except re.error as e:
        raise ValueError(f"no valid pattern: {pattern}") from e
    return out


def bases(value: int | str) -> int:
    """5000, "5000", "5k", "5.1kb", "5m", "5g" as a number of bases."""
    if isinstance(value, int) or value.isdigit():
        return int(value)
    m = re.match(r"(\d+(?:\.\d+)?)([kmg])b?", value, re.I)
    if not m:
        raise ValueError(f"no number of bases: {value}")
    return round(float(m[1]) * {"k": 1e3, "m": 1e6, "g": 1e9}[m[2].lower()])


def mean_qscore(quals: Column) -> Column:
    """Phred score of the mean error probability of an array of scores."""
    total = F.aggregate(quals, F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q.cast("double") / 10))
    return -10 * F.log10(total / F.size(quals))


def _mean_qscores(texts: pa.Array) -> pa.Array:
    """Quality strings to Phred scores of their mean error probability, by counts of each letter; null for empty ones."""
    chance = 10.0 ** (-(np.arange(256) - 33) / 10)
    out = []
    for text in texts:
        raw = text.as_buffer() if text.is_valid else None
        if raw is None or not raw.size:
            out.append(None)
        else:
            out.append(float(-10 * np.log10(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ chance / raw.size)))
    return pa.array(out, pa.float64())


def text_qscore(qual: Column) -> Column:
    """mean_qscore of a quality string without an array of its scores; null if it is empty."""
    return F.arrow_udf(_mean_qscores, "double")(qual)


def hap_key(a: Column, b: Column) -> Column:
    """Both haplotypes in ascending order, "nohap" for unphased."""
    name = lambda h: F.when(h == -1, "nohap").otherwise(h.cast("string"))
    return F.concat_ws("_", name(F.least(a, b)), name(F.greatest(a, b)))


def strand_symbol(strand: Column) -> Column:
    return F.when(strand, "+").otherwise("-")


def junction_symbol(direct: Column) -> Column:
    return F.when(direct, "DJ").otherwise("IJ")


def gap_score(length: Column, aligner: str = "minimap2") -> Column:
    """Penalty of a gap on the read."""
    if aligner == "bwa":
        return 5 + 2 * length
    if aligner != "minimap2":
        raise ValueError(f"unknown aligner: {aligner}")
    return F.least(4 + 2 * length, 24 + length)


def gap_of(aligner: str = "minimap2") -> Callable:
    """The same penalty for arrays of numbers."""
    if aligner == "bwa":
        return lambda d: 5 + 2 * d
    if aligner != "minimap2":
        raise ValueError(f"unknown aligner: {aligner}")
    return lambda d: np.minimum(4 + 2 * d, 24 + d)


def midpoint(start: Column, end: Column) -> Column:
    """Half-way point; halves go to the even neighbour."""
    return F.rint((start + end) * 0.5).cast("long")


def align_type(flag: Column) -> Column:
    """Category of a SAM flag: unmapped, then secondary, then supplementary, then primary."""
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    return F.when(bit(0x4), "unmapped").when(bit(0x100), "secondary").when(bit(0x800), "supplementary").otherwise("primary")


def name_parts(query_name: Column) -> list[Column]:
    """(read name, read_idx, align_idx) of "name:read_idx:align_idx"; counted from the right, so names may hold colons."""
    parts = F.split(query_name, ":")
    n = F.size(parts)
    checked = F.when(n >= 3, parts).otherwise(F.raise_error(F.concat(F.lit("not name:read_idx:align_idx: "), query_name)))
    return [F.array_join(F.slice(checked, 1, n - 2), ":"), F.element_at(checked, -2).cast("long"), F.element_at(checked, -1).cast("long")]


def joined_name(name: Column, read_idx: Column, align_idx: Column) -> Column:
    return F.concat_ws(":", name, read_idx.cast("string"), align_idx.cast("string"))


def display(value: Column) -> Column:
    """A number as text; whole numbers without a fraction."""
    return F.when(value == F.rint(value), value.cast("long").cast("string")).otherwise(value.cast("string"))

"""Virtual digestion of sequences into fragments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import bases, replace_degenerate, revcomp_text, site_regex
from tesserae.operators.ranges import running_total

#: Recognition sites of common restriction enzymes, and where they cut the upper strand.
ENZYMES = {
    "AatII": ("GACGTC", 5), "AfeI": ("AGCGCT", 3), "AflII": ("CTTAAG", 1), "AgeI": ("ACCGGT", 1), "AluI": ("AGCT", 2), "ApaI": ("GGGCCC", 5),
    "ApaLI": ("GTGCAC", 1), "ApeKI": ("GCWGC", 1), "ApoI": ("RAATTY", 1), "AscI": ("GGCGCGCC", 2), "AseI": ("ATTAAT", 2), "AvaI": ("CYCGRG", 1),
    "AvaII": ("GGWCC", 1), "AvrII": ("CCTAGG", 1), "BamHI": ("GGATCC", 1), "BclI": ("TGATCA", 1), "BfaI": ("CTAG", 1), "BglII": ("AGATCT", 1),
    "BsaJI": ("CCNNGG", 1), "BsiWI": ("CGTACG", 1), "BspHI": ("TCATGA", 1), "BsrGI": ("TGTACA", 1), "BssHII": ("GCGCGC", 1), "BstBI": ("TTCGAA", 2),
    "BstEII": ("GGTNACC", 1), "BstNI": ("CCWGG", 2), "BstUI": ("CGCG", 2), "ClaI": ("ATCGAT", 2), "Csp6I": ("GTAC", 1), "CviAII": ("CATG", 1),
    "CviQI": ("GTAC", 1), "DdeI": ("CTNAG", 1), "DpnI": ("GATC", 2), "DpnII": ("GATC", 0), "DraI": ("TTTAAA", 3), "EagI": ("CGGCCG", 1),
    "EcoRI": ("GAATTC", 1), "EcoRII": ("CCWGG", 0), "EcoRV": ("GATATC", 3), "FatI": ("CATG", 0), "Fnu4HI": ("GCNGC", 2), "FseI": ("GGCCGGCC", 6),
    "HaeII": ("RGCGCY", 5), "HaeIII": ("GGCC", 2), "HhaI": ("GCGC", 3), "HinP1I": ("GCGC", 1), "HincII": ("GTYRAC", 3), "HindIII": ("AAGCTT", 1),
    "HinfI": ("GANTC", 1), "HpaI": ("GTTAAC", 3), "HpaII": ("CCGG", 1), "HpyCH4IV": ("ACGT", 1), "HpyCH4V": ("TGCA", 2), "KasI": ("GGCGCC", 1),
    "KpnI": ("GGTACC", 5), "MaeII": ("ACGT", 1), "MboI": ("GATC", 0), "MfeI": ("CAATTG", 1), "MluI": ("ACGCGT", 1), "MseI": ("TTAA", 1),
    "MspI": ("CCGG", 1), "NarI": ("GGCGCC", 2), "NciI": ("CCSGG", 2), "NcoI": ("CCATGG", 1), "NdeI": ("CATATG", 2), "NheI": ("GCTAGC", 1),
    "NlaIII": ("CATG", 4), "NotI": ("GCGGCCGC", 2), "NruI": ("TCGCGA", 3), "NsiI": ("ATGCAT", 5), "PacI": ("TTAATTAA", 5), "PciI": ("ACATGT", 1),
    "PmeI": ("GTTTAAAC", 4), "PmlI": ("CACGTG", 3), "PspGI": ("CCWGG", 0), "PstI": ("CTGCAG", 5), "PvuI": ("CGATCG", 4), "PvuII": ("CAGCTG", 3),
    "RsaI": ("GTAC", 2), "SacI": ("GAGCTC", 5), "SacII": ("CCGCGG", 4), "SalI": ("GTCGAC", 1), "Sau3AI": ("GATC", 0), "Sau96I": ("GGNCC", 1),
    "SbfI": ("CCTGCAGG", 6), "ScaI": ("AGTACT", 3), "ScrFI": ("CCNGG", 2), "SfcI": ("CTRYAG", 1), "SmaI": ("CCCGGG", 3), "SnaBI": ("TACGTA", 3),
    "SpeI": ("ACTAGT", 1), "SphI": ("GCATGC", 5), "SspI": ("AATATT", 3), "StuI": ("AGGCCT", 3), "StyI": ("CCWWGG", 1), "SwaI": ("ATTTAAAT", 4),
    "TaiI": ("ACGT", 4), "TaqI": ("TCGA", 1), "TfiI": ("GAWTC", 1), "Tsp45I": ("GTSAC", 0), "XbaI": ("TCTAGA", 1), "XhoI": ("CTCGAG", 1),
    "XmaI": ("CCCGGG", 1), "XmnI": ("GAANNNNTTC", 5), "ZraI": ("GACGTC", 3),
}


#: Enzymes whose sites read differently on the two strands, or that cut outside of them, as ``SITE(upper/lower)``: bases from the
#: site's end to the cut of each strand, negative ones inside it; a pair in front counts from the site's start, for those that cut on both sides.
STRANDED = {
    "AciI": "CCGC(-3/-1)", "AcuI": "CTGAAG(16/14)", "AlwI": "GGATC(4/5)", "BaeI": "(10/15)ACNNNNGTAYC(12/7)", "BbsI": "GAAGAC(2/6)", "BbvCI": "CCTCAGC(-5/-2)",
    "BbvI": "GCAGC(8/12)", "BccI": "CCATC(4/5)", "BceAI": "ACGGC(12/14)", "BcgI": "(10/12)CGANNNNNNTGC(12/10)", "BciVI": "GTATCC(6/5)", "BfuAI": "ACCTGC(4/8)",
    "BmrI": "ACTGGG(5/4)", "BpmI": "CTGGAG(16/14)", "BpuEI": "CTTGAG(16/14)", "BsaI": "GGTCTC(1/5)", "BsaXI": "(9/12)ACNNNNNCTCC(10/7)", "BseRI": "GAGGAG(10/8)",
    "BsgI": "GTGCAG(16/14)", "BsmAI": "GTCTC(1/5)", "BsmBI": "CGTCTC(1/5)", "BsmFI": "GGGAC(10/14)", "BsmI": "GAATGC(1/-1)", "BspCNI": "CTCAG(9/7)",
    "BspMI": "ACCTGC(4/8)", "BspQI": "GCTCTTC(1/4)", "BsrBI": "CCGCTC(-3/-3)", "BsrDI": "GCAATG(2/0)", "BsrI": "ACTGG(1/-1)", "BssSI": "CACGAG(-5/-1)",
    "BtgZI": "GCGATG(10/14)", "BtsCI": "GGATG(2/0)", "BtsI": "GCAGTG(2/0)", "EarI": "CTCTTC(1/4)", "EciI": "GGCGGA(11/9)", "FauI": "CCCGC(4/6)",
    "FokI": "GGATG(9/13)", "HgaI": "GACGC(5/10)", "HphI": "GGTGA(8/7)", "HpyAV": "CCTTC(6/5)", "MboII": "GAAGA(8/7)", "MlyI": "GAGTC(5/5)",
    "MmeI": "TCCRAC(20/18)", "MnlI": "CCTC(7/6)", "NmeAIII": "GCCGAG(21/19)", "PleI": "GAGTC(4/5)", "SapI": "GCTCTTC(1/4)", "SfaNI": "GCATC(5/9)",
}
_NOTATION = re.compile(r"(?:\((-?\d+)/(-?\d+)\))?([A-Z]+)(?:\((-?\d+)/(-?\d+)\))?")


def cuts(enzyme: str) -> list[tuple[str, int]]:
    """(site on the upper strand, place of the upper strand's cut from the site's first base) for every way in which an enzyme cuts.

    An enzyme is a name, or its notation: ``G^AATTC`` for a site that both strands read alike, ``GGTCTC(1/5)`` and ``(10/12)CGANNNNNNTGC(12/10)``
    for others. Where the lower strand reads the site, the upper one is cut where the enzyme cuts its other strand, counted backwards.
    """
    if enzyme in ENZYMES:
        return [ENZYMES[enzyme]]
    text = STRANDED.get(enzyme, enzyme)
    site, caret, rest = text.partition("^")
    if caret and re.fullmatch("[A-Z]*", site + rest) and site + rest:
        if revcomp_text(site + rest) != site + rest:
            raise ValueError(f"a site that its strands read differently needs the cut of each: {enzyme}")
        return [(site + rest, len(site))]
    found = _NOTATION.fullmatch(text)
    if not found or (found[1] is None and found[4] is None):
        raise ValueError(f"unknown enzyme: {enzyme}")
    site, n = found[3], len(found[3])
    # (upper, lower) cuts from the site's first base, on the strand that reads it
    pairs = [(-int(found[1]), -int(found[2]))] if found[1] is not None else []
    pairs += [(n + int(found[4]), n + int(found[5]))] if found[4] is not None else []
    other = revcomp_text(site)
    return sorted({(site, upper) for upper, _ in pairs} | {(other, n - lower) for _, lower in pairs})


def _scan(ways: list[tuple[str, int]], overlapping: bool) -> Callable:
    """Ascending ends of a sequence: its own and the cuts inside it, of every (pattern, offset)."""
    wrap = "(?=({}))" if overlapping else "{}"
    offsets: dict[str, list[int]] = {}
    for pattern, offset in ways:
        offsets.setdefault(pattern, []).append(offset)
    found = [(re.compile(wrap.format(p)), own) for p, own in offsets.items()]

    def ends(seq: str) -> list[int]:
        n, upper = len(seq), seq.upper()
        return sorted({0, n, *(p for own, shifts in found for m in own.finditer(upper) for k in shifts if 0 < (p := m.start() + k) < n)}) if n else []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([ends(s or "") for s in column.to_pylist()], pa.list_(pa.int64()))

    return run


def endpoints(seq: Column, cut_on: str | int, digest_type: str = "enzyme") -> Column:
    """Ascending array from 0 to the sequence's length, with the cuts between: an enzyme's cuts, a motif's match starts, or every so many bases.

    A chromosome is one string, scanned by a compiled expression for each way to read the site in an Arrow function; sites may overlap, cuts beyond
    the sequence are none, and an empty sequence has no ends.
    """
    if digest_type == "bin":
        width = bases(cut_on)
        n = F.length(seq).cast("long")
        zero = F.lit(0).cast("long")
        return F.when(n >= width, F.concat(F.sequence(zero, n - 1, F.lit(width).cast("long")), F.array(n))).when(n > 0, F.array(zero, n)).otherwise(F.array().cast("array<bigint>"))
    if digest_type == "regex":
        scan = _scan([(site_regex(str(cut_on)), 0)], False)
    elif digest_type == "enzyme":
        scan = _scan([(replace_degenerate(site), at) for site, at in cuts(str(cut_on))], True)
    else:
        raise ValueError(f"unknown digest type: {digest_type}")
    return F.arrow_udf(scan, "array<long>")(seq)


def intervals(ends: Column) -> Column:
    """Array of (start, end) between neighbouring ends."""
    return F.zip_with(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 2, F.size(ends)), lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def fragments(contigs: DataFrame, cut_on: str | int, digest_type: str = "enzyme") -> DataFrame:
    """FRAGMENTS of contigs (chrom, chrom_idx, seq), numbered from 1 over chromosomes in order.

    Numbers within a chromosome come from its array, those before it from the running sum of the arrays' sizes. The
    ends are materialised once, so every sequence is scanned once.
    """
    ends = contigs.select("chrom", "chrom_idx", endpoints(F.col("seq"), cut_on, digest_type).alias("ends")).persist()
    count = ends.select("chrom_idx", F.greatest(F.size("ends") - 1, F.lit(0)).cast("long").alias("n"))
    base = running_total(count, ["chrom_idx"], "n", "total").select("chrom_idx", (F.col("total") - F.col("n")).alias("base"))
    own = ends.join(base, "chrom_idx").select("chrom", "base", F.posexplode(intervals(F.col("ends"))).alias("k", "part"))
    return own.select("chrom", "part.start", "part.end", (F.col("base") + F.col("k") + 1).alias("fragment_id"), (F.col("part.end") - F.col("part.start")).alias("fragment_length"))


def digest_stats(fragment_table: DataFrame, chroms: DataFrame | None = None) -> DataFrame:
    """Number and lengths of each chromosome's fragments; -1 where a chromosome of ``chroms`` has none."""
    stats = fragment_table.groupBy("chrom").agg(
        F.count("*").alias("num_fragments"), F.avg("fragment_length").alias("mean"), F.percentile("fragment_length", 0.5).alias("median"),
        F.min("fragment_length").alias("min"), F.max("fragment_length").alias("max"),
    )
    if chroms is None:
        return stats
    return chroms.select("chrom").join(stats, "chrom", "left").fillna(-1)


def hicref(fragment_table: DataFrame) -> DataFrame:
    """One line for each chromosome: its name and all fragment ends."""
    ends = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("end")), lambda e: e.cast("string")))
    return fragment_table.groupBy("chrom").agg(F.concat_ws(" ", F.col("chrom"), ends).alias("line"))


def chrom_sizes(contigs: DataFrame) -> DataFrame:
    return contigs.select("chrom", "chrom_idx", F.length("seq").cast("long").alias("size"))


def fasta_index(contigs: DataFrame) -> DataFrame:
    """(name, length, offset, line_bases, line_width): where each sequence begins in a file that has it in one line after its name."""
    own = contigs.select("chrom_idx", "chrom", F.length("seq").cast("long").alias("n"), (F.octet_length("chrom") + 2).cast("long").alias("head"))
    sized = own.withColumn("bytes", F.col("head") + F.col("n") + 1)
    placed = running_total(sized, ["chrom_idx"], "bytes", "to")
    return placed.select(F.col("chrom").alias("name"), F.col("n").alias("length"), (F.col("to") - F.col("n") - 1).alias("offset"), F.col("n").alias("line_bases"), (F.col("n") + 1).alias("line_width"))

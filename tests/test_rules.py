"""The rules of single operators on hand-made rows and against brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions import scalars
from tesserae.operators import align, assign, contacts, digest, export, haplotype, intervals, reads, summary
from tesserae.streaming import reads as streams


def test_bases():
    assert [scalars.bases(x) for x in ("5k", "5.1k", "5kb", "5m", "5g", 7)] == [5000, 5100, 5000, 5_000_000, 5_000_000_000, 7]
    with pytest.raises(ValueError):
        scalars.bases("k5")


def test_patterns(spark):
    assert scalars.site_regex("GATC") == "(GATC)"
    assert scalars.site_regex("(R|Y)") == "([AG]|[CT])"
    with pytest.raises(ValueError):
        scalars.site_regex("*")
    row = spark.sql("select 'ACGTNacgtn(R]x' as s").select(scalars.revcomp(F.col("s")).alias("r")).first()
    assert row.r == scalars.revcomp_text("ACGTNacgtn(R]x") == "x[Y)nacgtNACGT"


@pytest.mark.parametrize(("cut_on", "kind", "expected"), [("GATC", "regex", [0, 2, 8, 12]), ("DpnII", "enzyme", [0, 2, 8, 12]), ("NlaIII", "enzyme", [0, 12]), (5, "bin", [0, 5, 10, 12])])
def test_digest(spark, cut_on, kind, expected):
    contigs = spark.createDataFrame([("b", 0, "AAGATCGGGATC"), ("a", 1, "GATCA"), ("empty", 2, "")], "chrom string, chrom_idx long, seq string")
    found = digest.fragments(contigs, cut_on, kind).orderBy("fragment_id").collect()
    own = [r for r in found if r.chrom == "b"]
    assert [own[0].start, *(r.end for r in own)] == expected
    assert [r.fragment_id for r in found] == list(range(1, len(found) + 1))
    assert found[0].chrom == "b"


def test_digest_errors():
    for args in (("NoSuchI", "enzyme"), ("GATC", "magic")):
        with pytest.raises(ValueError):
            digest.endpoints(F.col("seq"), *args)


COMPLEMENTS = str.maketrans("ACGT", "TGCA")
CODES = {"N": "ACGT", "R": "AG", "Y": "CT", **{c: c for c in "ACGT"}}


def brute_cuts(seq, site, cuts):
    """Cuts of the upper strand by reading both strands letter by letter. cuts: (upper, lower) from the site's first base."""
    n, out = len(seq), set()
    for strand, text in ((0, seq), (1, seq.translate(COMPLEMENTS)[::-1])):
        for i in range(n - len(site) + 1):
            if all(text[i + k] in CODES[c] for k, c in enumerate(site)):
                out |= {i + upper if strand == 0 else n - (i + lower) for upper, lower in cuts}
    return sorted({0, n, *(p for p in out if 0 < p < n)})


@pytest.mark.parametrize(("enzyme", "site", "pairs"), [
    ("BsaI", "GGTCTC", [(7, 11)]), ("MnlI", "CCTC", [(11, 10)]), ("AciI", "CCGC", [(1, 3)]), ("BcgI", "CGANNNNNNTGC", [(-10, -12), (24, 22)]), ("BaeI", "ACNNNNGTAYC", [(-10, -15), (23, 18)]),
    ("BsmI", "GAATGC", [(7, 5)]), ("CAR(2/0)", "CAR", [(5, 3)]), ("(1/2)ACT(3/4)", "ACT", [(-1, -2), (6, 7)]), ("G^AATTC", "GAATTC", [(1, 5)]), ("NlaIII", "CATG", [(4, 0)]), ("EcoRI", "GAATTC", [(1, 5)]),
])
def test_cuts_of_both_strands(spark, enzyme, site, pairs):
    rnd = random.Random(enzyme)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (1, 5, 40, 3000)]
    fixed = "".join(rnd.choice(CODES[c]) for c in site)
    seqs += ["".join(rnd.choice([fixed, fixed.translate(COMPLEMENTS)[::-1], "ACGTT", "C"]) for _ in range(80)), fixed, ""]
    rows = spark.createDataFrame(list(enumerate(seqs)), "i long, seq string").select("i", digest.endpoints(F.col("seq"), enzyme).alias("ends")).collect()
    assert {r.i: r.ends for r in rows} == {i: brute_cuts(s, site, pairs) if s else [] for i, s in enumerate(seqs)}


def test_notation_errors():
    for text in ("G^AATTA", "GATC", "GATC(1)", "(1/2)", "gatc(1/2)", "^"):
        with pytest.raises(ValueError, match="enzyme|strand"):
            digest.cuts(text)


def test_matrix_ranges(spark, tmp_path):
    rnd = random.Random(9)
    sizes = spark.createDataFrame([("b", 0, 2500), ("a", 1, 0), ("c", 2, 6000)], "chrom string, chrom_idx long, size long")
    pixels = sorted({(x, y) for _ in range(40) for x, y in [sorted((rnd.randrange(9), rnd.randrange(9)))] if x != 4})
    found = spark.createDataFrame([(x, y, x + y) for x, y in pixels], "bin1_id long, bin2_id long, count int").repartition(3)
    stored = export.store_matrix(found, sizes, 1000, str(tmp_path / "m"))
    assert [(r.bin_id, r["first"]) for r in stored.first_pixel.orderBy("bin_id").collect()] == [(k, sum(x < k for x, _ in pixels)) for k in range(10)]
    assert sorted((r.chrom_idx, r["first"]) for r in export.matrix_index(found, sizes, 1000)[1].collect()) == [(0, 0), (1, 3), (2, 3), (3, 9)]
    assert [(r.bin1_id, r.bin2_id) for r in stored.pixels.orderBy("pixel").collect()] == pixels and [r.pixel for r in stored.pixels.orderBy("pixel").collect()] == list(range(len(pixels)))
    for chrom, first, start, end in (("b", 0, 0, 2500), ("b", 0, 1000, 2000), ("c", 3, 1, 3001), ("c", 3, 0, 10**6), ("a", 3, 0, 5)):
        low, high = first + -(-start // 1000), first + min(-(-end // 1000), {"b": 3, "a": 0, "c": 6}[chrom])
        assert sorted((r.bin1_id, r.bin2_id) for r in export.read_range(stored, chrom, start, end).collect()) == [p for p in pixels if low <= p[0] < high]
    with pytest.raises(ValueError, match="no chromosome"):
        export.read_range(stored, "x", 0, 1)


def test_interval_join_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: [(i, rnd.choice("xy"), s, s + rnd.randint(1, 90)) for i in range(n) for s in [rnd.randint(0, 500)]]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "a long, chrom string, start long, end long")
    right = spark.createDataFrame(b, "b long, chrom string, b_start long, b_end long")
    for width in (1, 17, 1000):
        found = sorted((r.a, r.b) for r in intervals.interval_join(left, right, width=width).collect())
        assert found == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def gap(n):
    return min(4 + 2 * n, 24 + n)


def test_shortest_path_brute_force(spark):
    rnd = random.Random(1)
    rows, best = [], {}
    for read in range(40):
        own = []
        for k in range(rnd.randint(2, 6)):
            s = rnd.randint(0, 80)
            own.append((read, read * 10 + k, s, s + rnd.randint(1, 60), rnd.randint(0, 90), 150))
        rows += own
        order = sorted(own, key=lambda r: (r[3], r[1]))
        costs = []
        for n in range(1, len(order) + 1):
            for pick in itertools.combinations(order, n):
                cost, at = 0, None
                for r in pick:
                    cost += (gap(r[2]) if at is None else gap(abs(r[2] - at))) - r[4]
                    at = r[3]
                costs.append((cost + gap(150 - at), [r[1] for r in pick]))
        best[read] = min(costs)
    frame = spark.createDataFrame(rows, "read_idx long, align_idx long, read_start long, read_end long, align_score long, read_length long")
    found = {r.read_idx: (r.cost, r.path) for r in assign.path_of_reads(frame).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in best.items()}


def folded(rows, length, then):
    """The cheapest way by whole paths: (cost, path) of a fold that keeps every row's best path."""
    ways = []
    for end, idx, start, score in sorted(rows):
        ways.append((*min([(then(start) - score, [idx]), *((c + then(abs(start - e)) - score, [*p, idx]) for c, p, e in ways)]), end))
    return min((c + then(length - e), p) for c, p, e in ways)


@pytest.mark.parametrize("aligner", ["minimap2", "bwa"])
def test_shortest_path_with_ties(spark, aligner):
    rnd = random.Random(4)
    then = gap if aligner == "minimap2" else lambda n: 5 + 2 * n
    rows, best = [], {}
    for read in range(250):
        size, top = rnd.choice([(2, 3), (8, 4), (25, 6), (60, 40)])  # few places and scores: many ways cost the same
        ids = rnd.sample(range(1000), size)
        own = [(e, i, max(0, e - rnd.randint(0, top)), rnd.randint(0, top) * rnd.choice([1, 2, 4])) for i in ids for e in [rnd.randint(0, top)]]
        rows += [(read, i, s, e, score, top) for e, i, s, score in own]
        best[read] = folded(own, top, then)
    frame = spark.createDataFrame(rows, "read_idx long, align_idx long, read_start long, read_end long, align_score long, read_length long").repartition(5)
    assert {r.read_idx: (r.cost, r.path) for r in assign.path_of_reads(frame, aligner).collect()} == best


def test_shortest_path_of_ten_thousand_rows():
    from tesserae.functions.scalars import gap_of

    rnd = random.Random(2)
    rows = sorted((e, i, max(0, e - rnd.randint(0, 3000)), rnd.randint(0, 3000)) for i in range(10_000) for e in [rnd.randint(1, 4_000_000)])
    began = time.perf_counter()
    cost, path = assign.cheapest_way(np.array([r[0] for r in rows]), *([r[k] for r in rows] for k in (1, 2, 3)), 4_000_000, gap_of())
    assert time.perf_counter() - began < 30 and len(path) > 100
    own = {r[1]: r for r in rows}
    at, total = 0, 0
    for i in path:
        total += gap(abs(own[i][2] - at)) - own[i][3]
        at = own[i][0]
    assert total + gap(4_000_000 - at) == cost


def test_interval_join_of_short_and_long_intervals(spark):
    rnd = random.Random(6)
    sizes = [1, 50, 50, 50, 399, 400, 401, 3200, 30_000, 900_000]
    make = lambda n: [(i, rnd.choice("xy"), s, s + rnd.choice(sizes)) for i in range(n) for s in [rnd.choice([rnd.randint(-50, 5000), rnd.randint(0, 2_000_000)])]]
    a, b = make(300), make(300)
    left = spark.createDataFrame(a, "a long, chrom string, start long, end long")
    right = spark.createDataFrame(b, "b long, chrom string, b_start long, b_end long")
    for x, y in ((left, right), (left, right.where("b_end - b_start <= 50")), (left.where("end - start <= 50"), right), (left.where("end - start > 5000"), right.where("b_end - b_start = 50"))):
        for width in (50, 400):
            found = sorted((r.a, r.b) for r in intervals.interval_join(x, y, width=width).collect())
            i, j = ({r[0] for r in d.select(n).collect()} for d, n in ((x, "a"), (y, "b")))
            assert found == sorted((p[0], q[0]) for p in a for q in b if p[0] in i and q[0] in j and p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    assert intervals.interval_join(left.limit(0), right, width=50).count() == 0


def test_long_intervals_stay_few_rows(spark):
    """5 Mb beside 50 bases: rows are repeated for each level, not for each 50 bases."""
    long = spark.range(40).selectExpr("id as a", "'c' as chrom", "id * 1000000 as start", "id * 1000000 + 5000000 as end")
    short = spark.range(20_000).selectExpr("id as b", "'c' as chrom", "id * 2000 as b_start", "id * 2000 + 50 as b_end")
    for rows, names in ((long, ("start", "end")), (short, ("b_start", "b_end"))):
        rows = rows.withColumn("level", intervals._level(*names, 50))
        assert intervals._cells(rows, *names, F.array("level"), 50).count() <= 2 * rows.count()
    n = intervals.interval_join(long, short, width=50).count()
    assert n == sum(1 for i in range(40) for j in range(20_000) if i * 10**6 < j * 2000 + 50 and j * 2000 < i * 10**6 + 5 * 10**6)


def alignment(i, read=0, chrom="c", start=0, end=100, **more):
    row = {"read_idx": read, "align_idx": i, "align_type": "primary", "chrom": chrom, "start": start, "end": end, "strand": True, "read_name": f"r{read}", "read_length": 1000, "read_start": 100 * i, "read_end": 100 * i + 90, "mapping_quality": 60, "align_score": 100, "align_base_qscore": 20, "phase_set": 0, "phase_qual": 0, "haplotype": -1}
    return row | more


def frame(spark, rows, schema=schemas.ALIGNMENTS):
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


@pytest.fixture
def fragment_table(spark):
    return spark.createDataFrame([("c", 0, 100, 1, 100), ("c", 100, 250, 2, 150), ("d", 0, 400, 3, 400)], "chrom string, start long, end long, fragment_id long, fragment_length long")


def test_filter_reasons(spark, fragment_table):
    rows = [
        alignment(0, align_type="unmapped", chrom="NULL", start=0, end=0), alignment(1, mapping_quality=1), alignment(2, start=1000, end=1100),
        alignment(3, read=1), alignment(4, read=1, mapping_quality=0),
        alignment(5, read=2, read_start=0, read_end=50, align_score=10), alignment(6, read=2, read_start=0, read_end=50, align_score=20), alignment(7, read=2, read_start=0, read_end=50, align_score=20),
        alignment(8, read=3, read_start=0, read_end=500), alignment(9, read=3, read_start=500, read_end=1000), alignment(10, read=3, read_start=400, read_end=410, align_score=0),
    ]
    out = {r.align_idx: r for r in assign.assign_fragments(frame(spark, rows), fragment_table).collect()}
    assert [out[i].filter_reason for i in range(11)] == ["unmapped", "low_mq", "short_overlap", "singleton", "low_mq", "overlap_on_read", "pass", "overlap_on_read", "pass", "pass", "not_on_shortest_path"]
    assert out[8].fragment_id == 1 and out[8].is_contained and out[2].fragment_id == 0
    assert out[0].pass_filter is False and out[6].pass_filter is True


def test_best_overlap(spark, fragment_table):
    rows = [alignment(0, start=50, end=150), alignment(1, start=90, end=260), alignment(2, start=0, end=250)]
    out = {r.align_idx: r for r in assign.assign_fragments(frame(spark, rows), fragment_table).collect()}
    assert [(out[i].fragment_id, out[i].overlap_length, out[i].num_overlapping_fragments, out[i].num_contained_fragments) for i in range(3)] == [(1, 50, 2, 0), (2, 150, 2, 1), (2, 150, 2, 2)]


def test_contacts(spark):
    base = {"pass_filter": True, "filter_reason": "pass", "num_contained_fragments": 0, "num_overlapping_fragments": 1, "overlap_length": 50, "perc_of_alignment": 1.0, "perc_of_fragment": 1.0, "is_contained": False}
    rows = [
        base | alignment(0, start=300, end=350, haplotype=1, phase_set=5) | {"fragment_id": 3, "fragment_start": 300, "fragment_end": 401},
        base | alignment(1, start=10, end=60, haplotype=2, phase_set=5) | {"fragment_id": 1, "fragment_start": 0, "fragment_end": 100},
        base | alignment(2, chrom="d", start=0, end=50) | {"fragment_id": 9, "fragment_start": 0, "fragment_end": 100},
        base | alignment(3, read=1) | {"fragment_id": 1, "fragment_start": 0, "fragment_end": 100},
    ]
    out = contacts.to_contacts(frame(spark, rows, schemas.ASSIGNED)).orderBy("align1_align_idx", "align2_align_idx")
    assert out.schema.names == schemas.CONTACTS.names and len(out.columns) == 37
    a, b, c = out.collect()
    assert (a.align1_align_idx, a.align2_align_idx, a.contact_is_direct, b.align1_align_idx, c.align1_align_idx) == (0, 2, False, 1, 1)
    assert (b.align2_align_idx, b.contact_is_direct, b.contact_read_distance, b.contact_genome_distance, b.contact_fragment_distance, b.contact_fragment_adjacent) == (0, True, 10, 240, 300, False)
    assert (a.haplotype_pair_type, b.haplotype_pair_type, a.contact_genome_distance) == ("trans", "phased_h_trans", 0)
    totals = summary.concatemers(out).first()
    assert (totals.total_contacts, totals.direct_contacts, totals.read_order, totals.num_fragments, totals.total_trans_contacts, totals.haplotype_phased_h_trans) == (3, 2, 3, 3, 2, 1)
    assert contacts.to_contacts(frame(spark, rows[3:], schemas.ASSIGNED)).count() == 0
    genome = spark.createDataFrame([("c", "ACGT" * 200), ("d", "GGCA" * 200)], "chrom string, seq string")
    pair = export.paired_reads(out, genome, 50).orderBy("pair_id").first()
    assert (pair.pair_id, pair.seq1, len(pair.seq2)) == ("r0:0001", ("ACGT" * 200)[300:350], 50)
    line = export.merged_no_dups(out, genome, 50).orderBy("value").first().value
    assert len(line.split(" ")) == 16
    assert len(export.pairs_header([("c", 800)])) == 4


def test_consensus(spark):
    votes = lambda read, haps: [alignment(10 * read + k, read=read, haplotype=h) | {"pass_filter": ok} for k, (h, ok) in enumerate(haps)]
    rows = votes(0, [(1, True), (1, True), (1, True), (2, True), (-1, False)]) + votes(1, [(1, True), (1, True), (-1, True)]) + votes(2, [(1, True), (2, True)])
    schema = schemas.T.StructType([*schemas.ALIGNMENTS.fields, schemas.ASSIGNED["pass_filter"]])
    data = frame(spark, rows, schema)
    got = lambda t: {r.align_idx: r.haplotype for r in haplotype.consensus(data, t).collect()}
    out = got(0.7)
    assert [out[i] for i in range(5)] == [1] * 5
    assert out[12] == -1 and out[21] == 2
    assert got(0.75)[3] == 2  # strictly above the threshold only


def test_read_statistics(spark):
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 60) for _ in range(101)]
    out = reads.length_stats(spark.createDataFrame([(n,) for n in lengths], "read_length long")).first()
    total, run = sum(lengths), 0
    for n in sorted(lengths):
        run += n
        if run > total / 2:
            break
    assert (out.num_sequences, out.total_bases, out.N50, out.min, out.max) == (101, total, n, min(lengths), max(lengths))
    assert reads.length_stats(spark.createDataFrame([], "read_length long")).count() == 0


def test_quality_bounds(spark):
    rows = [("a", 500, 6.0), ("b", 5000, 6.0), ("c", 500, 12.0), ("d", 499, 7.0)]
    data = spark.createDataFrame(rows, "read_id string, read_length long, qscore float")
    out = reads.with_pass_flag(data, min_read_length=500, max_read_length=5000, min_qscore=6, max_qscore=12)
    assert [r.pass_filter for r in out.orderBy("read_id").collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        reads.pass_rate(out.where("not pass_filter"))


def test_downsample_is_nested(spark):
    rows = [(f"r{i}", 100 + i % 7, i) for i in range(400)]
    table = spark.createDataFrame(rows, "read_name string, read_length long, x long")
    out = contacts.downsample(table, [5000, 20_000, 10**9], tolerance=0.1, seed=3)
    small, large = ({r.read_name for r in out[t].collect()} for t in (5000, 20_000))
    assert small < large and sorted(out) == [5000, 20_000]
    total = out[20_000].agg(F.sum("read_length")).first()[0]
    assert abs(total - 20_000) < 2000
    with pytest.raises(ValueError):
        contacts.downsample(table, [10**9])
    with pytest.raises(ValueError):
        contacts.downsample(table, [50], tolerance=1e-9, max_attempts=2)


def test_select_passing(spark):
    records = spark.createDataFrame([(0, "a:0:0"), (1, "a:b:0:1")], "line_no long, qname string")
    table = spark.createDataFrame([(1, True), (0, False)], "align_idx long, pass_filter boolean")
    assert [r.qname for r in align.select_passing(records, table, clean_read_name=True).collect()] == ["a:b"]
    with pytest.raises(ValueError):
        align.select_passing(records, table.union(spark.createDataFrame([(7, True)], table.schema)))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"r{i}", "A" * (i + 1), "I" * (i + 1), i + 1, float(i % 20)) for i in range(50)]
    data = spark.createDataFrame(rows, "read_id string, sequence string, qual string, read_length long, qscore float")
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    bounds = {"min_read_length": 5, "max_read_length": 40, "min_qscore": 2, "max_qscore": 18}
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), data.schema)
    streams.prepare(stream, str(tmp_path / "out"), str(tmp_path / "check"), **bounds).awaitTermination()
    expected = {r.read_id for r in reads.with_pass_flag(data, **bounds).where("pass_filter").collect()}
    assert {r.read_id for r in spark.read.parquet(str(tmp_path / "out/pass")).collect()} == expected
    assert spark.read.parquet(str(tmp_path / "out/read_metadata")).count() == 50

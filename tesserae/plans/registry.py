"""The library's queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import align, assign, contacts, digest, export, haplotype, intervals, reads, summary
from tesserae.plans import bindings as b
from tesserae.sources import genome
from tesserae.streaming import reads as streams
from tesserae.streaming.fastq import fastq_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RESOLUTION = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# CTEs that later oracles build on
_BASE = f"with alignments as ({b.ALIGN_SQL}), fragments as ({b.FRAG_SQL})"
_OVER = (
    _BASE
    + """, hits as (select align_idx, fragment_id, f.start as fragment_start, f."end" as fragment_end, least(a."end", f."end") - greatest(a.start, f.start) as overlap_length,
  100.0::double * (least(a."end", f."end") - greatest(a.start, f.start)) / (f."end" - f.start) >= 99.0 as is_contained
  from alignments a join fragments f on a.chrom = f.chrom and a.start < f."end" and f.start < a."end" where align_type <> 'unmapped')"""
)
_BEST = (
    _OVER
    + """, best as (select *, (select count(*) from hits o where o.align_idx = x.align_idx) as num_overlapping_fragments,
  (select count(*) from hits o where o.align_idx = x.align_idx and is_contained) as num_contained_fragments
  from (select *, row_number() over (partition by align_idx order by overlap_length desc, fragment_id) as rk from hits) x where rk = 1)"""
)
_CASCADE = (
    _BEST
    + """, joined as (select a.*, coalesce(b.fragment_id, 0) as fragment_id, coalesce(b.overlap_length, 0) as overlap_length, coalesce(b.fragment_start, 0) as fragment_start,
  coalesce(b.fragment_end, 0) as fragment_end from alignments a left join best b using (align_idx)),
first_ as (select *, case when align_type = 'unmapped' then 'unmapped' when mapping_quality <= 1 then 'low_mq' when overlap_length < 10 then 'short_overlap' end as r1 from joined),
second_ as (select *, count(*) over (partition by read_idx, r1 is null) as n_ok, row_number() over (partition by read_idx, r1 is null, read_start, read_end order by align_score desc, align_idx) as place from first_),
filtered as (select *, coalesce(r1, case when n_ok = 1 then 'singleton' when place > 1 then 'overlap_on_read' else 'pass' end) as filter_reason from second_)"""
)
_CONTACTS = (
    _CASCADE
    + """, placed as (select *, row_number() over (partition by read_name order by read_start, align_idx) as pos, cast(round_even((fragment_start + fragment_end) * 0.5, 0) as bigint) as mid from filtered where filter_reason = 'pass'),
raw as (select x.read_name, x.read_length, x.read_idx, y.pos - x.pos = 1 as contact_is_direct, y.read_start - x.read_end as contact_read_distance, x.fragment_id > y.fragment_id as swap, x, y from placed x join placed y on x.read_name = y.read_name and x.pos < y.pos),
ordered as (select *, case when swap then y else x end as a, case when swap then x else y end as b from raw),
contacts as (select read_name, read_length, read_idx, contact_is_direct, a.chrom = b.chrom as contact_is_cis, contact_read_distance,
  case when a.chrom = b.chrom then b.start - a."end" else 0 end as contact_genome_distance, a.chrom = b.chrom and abs(b.fragment_id - a.fragment_id) <= 1 as contact_fragment_adjacent,
  case when a.chrom = b.chrom then b.mid - a.mid else 0 end as contact_fragment_distance,
  case when a.chrom <> b.chrom then 'trans' when a.haplotype = -1 and b.haplotype = -1 then 'unphased' when a.haplotype = -1 or b.haplotype = -1 then 'semi_phased'
    when a.phase_set <> b.phase_set then 'phased_sets_differ' when a.haplotype = b.haplotype then 'phased_h_cis' else 'phased_h_trans' end as haplotype_pair_type, a, b from ordered)"""
)
_SIZES = f""", sizes as (select chrom, max("end") as size, row_number() over (order by chrom) - 1 as chrom_idx from fragments group by chrom),
offsets as (select *, coalesce(sum(cast(ceil(size / {RESOLUTION}) as bigint)) over (order by chrom_idx rows between unbounded preceding and 1 preceding), 0) as first_bin from sizes),
fbin as (select fragment_id, cast(first_bin + floor(mid / {RESOLUTION}) as bigint) as bin_id from (select *, cast(round_even((start + "end") * 0.5, 0) as bigint) as mid from fragments) f join offsets using (chrom) where mid < size)"""
_CONCAT = (
    _CONTACTS
    + """, concat_ as (select read_name, max(read_length) as read_length, max(read_idx) as read_idx, count_if(contact_is_direct) + 1 as read_order,
  (select count(distinct u) from unnest(list(a.fragment_id) || list(b.fragment_id)) t(u)) as num_fragments,
  """
    + ", ".join(
        f"count_if({p} and {c}) as {n}_{k}"
        for n, p in (("total", "true"), ("direct", "contact_is_direct"), ("indirect", "not contact_is_direct"))
        for k, c in (("contacts", "true"), ("cis_contacts", "contact_is_cis"), ("trans_contacts", "not contact_is_cis"), ("short_range_cis_contacts", "contact_is_cis and contact_fragment_distance < 20000"), ("long_range_cis_contacts", "contact_is_cis and contact_fragment_distance >= 20000"))
    )
    + ", "
    + ", ".join(f"count_if(haplotype_pair_type = '{t}') as haplotype_{t}" for t in ("phased_h_cis", "phased_h_trans", "phased_sets_differ", "semi_phased", "unphased"))
    + ", "
    + ", ".join(f"coalesce(max(contact_{k}_distance) filter ({'' if n == 'direct' else 'not '}contact_is_direct), 0) as max_{n}_contact_{k}_distance" for k in ("genome", "fragment") for n in ("indirect", "direct"))
    + " from contacts group by read_name)"
)


def _assigned(spark: SparkSession, sf_dir: str, fragments: DataFrame | None = None, *, path_filter: bool = False) -> DataFrame:
    return assign.assign_fragments(b.alignments(spark, sf_dir), fragments or b.fragments(spark, sf_dir), width=200, path_filter=path_filter)


def _contacts(spark: SparkSession, sf_dir: str, fragments: DataFrame | None = None) -> DataFrame:
    return contacts.to_contacts(_assigned(spark, sf_dir, fragments))


@query(_OVER + ' select align_idx, fragment_id, overlap_length, is_contained from hits')
def J1_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.overlaps(b.alignments(spark, sf_dir), b.fragments(spark, sf_dir), width=200).select("align_idx", "fragment_id", "overlap_length", "is_contained")


@query(_BEST + " select align_idx, fragment_id, overlap_length, num_overlapping_fragments, num_contained_fragments from best")
def W1_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assign.overlaps(b.alignments(spark, sf_dir), b.fragments(spark, sf_dir), width=200)
    return assign.best_overlap(pairs).select("align_idx", "fragment_id", "overlap_length", "num_overlapping_fragments", "num_contained_fragments")


@query(_CASCADE + " select align_idx, filter_reason, filter_reason = 'pass' as pass_filter, fragment_id from filtered")
def F2_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("align_idx", "filter_reason", "pass_filter", "fragment_id")


_STEP = "least(4 + 2 * {0}, 24 + {0})"
_PATHED = (
    _CASCADE.replace("with ", "with recursive ", 1)
    + f""", left_ as (select *, row_number() over (partition by read_idx order by read_end, align_idx) as pos, count(*) over (partition by read_idx) as n_left from filtered where filter_reason = 'pass'),
many as (select * from left_ where n_left > 1),
ways as (select read_idx, pos, read_end, read_length, {_STEP.format("read_start")} - align_score as cost, [align_idx] as path from many
  union all select w.read_idx, r.pos, r.read_end, r.read_length, w.cost + {_STEP.format("abs(r.read_start - w.read_end)")} - r.align_score, list_append(w.path, r.align_idx) from ways w join many r on r.read_idx = w.read_idx and r.pos > w.pos),
path_ as (select read_idx, arg_min(path, (cost + {_STEP.format("(read_length - read_end)")}, path)) as path from ways group by read_idx)"""
)


@query(_PATHED + " select align_idx, case when filter_reason = 'pass' and path is not null and not list_contains(path, align_idx) then 'not_on_shortest_path' else filter_reason end as filter_reason, fragment_id, overlap_length from filtered left join path_ using (read_idx)")
def F7_assign_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir, path_filter=True).select("align_idx", "filter_reason", "fragment_id", "overlap_length")


_PATH = f"""with recursive alignments as ({b.ALIGN_SQL}),
ok as (select *, row_number() over (partition by read_idx order by read_end, align_idx) as pos, count(*) over (partition by read_idx) as n from alignments),
rows_ as (select * from ok where n > 1),
ways as (select read_idx, pos, read_end, read_length, least(4 + 2 * read_start, 24 + read_start) - align_score as cost from rows_
  union all select w.read_idx, r.pos, r.read_end, r.read_length, w.cost + least(4 + 2 * abs(r.read_start - w.read_end), 24 + abs(r.read_start - w.read_end)) - r.align_score
  from ways w join rows_ r on r.read_idx = w.read_idx and r.pos > w.pos)
select read_idx, min(cost + least(4 + 2 * (read_length - read_end), 24 + (read_length - read_end))) as cost from ways group by read_idx"""


@query(_PATH)
def G1_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.path_of_reads(b.alignments(spark, sf_dir)).select("read_idx", "cost")


@query(
    _CONTACTS
    + " select read_name, read_idx, a.align_idx as align1_align_idx, b.align_idx as align2_align_idx, contact_is_direct, contact_is_cis, contact_read_distance, contact_genome_distance, contact_fragment_adjacent, contact_fragment_distance, haplotype_pair_type from contacts"
)
def C2_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("read_name", "read_idx", "align1_align_idx", "align2_align_idx", "contact_is_direct", "contact_is_cis", "contact_read_distance", "contact_genome_distance", "contact_fragment_adjacent", "contact_fragment_distance", "haplotype_pair_type")


_PIXELS = _CONTACTS + _SIZES + """ select least(p.bin_id, q.bin_id) as bin1_id, greatest(p.bin_id, q.bin_id) as bin2_id{key}, cast(count(*) as integer) as count
from contacts c join fbin p on c.a.fragment_id = p.fragment_id join fbin q on c.b.fragment_id = q.fragment_id group by all"""


def _pixels(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    fragments = b.fragments(spark, sf_dir).persist()  # read by the overlaps, the bins and the sizes
    bins = export.fragment_bins(fragments, b.chromsizes(spark, sf_dir, fragments), RESOLUTION)
    return export.pixels(_contacts(spark, sf_dir, fragments), bins, **options)


@query(_PIXELS.format(key=""))
def flagship_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir)


_HAP = "case when {0} = -1 then 'nohap' else cast({0} as varchar) end"


@query(_PIXELS.format(key=", " + _HAP.format("least(c.a.haplotype, c.b.haplotype)") + " || '_' || " + _HAP.format("greatest(c.a.haplotype, c.b.haplotype)") + " as hap_key"))
def A16_pixels_by_haplotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir, by_haplotype=True)


@query(_BASE + _SIZES + f' select cast(first_bin + k as bigint) as bin_id, chrom, k * {RESOLUTION} as start, least((k + 1) * {RESOLUTION}, size) as "end" from offsets, generate_series(0, cast(ceil(size / {RESOLUTION}) as bigint) - 1) g(k)')
def X26_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.bins(b.chromsizes(spark, sf_dir), RESOLUTION)


@query(_BASE + _SIZES + " select fragment_id, bin_id from fbin")
def J2_fragment_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.fragment_bins(b.fragments(spark, sf_dir), b.chromsizes(spark, sf_dir), RESOLUTION)


_INDEX = (
    _PIXELS.format(key="").replace(" select least(", ", pix as (select least(", 1)
    + "), nbins as (select cast(sum(cast(ceil(size / " + str(RESOLUTION) + ") as bigint)) as bigint) as n from sizes), rows_ as (select bin1_id, count(*) as n from pix group by bin1_id) "
    + "select 'bin' as kind, cast(k as bigint) as id, cast(coalesce((select sum(n) from rows_ where bin1_id < k), 0) as bigint) as first from nbins, generate_series(0, n) g(k) "
    + "union all select 'chrom', chrom_idx, cast(first_bin as bigint) from offsets union all select 'chrom', (select count(*) from sizes), n from nbins"
)


@query(_INDEX)
def K10_matrix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pixel of every bin and first bin of every chromosome of the flagship's matrix, each with the total at its end."""
    sizes = b.chromsizes(spark, sf_dir)
    first_pixel, first_bin = export.matrix_index(flagship_pixels(spark, sf_dir), sizes, RESOLUTION)
    kind = lambda k, df, i: df.select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("id"), F.col("first").cast("long").alias("first"))
    return kind("bin", first_pixel, "bin_id").union(kind("chrom", first_bin, "chrom_idx"))


@query(_PIXELS.format(key="").replace(" select least(", ", pix as (select least(", 1) + ") select p.* from pix p join offsets o on o.chrom_idx = 1 where bin1_id >= first_bin + 2 and bin1_id < first_bin + least(9, ceil(size / " + str(RESOLUTION) + "))")
def K10_matrix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the matrix for a range of the second chromosome, read by the index."""
    stored = export.store_matrix(flagship_pixels(spark, sf_dir), b.chromsizes(spark, sf_dir), RESOLUTION)
    chrom = stored.chroms.where("chrom_idx = 1").first()["chrom"]
    return export.read_range(stored, chrom, 2 * RESOLUTION, 9 * RESOLUTION).drop("pixel")


_NUMBERED = _CONTACTS + ", c as (select *, row_number() over (partition by read_name order by a.align_idx, b.align_idx) - 1 as contact_idx from contacts)"


@query(
    _NUMBERED
    + """ select 'read' || read_name || '_' || contact_idx as "readID", a.chrom as chr1, cast(round_even((a.fragment_start + a.fragment_end) * 0.5, 0) as bigint) as pos1, b.chrom as chr2, cast(round_even((b.fragment_start + b.fragment_end) * 0.5, 0) as bigint) as pos2,
  case when a.strand then '+' else '-' end as strand1, case when b.strand then '+' else '-' end as strand2, case when contact_is_direct then 'DJ' else 'IJ' end as pair_type, a.align_idx as align1_idx, b.align_idx as align2_idx, contact_read_distance as distance_on_read from c"""
)
def K11_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.pairs_rows(_contacts(spark, sf_dir))


_SALSA = "select {0}.chrom as chrom, {0}.start as start, {0}.\"end\" as \"end\", 'read' || read_name || '_' || contact_idx || '/{1}' as read_pair_id, {0}.mapping_quality as mapping_quality, case when {0}.strand then '+' else '-' end as strand from c"


@query(_NUMBERED + " " + _SALSA.format("a", 1) + " union all " + _SALSA.format("b", 2))
def K12_salsa_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.salsa_rows(_contacts(spark, sf_dir))


@query(_CONTACTS + " select read_name, a.align_idx as align1_align_idx, b.align_idx as align2_align_idx from contacts where a.mapping_quality > 30 and b.mapping_quality > 30 and a.align_base_qscore > 5 and b.align_base_qscore > 5 and a.fragment_id <> b.fragment_id")
def F9_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = contacts.quality_filter(_contacts(spark, sf_dir), min_mapping_quality=30, min_align_base_qscore=5)
    return contacts.no_self_ligation(kept).select("read_name", "align1_align_idx", "align2_align_idx")


_GENOME = f", genome as (select chrom, seq from (select event_type as chrom, row_number() over (order by event_type) - 1 as doc_id from (select distinct event_type from events) t) c join ({b.SEQ_SQL}) s using (doc_id))"
_PLACED = (
    _CONTACTS
    + _GENOME
    + """, c as (select *, greatest(a.mid, 50) as pos1, greatest(b.mid, 50) as pos2, read_name || ':' || lpad(cast(row_number() over (partition by read_name order by a.align_idx, b.align_idx) as varchar), 4, '0') as pair_id from contacts where a.fragment_id <> b.fragment_id),
e as (select c.*, substr(g.seq, pos1 - 49, 50) as s1, substr(h.seq, pos2 - 49, 50) as s2 from c join genome g on g.chrom = c.a.chrom join genome h on h.chrom = c.b.chrom)"""
)
_RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


def _genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.sequences(spark, sf_dir).select("chrom_idx", "seq").join(b.chroms(spark, sf_dir), "chrom_idx").select("chrom", "seq")


@query(_PLACED + f" select pair_id, case when a.strand then s1 else {_RC.format('s1')} end as seq1, case when b.strand then s2 else {_RC.format('s2')} end as seq2 from e")
def K13_paired_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.paired_reads(_contacts(spark, sf_dir), _genome(spark, sf_dir), 50)


@query(
    _PLACED
    + f""" select concat_ws(' ', a.strand::int, a.chrom, pos1, a.fragment_id, b.strand::int, b.chrom, pos2, b.fragment_id, '60 50M', case when a.strand then {_RC.format('s1')} else s1 end,
  '60 50M', case when b.strand then {_RC.format('s2')} else s2 end, pair_id || ':1', pair_id || ':2') as value from e"""
)
def K14_merged_no_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.merged_no_dups(_contacts(spark, sf_dir), _genome(spark, sf_dir), 50)


@query(_CASCADE + " select concat_ws(':', read_name, read_idx, align_idx) as qname from filtered where filter_reason = 'pass'")
def J11_select_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    records = b.alignments(spark, sf_dir).select(scalars.joined_name(F.col("read_name"), F.col("read_idx"), F.col("align_idx")).alias("qname"))
    return align.select_passing(records, rows)


@query("select event_id, case when f & 4 > 0 then 'unmapped' when f & 256 > 0 then 'secondary' when f & 2048 > 0 then 'supplementary' else 'primary' end as align_type from (select event_id, (event_id % 2) * 4 + (event_id % 3 // 2) * 256 + (event_id % 5 // 4) * 2048 as f from events)")
def X22_align_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    flag = ((i % 2) * 4 + F.floor(i % 3 / 2) * 256 + F.floor(i % 5 / 4) * 2048).cast("int")
    return e.select("event_id", scalars.align_type(flag).alias("align_type"))


@query(_BASE + _SIZES + " select cast(sum(size) as bigint) as genome_size from sizes")
def A24_genome_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.chromsizes(spark, sf_dir).agg(F.sum("size").alias("genome_size"))


@query(_CONCAT + " select * from concat_")
def A9_concatemers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.concatemers(_contacts(spark, sf_dir))


@query(_CONCAT + ", bins(bin, lo, hi) as (values " + ", ".join(str(x) for x in summary.ORDER_BINS) + ") select i as i, bin, count(read_name) as count, round(100.0::double * count(read_name) / (select count(*) from concat_), 6) as perc from (select *, row_number() over (order by lo) - 1 as i from bins) left join concat_ on read_order > lo and read_order <= hi group by i, bin")
def A20_read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.order_histogram(summary.concatemers(_contacts(spark, sf_dir))).withColumn("perc", F.round("perc", 6))


_SUMS = " union all ".join(
    f"select '{s}' as subset, '{k}' as kind, coalesce(sum({s}_{k}), 0)::bigint as count, 100.0::double * sum({s}_{k}) / sum({s}_contacts) as perc from concat_"
    for s in ("total", "direct", "indirect")
    for k in ("contacts", "cis_contacts", "trans_contacts", "short_range_cis_contacts", "long_range_cis_contacts")
)


@query(_CONCAT + f" select subset, kind, count, round(perc, 6) as perc from ({_SUMS}) s")
def A17_contact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.contact_sums(summary.concatemers(_contacts(spark, sf_dir))).withColumn("perc", F.round("perc", 6))


_READS_OK = "select n_chars as read_length, n_chars >= 500 and n_chars < 5000 and doc_id % 20 >= 6 and doc_id % 20 < 12 as pass_filter from documents"
_LENGTHS = "select count(*) as n, cast(sum(read_length) as bigint) as b, min(read_length) filter (run > total / 2) as n50 from (select read_length, sum(read_length) over (order by read_length) as run, sum(read_length) over () as total from {0})"


def _share(section: str, unit: str, column: str) -> str:
    """Three counts of a section and their shares of the first."""
    rows = []
    for name, v in (("all", f"w.{column}"), ("concatemer", f"o.{column}"), ("fail_filter", f"w.{column} - o.{column}")):
        rows += [f"select '{section}', '', '{unit}', '{name}', cast({v} as double) from w, o", f"select '{section}', '', 'perc', '{name}', 100.0::double * ({v}) / w.{column} from w, o"]
    return " union all ".join(rows)


_LONG = (
    _CONCAT
    + f", r as ({_READS_OK}), w as ({_LENGTHS.format('r')}), o as ({_LENGTHS.format('concat_')}), c as (select cast(sum(total_contacts) as double) as n from concat_), sums as ({_SUMS}), "
    + "bins(bin, lo, hi) as (values " + ", ".join(str(x) for x in summary.ORDER_BINS) + "), orders as (select bin, count(read_name) as count, 100.0::double * count(read_name) / (select count(*) from concat_) as perc from bins left join concat_ on read_order > lo and read_order <= hi group by bin), "
    + "t(section, level_0, level_1, level_2, number) as (" + " union all ".join([
        _share("reads", "count", "n"), _share("bases", "bases", "b"),
        "select 'read_length', '', 'N50', 'all', cast(n50 as double) from w", "select 'read_length', '', 'N50', 'concatemer', cast(n50 as double) from o",
        "select 'contacts', subset, 'count', kind, cast(count as double) from sums", "select 'contacts', subset, 'perc', kind, perc from sums",
        "select 'density', '', 'contacts_per_gb', 'all', 1e9 * c.n / w.b from c, w", "select 'density', '', 'contacts_per_gb', 'concatemer', 1e9 * c.n / o.b from c, o",
        "select 'concatemer_order', '', 'count', bin, cast(count as double) from orders", "select 'concatemer_order', '', 'perc', bin, perc from orders",
    ]) + ") select section, level_0, level_1, level_2, cast(null as varchar) as label, number from t union all select 'user_metadata', '', '', 'sample', 'events', null"
)


@query(_LONG)
def A19_long_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's text values as numbers, so that they compare whatever their digits; a value that is none is a label."""
    metadata = reads.with_pass_flag(b.reads(spark, sf_dir), min_read_length=500, max_read_length=5000, min_qscore=6, max_qscore=12)
    out = summary.long_summary(summary.concatemers(_contacts(spark, sf_dir)), reads.read_summary(metadata), {"sample": "events"})
    number = F.expr("try_cast(value as double)")
    return out.select("section", "level_0", "level_1", "level_2", F.when(number.isNull(), F.col("value")).alias("label"), number.alias("number"))


_READS = "with reads as (select cast(doc_id as varchar) as read_id, n_chars as read_length, cast(doc_id % 20 as float) as qscore, n_chars >= 500 and n_chars < 5000 and doc_id % 20 >= 6 and doc_id % 20 < 12 as pass_filter from documents)"
_STATS = """count(*) as num_sequences, cast(sum(read_length) as bigint) as total_bases, sum(read_length) / count(*) as mean, min(read_length) as min, max(read_length) as max,
  min(read_length) filter (run > total / 2) as "N50", quantile_cont(read_length, 0.25) as "Q25", quantile_cont(read_length, 0.5) as "Q50", quantile_cont(read_length, 0.75) as "Q75\""""


@query(_READS + " select * from reads")
def F1_read_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.with_pass_flag(b.reads(spark, sf_dir), min_read_length=500, max_read_length=5000, min_qscore=6, max_qscore=12)


@query(_READS + f", t as (select *, sum(read_length) over (order by read_length) as run, sum(read_length) over () as total from reads) select {_STATS} from t")
def A3_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.length_stats(b.reads(spark, sf_dir))


@query(
    _READS
    + f""", s as (select *, 'all' as read_subset from reads union all select *, case when pass_filter then 'pass' else 'fail' end from reads),
t as (select *, sum(read_length) over (partition by read_subset order by read_length) as run, sum(read_length) over (partition by read_subset) as total from s) select read_subset, {_STATS} from t group by read_subset"""
)
def A4_read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read_summary(F1_read_qc(spark, sf_dir))


@query("select vec_id, round(-10 * log10(list_avg(list_transform(embedding, lambda x: pow(10.0::double, -floor(abs(x::double) * 40) / 10)))), 6) as qscore from embeddings")
def A5_mean_qscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    quals = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(scalars.mean_qscore(quals), 6).alias("qscore"))


@query(_BASE + " select align_type, count(*) as num_aligns, count(distinct read_idx) as num_reads from alignments group by align_type")
def A6_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.type_summary(b.alignments(spark, sf_dir))


@query(_CASCADE + " select filter_reason, count(*) as n from filtered group by filter_reason")
def A7_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.value_counts(_assigned(spark, sf_dir), "filter_reason")


@query(
    """with v as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all),
r as (select *, sum(n) over (partition by l_orderkey) as total, row_number() over (partition by l_orderkey order by n desc, l_returnflag) as k from v)
select l_orderkey, l_returnflag as winner, n as votes, n / total as proportion from r where k = 1"""
)
def A8_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.majority(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"], "l_returnflag")


@query(
    _CASCADE
    + """, v as (select read_name, chrom, phase_set, haplotype, count(*) as n from filtered where filter_reason = 'pass' and haplotype <> -1 group by all),
r as (select *, sum(n) over (partition by read_name, chrom, phase_set) as total, row_number() over (partition by read_name, chrom, phase_set order by n desc, haplotype) as k from v),
w as (select * from r where k = 1 and n / total > 0.51 and n / total < 1.0) select align_idx, cast(coalesce(w.haplotype, f.haplotype) as tinyint) as haplotype from filtered f left join w using (read_name, chrom, phase_set)"""
)
def G3_consensus_haplotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.consensus(_assigned(spark, sf_dir), 0.51).select("align_idx", "haplotype")


@query(_BASE + ", tags as (select read_idx, align_idx, 1 + align_idx % 2 as h, 7 as p from alignments where align_idx % 3 = 0) select align_idx, cast(coalesce(h, -1) as tinyint) as haplotype, cast(coalesce(p, 0) as bigint) as phase_set, cast(0 as smallint) as phase_qual from alignments left join tags using (read_idx, align_idx)")
def J6_haplotags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.alignments(spark, sf_dir)
    tags = rows.where("align_idx % 3 = 0").select("read_idx", "align_idx", (1 + F.col("align_idx") % 2).alias("haplotype"), F.lit(7).alias("phase_set"))
    return haplotype.apply_tags(rows, tags).select("align_idx", "haplotype", "phase_set", "phase_qual")


@query(
    """with e as (select event_id, user_id, row_number() over (order by event_id) - 1 as align_idx, min(event_id) over (partition by user_id) as head from events),
h as (select head, row_number() over (order by head) - 1 as read_idx from (select distinct head from e))
select event_id as line_no, user_id || ':' || read_idx || ':' || align_idx as qname from e join h using (head)"""
)
def W9_reformat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("qname"))
    return align.reformat(events).select("line_no", "qname")


_CUTS = f"""with s as ({b.SEQ_SQL}), parts as (select doc_id, length(seq) as n, unnest(string_split(seq, 'GATC')) as part, generate_subscripts(string_split(seq, 'GATC'), 1) as k from s),
cut_ as (select doc_id, n, k, sum(length(part) + 4) over (partition by doc_id order by k) - 4 as cut from parts),
cuts as (select doc_id, n, cut from cut_ where cut > 0 and cut < n union select doc_id, length(seq), 0 from s union select doc_id, length(seq), length(seq) from s),
frags as (select doc_id, cut as start, lead(cut) over (partition by doc_id order by cut) as "end" from cuts),
f as (select cast(doc_id as varchar) as chrom, cast(start as bigint) as start, cast("end" as bigint) as "end", row_number() over (order by doc_id, start) as fragment_id, cast("end" - start as bigint) as fragment_length from frags where "end" is not null)"""


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fragments(b.sequences(spark, sf_dir), "GATC", "regex")


@query(_CUTS + " select * from f")
def X4_virtual_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir)


@query(_CUTS + ' select chrom, count(*) as num_fragments, avg(fragment_length) as mean, quantile_cont(fragment_length, 0.5) as median, min(fragment_length) as min, max(fragment_length) as max from f group by chrom')
def A2_digest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_stats(_digest(spark, sf_dir))


@query(_CUTS + """ select chrom, chrom || ' ' || string_agg("end", ' ' order by "end") as line from f group by chrom""")
def K9_hicref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.hicref(_digest(spark, sf_dir))


@query(f"with s as ({b.SEQ_SQL}) select cast(doc_id as varchar) as chrom, k as start, least(k + 500, length(seq)) as \"end\" from s, generate_series(0, greatest(length(seq) - 1, 0), 500) g(k) where length(seq) >= 500 or k = 0 and length(seq) > 0")
def X5_bin_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fragments(b.sequences(spark, sf_dir), "0.5k", "bin").select("chrom", "start", "end")


def _stranded(site: str, upper: int, lower: int) -> str:
    """Cuts of ``site(upper/lower)`` in DuckDB: the site on either strand, by every place of a sequence."""
    n, other = len(site), scalars.revcomp_text(site)
    here = "select doc_id, {0} as cut, seq from (select doc_id, seq, unnest(range(length(seq) - {1})) as i from s where length(seq) >= {2}) where substr(seq, i + 1, {2}) = '{3}'"
    both = " union all ".join([here.format(f"i + {n + upper}", n - 1, n, site), here.format(f"i - {lower}", n - 1, n, other)])
    return f"with s as ({b.SEQ_SQL}), c as (select distinct doc_id, cut from ({both}) where cut > 0 and cut < length(seq)) select cast(doc_id as varchar) as chrom, cast(cut as bigint) as cut from c"


@query(_stranded("CCTC", 7, 6))
def X6_stranded_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of an enzyme that reads its site on either strand and cuts outside of it."""
    ends = b.sequences(spark, sf_dir).select("chrom", digest.endpoints(F.col("seq"), "MnlI").alias("ends"))
    return ends.select("chrom", F.explode(F.slice("ends", 2, F.greatest(F.size("ends") - 2, F.lit(0)))).alias("cut"))


@query(f"with s as ({b.SEQ_SQL}) select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc from s")
def X1_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.sequences(spark, sf_dir).select(F.col("chrom_idx").alias("doc_id"), scalars.revcomp(F.col("seq")).alias("rc"))


@query(
    """with k as (select n_chars, md5(doc_id || ':5') as h from documents), t as (select *, sum(n_chars) over (order by h) as total from k),
g(target) as (values (100000), (400000))
select cast(target as bigint) as target, cast(arg_min(total, abs(total - target)) as bigint) as total from t, g group by target"""
)
def G2_downsample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.reads(spark, sf_dir).select(F.col("read_id").alias("read_name"), "read_length")
    return contacts.nearest_totals(own, [100_000, 400_000], 5).select("target", "total")


@query(
    """with k as (select cast(doc_id as varchar) as read_name, n_chars as read_length, md5(doc_id || ':5') as h from documents), t as (select *, sum(read_length) over (order by h) as total from k),
g(target) as (values (100000), (400000)), e as (select target, arg_min(h, abs(total - target)) as h from t, g where target <= (select sum(read_length) from k) group by target)
select cast(target as bigint) as target, read_name, read_length from k join e on k.h <= e.h"""
)
def G2_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.reads(spark, sf_dir).select(F.col("read_id").alias("read_name"), "read_length")
    samples = contacts.downsample(own, [100_000, 400_000], tolerance=0.5, seed=5)
    return contacts.merge([df.withColumn("target", F.lit(t).cast("long")) for t, df in samples.items()])


@query("select o_orderkey, o_totalprice from orders")
def U1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    part = F.pmod(F.coalesce("o_orderkey", F.lit(0)), F.lit(3))
    return contacts.merge([orders.where(part == k) for k in (0, 1, 2)])


@query("select sum(count) as reads, sum(bases) as bases, sum(passing) as passing, sum(pb) as passing_bases from (select count(*) as count, sum(n_chars)::bigint as bases, count_if(n_chars >= 500 and n_chars < 5000 and doc_id % 20 >= 6 and doc_id % 20 < 12) as passing, (sum(n_chars) filter (n_chars >= 500 and n_chars < 5000 and doc_id % 20 >= 6 and doc_id % 20 < 12))::bigint as pb from documents)")
def T4_streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    own = stream.select(F.col("n_chars").alias("read_length"), (F.col("doc_id") % 20).cast("float").alias("qscore"))
    return streams.to_memory(streams.running_totals(own, min_read_length=500, max_read_length=5000, min_qscore=6, max_qscore=12), f"totals_{abs(hash(sf_dir))}")


@query(
    f"with s as ({b.SEQ_SQL}), r as (select length(seq) as n, 5 + doc_id % 20 as q from s where length(seq) > 0), f as (select *, n >= 500 and n < 5000 and q >= 9.5 and q < 17.5 as ok from r) "
    "select count(*) as reads, cast(sum(n) as bigint) as bases, count_if(ok) as passing, cast(sum(case when ok then n else 0 end) as bigint) as passing_bases from f"
)
def T1_fastq_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that arrive as FASTQ files in three steps while a stream reads them; the totals are its state."""
    folder = f"{genome.scratch(spark)}/stream-{uuid.uuid4().hex}"
    own = b.sequences(spark, sf_dir, lettered=True)  # a condition on letters derived would derive them all in each step
    quality = F.repeat(F.expr("char(38 + chrom_idx % 20)"), F.length("seq").cast("int"))
    record = F.concat(F.lit("@"), "chrom", F.lit(" x\n"), "seq", F.lit("\n+\n"), quality)
    rows = own.select(record.alias("value"), F.pmod(F.hash("chrom"), F.lit(3)).alias("step"))  # together all of them
    arrivals = [lambda k=k: rows.where(F.col("step") == k).select("value").write.mode("append").text(f"{folder}/in") for k in range(3)]
    flagged = reads.read_metadata(fastq_stream(spark, f"{folder}/in"), min_read_length=500, max_read_length=5000, min_qscore=9.5, max_qscore=17.5)
    totals = streams.running_totals(flagged.select("read_length", "qscore"), min_read_length=500, max_read_length=5000, min_qscore=9.5, max_qscore=17.5)
    return streams.in_batches(totals, f"fastq_{uuid.uuid4().hex}", f"{folder}/state", arrivals)


from tesserae.plans import storage  # noqa: E402, F401  it registers its queries here

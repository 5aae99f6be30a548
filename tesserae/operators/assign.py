"""Fragments for alignments, and the cascade of filters on alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import gap_of
from tesserae.operators.intervals import interval_join
from tesserae.schemas import ASSIGNED, conform


def overlaps(alignments: DataFrame, fragments: DataFrame, *, containment: float = 99.0, width: int = 2000) -> DataFrame:
    """Every pair of a mapped alignment and a fragment that it overlaps, with the overlap's measures."""
    a = alignments.where("align_type <> 'unmapped'").select("align_idx", "chrom", "start", "end")
    f = fragments.select("chrom", "fragment_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = interval_join(a, f, width=width)
    length = F.least("end", "b_end") - F.greatest("start", "b_start")
    of_fragment = F.lit(100.0) * length / (F.col("b_end") - F.col("b_start"))
    return both.select(
        "align_idx", "fragment_id", F.col("b_start").alias("fragment_start"), F.col("b_end").alias("fragment_end"), length.alias("overlap_length"),
        (F.lit(100.0) * length / (F.col("end") - F.col("start"))).alias("perc_of_alignment"), of_fragment.alias("perc_of_fragment"), (of_fragment >= containment).alias("is_contained"),
    )


def best_overlap(pairs: DataFrame) -> DataFrame:
    """One row for each alignment: its longest overlap (ties to the smaller fragment) and counts over all of them.

    One aggregation with map-side combination; no window, no second pass.
    """
    best = F.max(F.struct("overlap_length", (-F.col("fragment_id")).alias("minus"), "fragment_start", "fragment_end", "perc_of_alignment", "perc_of_fragment", "is_contained")).alias("b")
    one = pairs.groupBy("align_idx").agg(best, F.count("*").alias("num_overlapping_fragments"), F.count_if("is_contained").alias("num_contained_fragments"))
    return one.select("align_idx", (-F.col("b.minus")).alias("fragment_id"), "num_contained_fragments", "num_overlapping_fragments", "b.overlap_length", "b.fragment_start", "b.fragment_end", "b.perc_of_alignment", "b.perc_of_fragment", "b.is_contained")


class Ways:
    """Cheapest ways to the rows of a read, as back pointers; node 0 is the read's start.

    ``above`` holds for each node its ancestors 1, 2, 4, .. steps up, so two ways are compared where they part, without being written out.
    """

    def __init__(self) -> None:
        self.idx, self.depth, self.above = [0], [0], [[0]]

    def add(self, before: int, align_idx: int) -> None:
        up = [before]
        while up[-1] and len(self.above[up[-1]]) >= len(up):
            up.append(self.above[up[-1]][len(up) - 1])
        self.idx.append(align_idx)
        self.depth.append(self.depth[before] + 1)
        self.above.append(up)

    def _lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.above[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def smaller(self, x: int, y: int, then: int | None) -> bool:
        """Whether the way to ``x`` comes before that to ``y``, both followed by the row ``then``, if any."""
        if x == y:
            return False
        d = min(self.depth[x], self.depth[y])
        a, b = self._lift(x, d), self._lift(y, d)
        if a == b:  # one goes on where the other ends
            on = self.idx[self._lift(x if self.depth[x] > d else y, d + 1)]
            if then is None:
                return self.depth[x] == d
            return then < on if self.depth[x] == d else on < then
        k = self.depth[a].bit_length()
        while k >= 0:
            if k < len(self.above[a]) and k < len(self.above[b]) and self.above[a][k] != self.above[b][k]:
                a, b = self.above[a][k], self.above[b][k]
            k -= 1
        return self.idx[a] < self.idx[b]

    def path(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.idx[node])
            node = self.above[node][0]
        return out[::-1]


def cheapest_way(end: np.ndarray, idx: list[int], start: list[int], score: list[int], length: int, gap: Callable) -> tuple[int, list[int]]:
    """(cost, align_idx values) of the cheapest way through rows in the order of their ends; ties go to the smaller path.

    Costs of all ways to a row are one array expression. Each row keeps a pointer to the row before it, and paths are compared, at ties
    only, by their ancestors: no path is copied.
    """
    ways, n = Ways(), len(idx)
    ends, costs = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    ends[1:] = end

    def least(found: np.ndarray, then: int | None, first: int) -> tuple[int, int]:
        low = found.min()
        best = -1
        for i in (np.flatnonzero(found == low) + first).tolist():
            if best < 0 or ways.smaller(i, best, then):
                best = i
        return int(low), best

    for j in range(n):
        low, before = least(costs[: j + 1] + gap(np.abs(start[j] - ends[: j + 1])), idx[j], 0)
        costs[j + 1] = low - score[j]
        ways.add(before, idx[j])
    low, last = least(costs[1:] + gap(length - ends[1:]), None, 1)
    return low, ways.path(last)


def _paths(aligner: str) -> Callable:
    gap = gap_of(aligner)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, lengths in batches:
            out: list[dict | None] = []
            offsets, fields = rows.offsets.to_numpy(), rows.values
            end, idx, start, score = (fields.field(x).to_numpy(zero_copy_only=False) for x in ("read_end", "align_idx", "read_start", "align_score"))
            valid, read_length = rows.is_valid().to_pylist(), lengths.to_pylist()
            for i, ok in enumerate(valid):
                a, b = offsets[i], offsets[i + 1]
                if ok and b > a:
                    cost, path = cheapest_way(end[a:b], idx[a:b].tolist(), start[a:b].tolist(), score[a:b].tolist(), read_length[i], gap)
                    out.append({"cost": cost, "path": path})
                else:
                    out.append(None)
            yield pa.array(out, pa.struct([("cost", pa.int64()), ("path", pa.list_(pa.int64()))]))

    return run


def on_shortest_path(rows: Column, read_length: Column, aligner: str = "minimap2") -> Column:
    """The cost and the align_idx values of a cheapest path through a read; null for no rows.

    ``rows`` is the array of (read_end, align_idx, read_start, align_score) of one read. In the order of read_end every
    row may follow any earlier one at the price of the gap between them less its own score; the path must end at the
    read's end. Ties go to the smaller path.
    """
    return F.arrow_udf(_paths(aligner), "cost long, path array<long>")(F.array_sort(rows), read_length)


def path_of_reads(rows: DataFrame, aligner: str = "minimap2") -> DataFrame:
    """(read_idx, cost, path) of reads with two rows or more."""
    part = F.struct(*[F.col(c).cast("long").alias(c) for c in ("read_end", "align_idx", "read_start", "align_score")])
    reads = rows.groupBy("read_idx").agg(F.collect_list(part).alias("rows"), F.max("read_length").cast("long").alias("read_length")).where(F.size("rows") > 1)
    return reads.select("read_idx", on_shortest_path(F.col("rows"), F.col("read_length"), aligner).alias("best")).select("read_idx", "best.cost", "best.path")


def filter_alignments(rows: DataFrame, *, mapping_quality_cutoff: int = 1, min_overlap_length: int = 10, aligner: str = "minimap2", path_filter: bool = True) -> DataFrame:
    """Sets pass_filter and filter_reason; each filter sees what the ones before it left.

    All but the last are branches of one CASE over windows that share the partitioning by read.
    """
    read = Window.partitionBy("read_idx")
    same = Window.partitionBy("read_idx", "ok", "read_start", "read_end").orderBy(F.desc("align_score"), "align_idx")
    first = F.when(F.col("align_type") == "unmapped", "unmapped").when(F.col("mapping_quality") <= mapping_quality_cutoff, "low_mq").when(F.col("overlap_length") < min_overlap_length, "short_overlap")
    rows = rows.withColumn("filter_reason", first).withColumn("ok", F.col("filter_reason").isNull())
    rows = rows.withColumn("n_ok", F.count_if("ok").over(read)).withColumn("place", F.row_number().over(same))
    second = F.when(F.col("ok") & (F.col("n_ok") == 1), "singleton").when(F.col("ok") & (F.col("place") > 1), "overlap_on_read")
    rows = rows.withColumn("filter_reason", F.coalesce("filter_reason", second)).drop("ok", "n_ok", "place")
    if not path_filter:
        rows = rows.withColumn("filter_reason", F.coalesce("filter_reason", F.lit("pass")))
        return rows.withColumn("pass_filter", F.col("filter_reason") == "pass")
    # the windows have dealt the rows by read already, so gathering a read's rows moves nothing
    names = [c for c in rows.columns if c != "read_idx"]
    reads = rows.groupBy("read_idx").agg(F.collect_list(F.struct(*names)).alias("rows"))
    left = F.filter("rows", lambda r: r.filter_reason.isNull())
    parts = F.transform(left, lambda r: F.named_struct(*[x for c in ("read_end", "align_idx", "read_start", "align_score") for x in (F.lit(c), r[c].cast("long"))]))
    reads = reads.select("read_idx", "rows", parts.alias("left"), F.array_max(F.transform(left, lambda r: r.read_length.cast("long"))).alias("n"))
    reads = reads.select("read_idx", "rows", F.when(F.size("left") > 1, on_shortest_path(F.col("left"), F.col("n"), aligner)).alias("best"))
    rows = reads.select("read_idx", F.col("best.path").alias("path"), F.explode("rows").alias("r")).select("read_idx", "path", "r.*")
    off = F.col("filter_reason").isNull() & F.col("path").isNotNull() & ~F.array_contains(F.coalesce("path", F.array().cast("array<bigint>")), F.col("align_idx").cast("long"))
    rows = rows.withColumn("filter_reason", F.coalesce("filter_reason", F.when(off, "not_on_shortest_path"), F.lit("pass"))).drop("path")
    return rows.withColumn("pass_filter", F.col("filter_reason") == "pass")


def assign_fragments(alignments: DataFrame, fragments: DataFrame, *, mapping_quality_cutoff: int = 1, min_overlap_length: int = 10, containment: float = 99.0, width: int = 2000, aligner: str = "minimap2", path_filter: bool = True) -> DataFrame:
    """Alignments with their fragment and filter result; those without a fragment keep the defaults."""
    found = best_overlap(overlaps(alignments, fragments, containment=containment, width=width))
    base = alignments.drop(*[c for c in found.columns if c != "align_idx"])
    joined = base.join(found, "align_idx", "left")
    filled = conform(joined, ASSIGNED).fillna({"fragment_id": 0, "num_contained_fragments": 0, "num_overlapping_fragments": 0, "overlap_length": 0, "fragment_start": 0, "fragment_end": 0, "perc_of_alignment": 0.0, "perc_of_fragment": 0.0, "is_contained": False})
    return conform(filter_alignments(filled, mapping_quality_cutoff=mapping_quality_cutoff, min_overlap_length=min_overlap_length, aligner=aligner, path_filter=path_filter), ASSIGNED)

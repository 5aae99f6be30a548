"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union of links.

Edge cases, all defined: a null or empty text has no shingles, ``n_shingles`` 0, and is linked with
nothing; a text with fewer words than a shingle is one shingle; rows with a null id have no identity
and are not returned; a repeated row returns as often as it occurs, in the same group; an empty table
gives an empty result; other columns of the input are ignored whatever their names.

Every signature position costs an element at most one draw: element e visits the positions in the order
of its own random permutation, writing (rank, fraction). A text stops as soon as its largest rank is
reached, which for long texts is after one round. With 20 bands of 4 positions a pair at similarity
0.85 is missed with probability (1 - 0.85**4)**20 = 4e-7.

Groups of any size: equal sets meet by digest; in each bucket all others are compared with one hub, the
member with the most companions; only buckets whose members then still lie in different groups are
compared further, small ones by a join, large ones, each family of them once, block against block on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import GOLD, cut, mix, rows_at_a_time, shingle_hashes, signed, texts
from tesserae.llm.graph import components

BANDS, ROWS = 20, 4
#: A pair whose signatures agree in fewer than (similarity - SLACK) of the positions is not verified; 6 standard deviations.
SLACK = 0.24
SMALL_BUCKET, BLOCK, SLICE = 32, 512, 4096
#: Ids of texts to be read again are broadcast up to this many (counted first), else the texts are shuffled to them.
BROADCAST_IDS = 2_000_000


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """SuperMinHash of each document's elements: (rank << 53) | fraction, for every position."""
    empty = np.uint64(2**64 - 1)
    sig = np.full(n_docs * size, empty, dtype=np.uint64)
    perm = None
    for j in range(size):
        if not len(h):
            break
        r = mix(h + np.uint64((j + 1) * int(GOLD) % 2**64))
        k = j + ((mix(r + GOLD) >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(h))
        if perm is None:
            pos = k
        else:
            pos = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = pos
        np.minimum.at(sig, doc * size + pos, (np.uint64(j) << np.uint64(53)) | (r >> np.uint64(11)))
        done = (sig.reshape(n_docs, size).max(axis=1) >> np.uint64(53)) <= j
        go = ~done[doc]
        if perm is None:
            perm = np.tile(np.arange(size, dtype=np.uint8), (int(go.sum()), 1))
            rows = np.arange(len(perm))
            perm[rows, k[go]] = 0
            perm[:, 0] = k[go]
        else:
            perm = perm[go]
        h, doc = h[go], doc[go]
    return sig.reshape(n_docs, size)


def _features(width: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bands * rows
        for batch in rows_at_a_time(batches, 1):
            for at, to, data, offs in texts(batch.column(1)):
                n = to - at
                h, doc = shingle_hashes(data, offs, width)
                sig = signatures(h, doc, n, size)
                count = np.bincount(doc, minlength=n).astype(np.int64)
                d = []
                for salt in (1, 2):
                    total = np.zeros(n, dtype=np.uint64)
                    np.add.at(total, doc, mix(h * np.uint64(2 * salt + 1) + GOLD))
                    d.append(signed(mix(total + count.astype(np.uint64))))
                key = np.arange(bands, dtype=np.uint64)[None, :] * GOLD + np.zeros((n, 1), dtype=np.uint64)
                for k in range(rows):
                    key = mix(key * GOLD + sig[:, k::rows])
                short = mix(sig).astype(np.uint16)
                keys = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(signed(key.reshape(-1))))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * size), n, [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(count), pa.array(d[0]), pa.array(d[1]), keys, blob], ["id", "n", "d1", "d2", "keys", "sig"])

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 1):
            for at, to, data, offs in texts(batch.column(1)):
                h, doc = shingle_hashes(data, offs, width)
                order = np.argsort(doc, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=to - at)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h[order])))], ["id", "items"])

    return run


def _alike(agree: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= agree)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _block_links(percent: int) -> Callable:
    """Links between groups inside a block of documents, or across two; full sets, by products of incidence matrices.

    Of the links that join the same two groups only enough to connect them are returned.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("id").sort_values("block", kind="stable").reset_index(drop=True)
        ident, n, comp, block = (part[c].to_numpy() for c in ("id", "n", "comp", "block"))
        cross = key[1] != key[2]
        cut_at = int((block == block[0]).sum()) if cross else len(part)
        links: list[tuple[int, int]] = []
        if len(np.unique(comp)) > 1 and (not cross or cut_at < len(part)):
            doc = np.repeat(np.arange(len(part)), n)
            _, item, count = np.unique(np.concatenate(part["items"].to_list()), return_inverse=True, return_counts=True)
            often = count[item] > 1
            doc, item = doc[often], item[often]
            order = np.argsort(item, kind="stable")
            doc, item = doc[order], item[order]
            lo, hi = (slice(0, cut_at), slice(cut_at, None)) if cross else (slice(None), slice(None))
            common = np.zeros((len(ident[lo]), len(ident[hi])), dtype=np.float32)
            _, item = np.unique(item, return_inverse=True)
            width = int(item[-1]) + 1 if len(item) else 0
            for at in range(0, width, SLICE):
                use = slice(*np.searchsorted(item, (at, at + SLICE)))
                m = np.zeros((len(part), min(SLICE, width - at)), dtype=np.float32)
                m[doc[use], item[use] - at] = 1
                common += m[lo] @ m[hi].T
            union = n[lo][:, None] + n[hi][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (comp[lo][:, None] != comp[hi][None, :]))
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := parent.get(x, x)) != x:
                    parent[x] = parent.get(y, y)
                    x = y
                return x

            for a, b in zip(i.tolist(), (j + (cut_at if cross else 0)).tolist(), strict=True):
                x, y = root(int(comp[a])), root(int(comp[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(min(ident[a], ident[b])), int(max(ident[a], ident[b]))))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    ids = cut(ids)
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, sigs: DataFrame, width: int, percent: int, agree: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    a, b = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    pairs = cut(pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_alike(agree), "a long, b long").distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_texts_of(ids, docs).mapInArrow(_sets(width), "id long, items array<long>"))
    a, b = (sets.select(F.col("id").alias(x), F.col("items").alias(f"i{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("ia", "ib")))
    return cut(both.where(F.expr(f"100 * common >= {percent} * (size(ia) + size(ib) - common)")).select("a", "b"))


def _left_apart(open_: DataFrame, star: DataFrame, docs: DataFrame, sigs: DataFrame, width: int, percent: int, agree: int) -> DataFrame:
    """Links (a, b) between the groups of buckets (key, id, n, size, comp) that hold several."""
    ratio = "100 * least(n, m) >= %d * greatest(n, m)" % percent
    other = open_.where(f"size <= {SMALL_BUCKET}").select("key", F.col("id").alias("id2"), F.col("n").alias("m"), F.col("comp").alias("comp2"))
    small = open_.where(f"size <= {SMALL_BUCKET}").join(other, "key").where("id < id2 and comp <> comp2").where(ratio).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    # large buckets that share members form families; each document is in one family, however many buckets it shares
    large = open_.where(f"size > {SMALL_BUCKET}")
    found = []
    if not large.isEmpty():
        lead = large.groupBy("key").agg(F.min("id").alias("b"))
        family = components(large.join(lead, "key").select(F.col("id").alias("a"), "b").where("a <> b")).withColumnRenamed("component", "family")
        member = cut(large.select("id", "n", "comp").distinct().join(family, "id"))
        crowd = member.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sets = _texts_of(member.select("id"), docs).mapInArrow(_sets(width), "id long, items array<long>")
        dealt = member.join(crowd, "family").withColumn("block", F.pmod(F.hash("id"), "blocks")).join(sets, "id").withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("family", F.least("block", "j").alias("p"), F.greatest("block", "j").alias("q"), "block", "id", "n", "comp", "items")
        found.append(cut(dealt.groupBy("family", "p", "q").applyInPandas(_block_links(percent), "a long, b long")))
    rest = cut(small.join(star, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found.append(_verified(rest, docs, sigs, width, percent, agree))
    return reduce(DataFrame.union, found, star.limit(0))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: groups under 100 * intersection >= percent * union.

    ``component_id`` is the smallest id reachable over links; ``kept`` marks that row.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    agree = int((percent / 100 - SLACK) * bands * rows)
    feats = cut(docs.mapInArrow(_features(width, bands, rows), "id long, n long, d1 long, d2 long, keys array<long>, sig binary"))
    full = feats.where("n > 0")
    classes = cut(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")))
    reps = feats.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi")
    # repeated rows are one from here on: r and s copies of two documents would be r * s rows where these meet
    if not feats.groupBy("id", "d1", "d2").count().where("count > 1").isEmpty():
        reps, docs = cut(reps.dropDuplicates(["id", "d1", "d2"])), cut(docs.dropDuplicates(["id", "text"]))
    sigs = reps.select("id", "sig")

    buckets = reps.select("id", "n", F.explode("keys").alias("key"))
    crowd = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(buckets.join(crowd, "key"))
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("hub"))
    ratio = "100 * least(n, m) >= %d * greatest(n, m)" % percent
    star = shared.join(hubs, "key").select("id", "n", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("m")).where("id <> hub").where(ratio)
    star = cut(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    links = _verified(star, docs, sigs, width, percent, agree)
    label = components(links)

    # what the hubs left apart: buckets that still hold several groups
    member = shared.join(label, "id", "left").select("key", "id", "n", "size", F.coalesce("component", "id").alias("comp"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = cut(member.join(mixed, "key", "left_semi"))
    if not open_.isEmpty():
        more = _left_apart(open_, star, docs, sigs, width, percent, agree)
        if not more.isEmpty():
            label = components(links.union(more))

    group = classes.join(label, classes["rep"] == label["id"], "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = feats.select("id", "n", "d1", "d2").join(group, ["d1", "d2", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

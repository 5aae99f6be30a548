"""Connected components of an edge table, wholly as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: Edges of a node from which they are spread over several keys, and rows that are broadcast (counted first).
HOT, BROADCAST_ROWS = 100_000, 1_000_000


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    df = cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


def components(edges: DataFrame, *, hot: int = HOT) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Every round each node takes the smallest label around it and then its label's label, so chains
    halve from round to round. Labels live in checkpoints; only counts reach the driver. Where a node has more than
    ``hot`` edges (counted first), such labels are sent under several keys, and labels are looked up once each, not once for each node
    that has them, so neither a hub nor its component is one task's work.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct()
    both = cut(both)
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    hubs, n = _counted(both.groupBy("b").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts")).where("salts > 1"))
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    return _around_hubs(both, label, hubs) if n else _plain(both, label)


def _plain(both: DataFrame, label: DataFrame) -> DataFrame:
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy(F.col("a")).agg(F.min("component").alias("m"))
        hooked = label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        root = hooked.select(F.col("id").alias("r"), F.col("c").alias("component"))
        label = cut(hooked.join(root, hooked["c"] == root["r"]).select("id", "old", "component"))
        moved = not label.where("old <> component").isEmpty()
        label = label.select("id", "component")
        if not moved:
            return label


def _around_hubs(both: DataFrame, label: DataFrame, hubs: DataFrame) -> DataFrame:
    spread = lambda df, node: df.join(hubs.select(F.col("b").alias(node), "salts"), node, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    sent = cut(spread(both, "b").select("a", "b", F.pmod(F.hash("a"), "salts").alias("salt")))
    while True:
        heard = spread(label, "id").select(F.col("id").alias("b"), "component", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
        near = sent.join(heard, ["b", "salt"]).groupBy("a").agg(F.min("component").alias("m"))
        hooked = cut(label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c")))
        # labels that are no roots, and their own labels
        root = hooked.select(F.col("id").alias("c"), F.col("c").alias("up"))
        jumps, moved = _counted(hooked.select("c").distinct().join(root, "c").where("c <> up"))
        if not moved and hooked.where("old <> c").isEmpty():
            return label
        label = cut(hooked.join(jumps, "c", "left").select("id", F.coalesce("up", "c").alias("component"))) if moved else hooked.select("id", F.col("c").alias("component"))

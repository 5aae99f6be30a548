"""Repair of conversation structure by a dynamic program over retained turns.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Edits: Keep a turn (0), Rerole it to user or assistant (2),
Delete it (3), Insert an empty user or assistant turn (2); a retained turn that ends without a full stop costs 1 more. Blank turns and turns whose
role and text were seen earlier must be deleted. Of the cheapest edits the ASCII-least row of initials is taken, the audit.

The program runs over the subsequence of retained turns. Between two of them everything is deleted, which prefix sums of deletion costs
price; a running minimum for each role over the turns that may come next makes a step independent of how far away that turn is; the
inserts of a gap follow from the pair of roles on its sides. It runs from the back, so the cost from every place on is known, and one walk from the front
that takes the least initial among the cheapest ways gives the audit: from a role each initial leads to one role only.

A conversation of any length is split: rows lie in ranges of (conversation, turn), so at most one conversation crosses a border. A
piece at a border gives its costs from each role to each role (16 numbers), pieces of one conversation are chained, at most two for
each partition, and then every piece walks for itself. Rows travel there as digests and codes without their texts. The repaired turns are
put together from the decisions and the texts in ranges again; only a digest over a whole conversation needs it in one task, as a stream.

Defined cases: null roles and texts are one space; rows with a null ``conv_id`` are one conversation of that id; null turns come first;
rows of one turn are ordered by role, then by the SHA-256 of their text; a role's initial is its first code point, an empty role
has none and cannot be kept; repeated rows are duplicates; texts of any length and empty tables have results; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The white space of the contract, and what ends a sentence.
SPACES, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: States: nothing yet, and the roles by their initials; role inserted after each; inserts between two (no way: None); inserts at the end.
START, S, U, A = range(4)
INITIALS, NAMES = "-sua", ("", "system", "user", "assistant")
NEXT = (U, U, A, U)
BETWEEN = ((None, 0, 0, 1), (None, None, 0, 1), (None, None, 1, 0), (None, None, 0, 1))
AT_END = (0, 2, 1, 0)
INF = 1 << 60
_KEY = ["conv_id", "turn", "role", "digest"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with seeded faults: crc32 of ``conv_id:turn`` modulo 20 drops, empties, unstops, repeats or reroles."""
    k = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.translate(_text("text"), "".join(ENDS), "")).otherwise(_text("text"))
    out = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), k.alias("k")).where("k > 0")
    return out.withColumn("k", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k")


def _keyed(turns: DataFrame) -> DataFrame:
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return t.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, later, open): distinct rows, how often they occur, and their faults.

    ``later``: role and text were seen at an earlier turn; ``open``: the text has no full stop at its end.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = _keyed(turns).select(*_KEY, (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*ENDS)).alias("open"))
    slim = slim.groupBy(*_KEY).agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("open").alias("open"))
    seen = slim.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return slim.join(seen, same).select(*_KEY, "n", "blank", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"), "open")


def to_go(rows: list[tuple[int, bool, int, int]], end: list[int]) -> list[list[int]]:
    """The least cost from each place and state on. rows: (state of the role, must go, extra cost if retained, copies); end: costs after them."""
    n = len(rows)
    before = [0] * (n + 1)  # prefix sums of deletions
    for i, (_, _, _, copies) in enumerate(rows):
        before[i + 1] = before[i] + DELETE * copies
    out, best = [end] * (n + 1), [INF] * 4  # best: running minima over the next retained turn, by its role
    stop = [before[n] + e for e in end]
    for i in range(n - 1, -1, -1):
        own, gone, extra, copies = rows[i]
        if not gone:
            after, base = out[i + 1], before[i] + extra + DELETE * (copies - 1)
            for r in (S, U, A):
                if (r == own or r != S) and (v := base + after[r] + (0 if r == own else REROLE)) < best[r]:
                    best[r] = v
        b = before[i]
        s, u, a = best[S], best[U], best[A]
        out[i] = [min(stop[START], s, u, a + INSERT) - b, min(stop[S], u, a + INSERT) - b, min(stop[U], u + INSERT, a) - b, min(stop[A], u, a + INSERT) - b]
    return out


def walk(rows: list[tuple[int, bool, int, int]], costs: list[list[int]], state: int, last: bool) -> tuple[list[str], list[tuple[int, str, int]], str, int]:
    """(initials of the edits, retained rows as (place, roles inserted before, new role), roles inserted at the end, state after).

    Among cheapest ways the least initial is taken at every step: D, I, K, R.
    """
    audit, kept, ins, i, n = [], [], "", 0, len(rows)
    while i < n:
        c = costs[i][state]
        own, gone, extra, copies = rows[i]
        up = NEXT[state]
        if costs[i + 1][state] + DELETE * copies == c:
            audit.append("D" * copies)
            i += 1
        elif costs[i][up] + INSERT == c:
            audit.append("I")
            ins += INITIALS[up]
            state = up
        else:
            keep = own and not gone and BETWEEN[state][own] == 0 and costs[i + 1][own] + extra + DELETE * (copies - 1) == c
            state = own if keep else up
            audit.append(("K" if keep else "R") + "D" * (copies - 1))
            kept.append((i, ins, 0 if keep else up))
            ins = ""
            i += 1
    if last:
        while state in (S, U):
            state = NEXT[state]
            ins += INITIALS[state]
            audit.append("I")
    return audit, kept, ins, state


def _dealt(found: DataFrame) -> DataFrame:
    """Rows in ranges of the order of conversations, in files, so that places of rows are fixed."""
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(0)
    wire = found.select(*_KEY, "n", "blank", "later", "open", initial.alias("initial"), state.alias("state"), (F.col("blank") | F.col("later")).alias("gone"), F.col("open").cast("int").alias("extra"))
    return cut(wire.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, bool]]:
    """(table, first row, last row, whether the partition ends there) of every conversation in a partition of ordered rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        ids = own.column("conv_id").to_pylist()
        at = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        if held is not None:
            if held.column("conv_id")[held.num_rows - 1].as_py() != ids[0]:
                yield held, 0, held.num_rows, False
                held = None
            elif len(at) == 1:
                held = pa.concat_tables([held, own])
                continue
            else:
                joined = pa.concat_tables([held, own.slice(0, at[1])])
                yield joined, 0, joined.num_rows, False
                held, at = None, at[1:]
        for a, b in zip(at, at[1:], strict=False):
            yield own, a, b, False
        held = own.slice(at[-1])
    if held is not None:
        yield held, 0, held.num_rows, True


def _codes(table: pa.Table, a: int, b: int) -> list[tuple[int, bool, int, int]]:
    part = table.slice(a, b - a)
    return list(zip(*(part.column(x).to_pylist() for x in ("state", "gone", "extra", "n")), strict=True))


_PIECE = "part int, first boolean, last boolean, conv string, missing boolean, costs array<long>, head string, tail string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from role to role of the first and the last conversation of a partition."""
    out, part, first = [], TaskContext.get().partitionId(), True
    for table, a, b, last in _conversations(batches):
        if first or last:
            rows = _codes(table, a, b)
            columns = [to_go(rows, [0 if r == e else INF for r in range(4)])[0] for e in range(4)]
            conv = table.column("conv_id")[a].as_py()
            ends = [table.column("initial")[i].as_py() for i in (a, b - 1)]
            out.append((part, first, last, str(conv), conv is None, [columns[e][q] for q in range(4) for e in range(4)], *ends))
        first = False
    kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.string(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["part", "first", "last", "conv", "missing", "costs", "head", "tail"])


def _exits(ends: dict[tuple[int, bool], list[int]]) -> Callable:
    """The state in which each piece of a chain is left, for every state in which it may be entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, first = [], TaskContext.get().partitionId(), True
        for table, a, b, last in _conversations(batches):
            if (end := ends.get((part, last)) if first or last else None) is not None:
                rows = _codes(table, a, b)
                costs = to_go(rows, end)
                out.append((part, last, [walk(rows, costs, q, False)[3] if costs[0][q] < INF // 2 else -1 for q in range(4)]))
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()), pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["part", "last", "exits"])

    return run


def _chained(dealt: DataFrame) -> dict[tuple[int, bool], tuple[int, list[int], bool, str | None]]:
    """(state at entry, costs after, whether it is the last, initial before) of the pieces of conversations that cross a border.

    Pieces are named by their partition and whether they end it; there are at most two for each partition.
    """
    found = sorted(dealt.mapInArrow(_pieces, _PIECE).collect(), key=lambda r: (r.part, r.last))
    chains: list[list] = []
    for before, r in zip([None, *found], found, strict=False):
        joins = before is not None and before.last and r.first and (before.conv, before.missing) == (r.conv, r.missing)
        if joins:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    if not chains:
        return {}
    ends = {}
    for chain in chains:
        end = [INSERT * n for n in AT_END]
        for r in reversed(chain):
            ends[r.part, r.last] = end
            end = [min(r.costs[4 * q + e] + end[e] for e in range(4)) for q in range(4)]
    left = {(r.part, r.last): r.exits for r in dealt.mapInArrow(_exits(ends), "part int, last boolean, exits array<int>").collect()}
    out = {}
    for chain in chains:
        state, initial = START, None
        for r in chain:
            key = r.part, r.last
            out[key] = state, ends[key], r is chain[-1], initial
            state, initial = left[key][state], r.tail
    return out


_DECISION = "conv_id {0}, turn long, role string, digest binary, tail int, before string, role_to string, edit string, part int, audit string, cost long, illegal long"


def _decide(chained: dict) -> Callable:
    """Retained rows with their edits and the roles inserted before them (``tail``: after all), and an audit for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        rows_out: list[pa.Table] = []
        more: list[list] = [[] for _ in range(8)]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        names = ["tail", "before", "role_to", "edit", "part", "audit", "cost", "illegal"]

        def flush() -> Iterator[pa.RecordBatch]:
            if rows_out:
                t = pa.concat_tables(rows_out)
                for name, kind, values in zip(names, kinds, more, strict=True):
                    t = t.append_column(name, pa.array(values, kind))
                    values.clear()
                rows_out.clear()
                yield from t.combine_chunks().to_batches()

        def add(keys: pa.Table, *values: list) -> None:
            rows_out.append(keys)
            for held, v in zip(more, values, strict=True):
                held += v

        for table, a, b, last in _conversations(batches):
            state, end, closes, initial = (chained.get((part, last)) if first or last else None) or (START, [INSERT * n for n in AT_END], True, None)
            first = False
            rows = _codes(table, a, b)
            costs = to_go(rows, end)
            audit, kept, ins, after = walk(rows, costs, state, closes)
            initials = [initial] * (initial is not None) + table.slice(a, b - a).column("initial").to_pylist()
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)) + sum(r[3] - 1 for r in rows)
            keys = table.slice(a, b - a).select(_KEY)
            n = len(kept)
            if n:
                edits = ["R" if to else "K" for _, _, to in kept]
                add(keys.take([i for i, _, _ in kept]), [0] * n, [x for _, x, _ in kept], [NAMES[to] or None for _, _, to in kept], edits, [part] * n, [None] * n, [0] * n, [0] * n)
            cost = costs[0][state] - (0 if closes else end[after])
            add(keys.slice(0, 1), [1], [ins], [None], ["I"], [part], ["".join(audit)], [cost], [illegal])
            if len(rows_out) >= 1000 or len(more[0]) >= 20_000:
                yield from flush()
        yield from flush()

    return run


def plan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faults of the rows, decisions): see ``faults`` and ``_decide``; both lie in files of the shared folder."""
    dealt = _dealt(faults(turns))
    kind = dealt.schema["conv_id"].dataType.simpleString()
    return dealt, cut(dealt.mapInArrow(_decide(_chained(dealt)), _DECISION.format(kind)))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from decisions, each followed by the row's text, as a stream."""
    decision, key = None, None
    for batch in batches:
        take, out = [], [[] for _ in range(4)]
        keys = list(zip(*(batch.column(x).to_pylist() for x in _KEY), strict=True))
        parts = [batch.column(x).to_pylist() for x in ("kind", "tail", "before", "role_to", "edit", "role", "turn")]
        for i, (kind, tail, before, to, edit, role, turn) in enumerate(zip(*parts, strict=True)):
            if kind == 0:
                for x in before or "":
                    take.append(i)
                    for held, v in zip(out, (None, NAMES[INITIALS.index(x)], "I", True), strict=True):
                        held.append(v)
                if not tail:
                    decision, key = (to or role, edit), keys[i]
            elif decision is not None and keys[i] == key:
                take.append(i)
                for held, v in zip(out, (turn, *decision, False), strict=True):
                    held.append(v)
                decision = None
        text = batch.column("text").take(pa.array(take, pa.int64()))
        made = pa.array(out[3], pa.bool_())
        text = pc.if_else(made, "", text)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(take, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), text, pa.array(out[2], pa.string())], ["conv_id", "turn", "role", "text", "edit"])


def repaired(turns: DataFrame, decisions: DataFrame, *, whole: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, edit): the repaired turns, in order within each partition; inserted ones have no turn and no text.

    With ``whole`` a conversation lies in one partition, which a digest needs; without it a long one is split over several.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    d = decisions.where("tail = 0 or before <> ''").select(*_KEY, F.lit(0).alias("kind"), "tail", "before", "role_to", "edit", F.lit(None).cast("string").alias("text"))
    t = _keyed(turns).select(*_KEY, F.lit(1).alias("kind"), F.lit(0).alias("tail"), *[F.lit(None).cast("string").alias(x) for x in ("before", "role_to", "edit")], "text")
    both, order = d.unionByName(t), ["conv_id", "tail", "turn", "role", "digest", "kind"]
    both = both.repartition("conv_id") if whole else both.repartitionByRange(*order[:-1])
    return both.sortWithinPartitions(*order).mapInArrow(_rebuild, f"conv_id {kind}, turn long, role string, text string, edit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of ordered turns."""
    begun, conv, sha = False, None, hashlib.sha256()
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if begun and c == conv:
                sha.update(b"\n")
            else:
                if begun:
                    out.append((conv, sha.hexdigest()))
                begun, conv, sha = True, c, hashlib.sha256()
            sha.update(f"{role}:{text}".encode())
        yield _named(out, batch.schema.field("conv_id").type)
        kind = batch.schema.field("conv_id").type
    if begun:
        yield _named([(conv, sha.hexdigest())], kind)


def _named(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``conversations`` names ids that are to have a row even if no turn of theirs is there.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    found, decisions = plan(turns)
    digests = repaired(turns, decisions, whole=True).mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")
    sum_of = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("long")
    counts = found.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        sum_of(F.when(F.col("blank"), F.col("n"))).alias("blank"),
        sum_of(F.when(~F.col("blank"), F.when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1))).alias("duplicate"),
        sum_of(F.when(~F.col("gone") & F.col("open"), 1)).alias("truncated"),
    )
    pieces = decisions.where("tail = 1").select("conv_id", "illegal", "cost", F.struct("part", "audit").alias("piece"))
    rows = counts.unionByName(pieces, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    rows = rows.unionByName((turns if conversations is None else conversations).select("conv_id").distinct(), allowMissingColumns=True)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["audit"]), "")
    empty = hashlib.sha256(b"").hexdigest()
    sums = [sum_of(x).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.groupBy("conv_id").agg(*sums, audit.alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))

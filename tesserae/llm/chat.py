"""Chat logs folded into final messages and rendered for training.

``reconstruct`` folds an event log. Events of a conversation have a sequence number and a kind:

    message     a whole message; with a target it (re)starts that message, without one it stands by itself
    delta       streamed text, appended to its target
    edit        the target's text from here on, deltas may follow
    regenerate  the target's text is thrown away, deltas follow
    delete      the target is dropped; text that comes later for it is dropped too, unless an event starts it again

A message's place is that of its target's first event, its role that of the last event that states one.

``render`` writes a message as one segment: ``[INST]..[/INST]`` for users, ``<s>..</s>`` for assistants,
``<<SYS>>..<</SYS>>`` for the system, ``<s>[INST]role[/INST]..</s>`` for others. A control string inside a text
gets a backslash after its first character, one more if it has some already, so texts never hold a control
string and come back exactly. The loss mask of an assistant's segment is its text.

``read_back`` parses the segments of a conversation in order. It streams: a conversation of any length needs
memory for one segment, since digests need order but not the whole.

Defined cases: null texts and roles are empty; null conversation ids form one conversation of that id in ``render``
and are left out by ``read_back``; null sequence numbers come first; events of a target with equal sequence numbers are ordered by
kind, then text; an event of a null or unknown kind adds its text as a delta does; rows with equal sequence numbers are ordered by
role, then text, and repeated rows are repeated turns; an empty log gives empty results; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings, each as its first character and the rest.
_REST = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
CONTROL = re.compile(r"<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]")
STARTS = ("message", "edit", "regenerate", "delete")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the final messages of events (conv_id, seq, kind, target, role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    events = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("target").cast("string").alias("target"), F.col("role").cast("string").alias("role"), text.alias("text"))
    alone = events.where("kind = 'message' and target is null").select("conv_id", "seq", "role", "text")
    rest = events.where("target is not null")
    own = Window.partitionBy("conv_id", "target")
    last = F.max(F.when(F.col("kind").isin(*STARTS), F.coalesce("seq", F.lit(-(2**62))))).over(own)
    rest = rest.withColumn("last", last).withColumn("first", F.min("seq").over(own))
    rest = rest.withColumn("role", F.max_by("role", F.when(F.col("role").isNotNull(), F.coalesce("seq", F.lit(-(2**62))))).over(own))
    rest = rest.where("last is null or coalesce(seq, -4611686018427387904) >= last")
    part = F.struct("seq", "kind", F.when(F.col("kind").isin("regenerate", "delete"), "").otherwise(F.col("text")).alias("text"))
    folded = rest.groupBy("conv_id", "target").agg(F.min("first").alias("seq"), F.first("role").alias("role"), F.array_sort(F.collect_list(part)).alias("parts"))
    # of starts with one sequence number the last in order counts, and if that is a deletion nothing after it matters
    start = F.coalesce(F.array_max(F.transform("parts", lambda p, i: F.when(p.kind.isin(*STARTS), i))), F.lit(0))
    folded = folded.withColumn("parts", F.slice("parts", start + 1, F.size("parts"))).where("parts[0].kind <> 'delete'")
    return alone.unionByName(folded.select("conv_id", "seq", "role", F.array_join("parts.text", "").alias("text")))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, segment, loss_start, loss_end): each message's share of the formatted conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    m = messages.select("conv_id", F.col("seq").cast("long").alias("seq"), role.alias("role"), text.alias("text")).withColumn("body", escape(F.col("text")))
    wrap = lambda a, b: F.concat(F.lit(a), F.col("body"), F.lit(b))
    other = F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]"), F.col("body"), F.lit("</s>"))
    segment = F.when(F.col("role") == "user", wrap("[INST]", "[/INST]")).when(F.col("role") == "assistant", wrap("<s>", "</s>")).when(F.col("role") == "system", wrap("<<SYS>>", "<</SYS>>")).otherwise(other)
    loss = F.col("role") == "assistant"
    return m.select("conv_id", "seq", "role", "text", segment.alias("segment"), F.when(loss, F.lit(3)).cast("long").alias("loss_start"), F.when(loss, 3 + F.length("body")).cast("long").alias("loss_end"))


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of one rendered message."""
    marks = [m.span() for m in CONTROL.finditer(segment)]
    kind = segment[slice(*marks[0])]
    body = segment[marks[0][1] : marks[-1][0]]
    if kind == "[INST]":
        return "user", unescape(body)
    if kind == "<<SYS>>":
        return "system", unescape(body)
    if len(marks) == 2:
        return "assistant", unescape(body)
    return unescape(segment[marks[1][1] : marks[2][0]]), unescape(segment[marks[2][1] : marks[-1][0]])


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, turns, chars, loss_chars = None, 0, 0, 0
    whole, loss = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        out = []
        for c, segment, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, turns, chars, loss_chars = c, 0, 0, 0
                whole, loss = hashlib.sha256(), hashlib.sha256()
            role, text = parse(segment)
            whole.update(f"{role}\n{text}\n".encode())
            if a is not None:
                learned = unescape(segment[a:b])
                loss.update(learned.encode())
                loss_chars += len(learned)
            turns += 1
            chars += len(segment)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_READ)], schema=_READ)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars), _READ, strict=True)], schema=_READ)


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from the rendered segments alone."""
    ordered = segments.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "role", "text", "segment", "loss_start", "loss_end")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

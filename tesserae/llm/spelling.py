"""Spelling variants by a symmetric-delete join.

Words are counted over all documents, with counts added up inside tasks first. Each word of the vocabulary then emits itself and its distinct
single deletions as hashes of 61 bits; a word of any length emits numbers only, and texts are looked up again for pairs alone.
Words that share a key are candidates:

    a word and a deletion of another       one is the other without a code point
    deletions at one place of two words    they differ in that place alone, if at all

A place is part of the second kind of key, so words meet only if they can be near, and a key has at most as many words as there are letters:
no group grows with the data. Candidates are verified by their texts. A word's form is its near word of largest count,
if that is at least ``RATIO`` times its own; counts grow along forms, so a word's chain is short, and roots are handed down from the
forms that have none, one step of chains in a round.

Defined cases: null and empty texts have no words; in rows with a null id nothing is damaged; repeated rows count as often as they
occur; of near words with the same count the first in code-point order is the form; runs of any length have results; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import LOWER, cut, deletion_hash, prefix_hash, rows_at_a_time, signed, span_hash

#: Least code points and occurrences of a word, and how much more frequent a form is.
LENGTH, COUNT, RATIO = 6, 5, 5
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Code points of words whose keys are made at a time; a longer word is taken by itself.
KEYS = 1 << 18
_LOWER = bytes(LOWER)


def damaged(doc_id: str, words: Counter, every: int) -> Counter:
    """Counts after one code point is deleted from each word for which crc32 of ``doc_id:word`` is a multiple of ``every``."""
    begin, out = zlib.crc32(f"{doc_id}:".encode()), words
    for word, n in list(words.items()):
        h = zlib.crc32(word.encode(), begin)
        if h % every == 0:
            if out is words:
                out = words.copy()
            at = h % len(word)
            out[word] -= n
            out[word[:at] + word[at + 1 :]] += n
    return out


def _words(length: int, every: int | None) -> Callable:
    runs = re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if n and len(w) >= length}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for batch in rows_at_a_time(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode()))
                held.update(damaged(doc_id, found, every) if every and doc_id is not None else found)
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, least: int = COUNT, every: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters of at least ``length`` code points that occur at least ``least`` times.

    With ``every`` one in so many pairs of document and word loses a code point first.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_words(length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


_KEYS = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word under its own hash (place -1), its distinct deletions under theirs (-2), and under the deletion at each place (0..)."""
    for batch in rows_at_a_time(batches, 1, KEYS):
        words = [w.encode("latin-1") for w in batch.column(1).to_pylist()]  # letters lie below U+0100: a byte each
        size = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        end = np.cumsum(size)
        start = end - size
        prefix = prefix_hash(data)
        row = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(data))
        gone = deletion_hash(prefix, start[row], at, end[row])
        # of equal neighbours the last one stands for all: their deletions are the same
        last = np.ones(len(data), dtype=bool)
        last[:-1] = (data[1:] != data[:-1]) | (row[1:] != row[:-1])
        own = np.arange(len(words))
        key = np.concatenate((span_hash(prefix, start, end), gone[last], gone))
        place = np.concatenate((np.full(len(words), -1), np.full(int(last.sum()), -2), at - start[row]))
        who = np.concatenate((own, row[last], row))
        ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for a in range(0, len(key), KEYS):
            b = slice(a, a + KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(key[b]), place[b], ids[who[b]], n[who[b]])], schema=_KEYS)


def near(words: DataFrame) -> DataFrame:
    """(a, b): ids of words (id, word, n) that share a key as words at distance one do, each pair once."""
    keys = words.select("id", "word", "n").mapInArrow(_keys, "key long, place long, id long, n long")
    whole, shorter, places = keys.where("place = -1"), keys.where("place = -2"), keys.where("place >= 0")
    one = whole.select("key", F.col("id").alias("a")).join(shorter.select("key", F.col("id").alias("b")), "key").select("a", "b")
    other = places.select("key", "place", F.col("id").alias("a")).join(places.select("key", "place", F.col("id").alias("b")), ["key", "place"]).where("a < b").select("a", "b")
    return one.union(other)


def differs_by_one(a: Column, b: Column) -> Column:
    """Whether two different words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n); n_near is the number of near words."""
    words = cut(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    pairs = near(words).join(side("a"), "a").join(side("b"), "b").where(differs_by_one(F.col("a_word"), F.col("b_word")))
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.struct((-F.col(f"{y}_n")).alias("n"), F.col(f"{y}_word").alias("word")).alias("near"))
    both = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.id", "p.near")
    best = both.groupBy("id").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    known = words.join(best, "id", "left").withColumn("has", -F.col("near.n") >= ratio * F.col("n"))
    form, form_n = F.when(F.col("has"), F.col("near.word")), F.when(F.col("has"), -F.col("near.n"))
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), form_n.cast("long").alias("form_n")))
    return known.join(roots(known.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the chain of forms. A form has few words of its own, those near it."""
    forms = links.select(F.col("form").alias("word")).distinct()
    level = cut(forms.join(links, "word", "left_anti").select("word", F.col("word").alias("root")))
    parts = []
    while True:
        level = cut(links.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"))
        if level.isEmpty():
            break
        parts.append(level)
    out = links.select("word", F.col("form").alias("root")).limit(0)
    for p in parts:
        out = out.union(p)
    return out

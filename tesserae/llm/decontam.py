"""Benchmark decontamination by template windows, with DataFrame functions alone.

A text becomes tokens: words in lower case, and three kinds of slots. Numbers are slots, so are units that follow a
number, and so are names: capitalised words that do not begin a sentence. The template of a window of ``WINDOW``
tokens has a placeholder for each slot; next to it stands the pattern of which slots hold equal values. Both are hashed
into one key, so one hash join finds the windows that are a benchmark item's up to a consistent change of its
parameters: values may differ, but equal ones must stay equal and different ones different.

Items and documents enter in several readings: as written, in lower case, and with every capitalised word taken for a
name, also where it begins a sentence; items also with their first word alone taken for a name (it may stand inside a
sentence of the document). So a passage in capitals, where every word looks like a name, meets the lower case of its
item. A place found in several readings counts once. Windows with more slots than words would match tables of numbers;
they go by their literal values in lower case. Items with fewer tokens than a window are matched as a whole; those with fewer than
``LITERAL`` by their literal values, as so few words say little once a slot is among them. In scripts without blanks each letter is a token.

Each window of an item has two anchors, its longest tokens that must be literally equal (ties to the first). A document's
tokens are hashed into windows only where an item's anchors stand at the right distance, in all readings; everywhere else no
reading can match. So no window is lost, and of an ordinary text a few tokens in a hundred are looked at twice.

What is found is joined to all items that have the window, so a document has one row for each item found. Anchor words are
literals of the plan up to ``LITERALS``, anchors are broadcast up to ``BROADCAST_ROWS`` rows (both counted first); beyond that all places
are looked up by a shuffled join.

Defined cases: null or empty texts and items match nothing, nor does an item of one token, which is a word and no passage; rows with null ids are left out on either side; a repeated
row adds to its document's counts; an empty table on either side gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

WINDOW, SHORTEST, LITERAL = 8, 2, 5
BROADCAST_ROWS, LITERALS = 1_000_000, 100_000
#: Units of measurement that are slots after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v a c f k usd eur gbp dollars euros cents percent meters metres miles feet inches grams kilograms pounds liters litres seconds minutes hours days weeks months years degrees".split()

#: Private-use characters that mark a name, a unit and a capitalised word that begins a sentence.
_N, _U, _S = "\ue000", "\ue001", "\ue002"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},]\s.)"
_START = r"(?<![\p{L}\p{M}" + _N + r"])\p{Lu}"
#: Scripts that are written without blanks.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_DENSE = "".join(r"\p{Is%s}" % x for x in SCRIPTS)
_TOKEN = rf"[{_DENSE}][\p{{M}}]*+|(?:[^\P{{L}}{_DENSE}]|[^\P{{M}}{_DENSE}]|[{_N}{_S}])++|[0-9]++(?:[.,][0-9]++)*+"


def tokens(text: Column) -> Column:
    """Words in lower case, names and other capitalised words behind marks, and numbers."""
    marked = F.regexp_replace(F.regexp_replace(text, _NAME, _N + "$0"), _START, _S + "$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def _without(tok: Column | str, marks: str) -> Column:
    return F.transform(tok, lambda x: F.translate(x, marks, ""))


def _readings(tok: str) -> list[Column]:
    """As written, in lower case, with all capitalised words as names; null where one equals the first."""
    names, starts = F.exists(tok, lambda x: F.substring(x, 1, 1) == _N), F.exists(tok, lambda x: F.substring(x, 1, 1) == _S)
    as_written = F.when(starts, _without(tok, _S)).otherwise(F.col(tok))
    return [as_written, F.when(names, _without(tok, _N + _S)), F.when(starts, F.transform(tok, lambda x: F.translate(x, _S, _N)))]


def _number(x: Column) -> Column:
    return F.substring(x, 1, 1).between("0", "9")


def _is_slot(x: Column) -> Column:
    first = F.substring(x, 1, 1)
    return first.between("0", "9") | first.isin(_N, _U)


def _marked(tok: str) -> Column:
    """Units behind a mark where they follow a number."""
    return F.transform(tok, lambda x, i: F.when(x.isin(UNITS) & (i > 0) & _number(F.get(tok, i - 1)), F.concat(F.lit(_U), x)).otherwise(x))


def _code(x: Column) -> Column:
    """A hash of the placeholder of a slot, of a word itself."""
    first = F.substring(x, 1, 1)
    return F.xxhash64(F.when(first.isin(_N, _U), first).when(first.between("0", "9"), "#").otherwise(x))


def _with_keys(df: DataFrame, size: int) -> DataFrame:
    """Adds ``keys``, one for each window of ``size`` tokens.

    Template hashes double: those of 2, 4, .. tokens come from two of half the length, each in one pass.
    """
    wide, n = 1, F.greatest(F.size("tok") - size + 1, F.lit(0))
    if size < LITERAL:
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return df.withColumn("keys", F.transform(at, lambda i: F.xxhash64(F.lit("="), _without(F.slice("tok", i, size), _N + _U))))

    def joined(step: int) -> Column:
        return F.zip_with("keys", F.slice("keys", step + 1, 1 << 30), lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("keys", F.col("codes"))
    while 2 * wide <= size:
        df, wide = df.withColumn("keys", joined(wide)), 2 * wide
    if wide < size:
        df = df.withColumn("keys", joined(size - wide))
    df = df.withColumn("keys", F.slice("keys", F.lit(1), n))

    def keyed(x: Column, i: Column) -> Column:
        own = F.slice("tok", i + 1, size)
        slots = F.filter(own, _is_slot)
        same = F.xxhash64(x, F.transform(slots, lambda s: F.array_position(own, s)))
        return F.when(F.size(slots) == 0, x).when(F.size(slots) * 2 <= size, same).otherwise(F.xxhash64(F.lit("="), _without(own, _N + _U)))

    return df.withColumn("keys", F.when(F.col("has_slots"), F.transform("keys", keyed)).otherwise(F.col("keys")))


def _coded(df: DataFrame) -> DataFrame:
    """With ``tok``, adds ``has_slots`` and ``codes``, a hash of each token's template."""
    df = df.withColumn("has_slots", F.exists("tok", _is_slot)).withColumn("tok", F.when(F.col("has_slots"), _marked("tok")).otherwise(F.col("tok")))
    return df.withColumn("codes", F.when(F.col("has_slots"), F.transform("tok", _code)).otherwise(F.transform("tok", lambda x: F.xxhash64(x))))


def _item_windows(items: DataFrame, window: int, shortest: int) -> DataFrame:
    """(size, key, item_id, own): every window of every item, with its tokens."""
    first = F.slice(tokens(F.concat(F.lit("a "), F.col("text"))), 2, 1 << 30)
    items = items.select("item_id", tokens(F.col("text")).alias("tok"), _without(first, _S).alias("first"))
    read = cut(items.select("item_id", F.explode(F.array(*_readings("tok"), F.col("first"))).alias("tok")).where(F.size("tok") >= shortest).withColumn("size", F.least(F.size("tok"), F.lit(window))))
    sizes = [r["size"] for r in read.select("size").distinct().collect()]  # at most window - shortest + 1
    out = None
    for size in sorted(sizes) or [window]:
        own = _with_keys(_coded(read.where(F.col("size") == size)), size).select("item_id", "size", "tok", F.posexplode("keys").alias("at", "key"))
        own = own.select("size", "key", "item_id", F.slice("tok", F.col("at") + 1, size).alias("own"))
        out = own if out is None else out.unionByName(own)
    return out


def _bare(x: Column) -> Column:
    return F.translate(x, _N + _U + _S, "")


def _anchors(windows: DataFrame) -> DataFrame:
    """(size, word, off, word2, off2): the two longest tokens of every window that any match has at these places."""
    slots = F.size(F.filter("own", _is_slot))
    ranked = F.transform("own", lambda x, i: F.struct((-F.length(_bare(x))).alias("n"), i.alias("off"), _bare(x).alias("word"), _is_slot(x).alias("slot")))
    literal = F.when((slots * 2 <= F.col("size")) & (F.col("size") >= LITERAL), F.filter(ranked, lambda r: ~r.slot)).otherwise(ranked)
    best = windows.select("size", F.array_sort(literal).alias("r")).select("size", F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"))
    return best.select("size", "a.word", "a.off", F.col("b.word").alias("word2"), F.col("b.off").alias("off2")).distinct()


def _candidates(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(id, row, at, size, reading, tok and how it was found): windows of documents (id, row, tok) where anchors stand, in each reading."""
    words = [r.word for r in anchors.select("word").distinct().limit(LITERALS + 1).collect()]
    places = F.transform("tok", lambda x, i: F.struct(i.alias("i"), _bare(x).alias("word")))
    if len(words) <= LITERALS:
        places = F.filter(places, lambda p: p.word.isin(words))
    begin = lambda i: F.greatest(i - window, F.lit(0))
    near = F.transform(places, lambda p: F.struct(p.i.alias("i"), p.word.alias("word"), begin(p.i).alias("from"), F.slice("tok", begin(p.i) + 1, p.i - begin(p.i) + window).alias("near")))
    found = docs.select("id", "row", F.explode(near).alias("p")).select("id", "row", "p.*")
    few = anchors.count() <= BROADCAST_ROWS
    met = found.join(F.broadcast(anchors) if few else anchors, "word").withColumn("at", F.col("i") - F.col("off"))
    start = F.col("at") - F.col("from")
    fits = (F.col("at") >= 0) & (start + F.col("size") <= F.size("near"))
    met = met.where(fits & (F.col("word2").isNull() | (_bare(F.get("near", start + F.col("off2"))) == F.col("word2"))))
    # with the token before, on which a unit depends
    lead = F.when(start > 0, 1).otherwise(0)
    met = met.select("id", "row", "at", "size", "off", "word2", "off2", lead.alias("lead"), F.slice("near", start + 1 - lead, F.col("size") + lead).alias("tok"))
    read = met.select("id", "row", "at", "size", "off", "word2", "off2", "lead", F.posexplode(F.array(*_readings("tok"))).alias("reading", "tok")).where("tok is not null")
    return read.withColumn("tok", F.slice(_marked("tok"), F.col("lead") + 1, F.col("size"))).drop("lead")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(id, item_id, n_windows, first_token, last_token) for every document and item found in it."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    windows = cut(_item_windows(items, window, shortest))
    keys, anchors = cut(windows.select("size", "key", "item_id").distinct()), cut(_anchors(windows))
    sizes = [r["size"] for r in keys.select("size").distinct().collect()]  # at most a few sizes
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    docs = docs.select("id", F.xxhash64("text").alias("row"), tokens(F.col("text")).alias("tok"))
    found = cut(_candidates(docs, anchors, window))  # few; keys are made for every size
    hits = None
    for size in sorted(sizes) or [window]:
        own = _with_keys(_coded(found.where(F.col("size") == size)), size).select("id", "row", "reading", "at", "size", "off", "word2", "off2", F.get("keys", F.lit(0)).alias("key"))
        hits = own if hits is None else hits.unionByName(own)
    # each copy of a row finds a place once by each pair of anchors
    places = hits.groupBy("id", "row", "reading", "at", "size", "key", "off", "word2", "off2").agg(F.count("*").alias("n"))
    few = keys.count() <= BROADCAST_ROWS
    places = places.join(F.broadcast(keys) if few else keys, ["size", "key"])
    once = places.groupBy("id", "row", "item_id", "at", "size").agg(F.max("n").alias("n"))
    out = once.groupBy("id", "item_id").agg(F.sum("n").alias("n_windows"), F.min("at").cast("long").alias("first_token"), F.max(F.col("at") + F.col("size")).cast("long").alias("last_token"))
    return out.withColumnRenamed("id", id_col)

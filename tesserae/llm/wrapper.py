"""Main text of web pages by inferred wrappers.

Pages of a host come from few templates. A page's token stream, with texts as slots, is first folded: a run of equal
neighbouring elements becomes one repeated group. The distinct folded streams of a host's pages are gathered into templates: a stream joins the
template whose first stream shares most slots with it, if that is at least ``ALIKE``. The streams of a template are aligned one after
the other: equal tokens match, a token that only one side has becomes optional, a group that repeats on either side becomes
repeated. The result is the template's wrapper, a union-free regular expression: a sequence of text slots, optional and
repeated groups.

A slot is boilerplate if it lies in markup that says so (navigation, header, footer, aside, form, notices, adverts, comments
by tag, role, class or id) or if, at its place in the wrapper, over half of the distinct pages show the same text or the texts are
mostly links. Pages are distinct if their slots outside such markup differ, so copies of an article are one page; texts
are counted exactly, by an aggregation over (host, template, place, text). Landmarks are a prior: slots under a main element are the article unless the
wrapper is sure, that is if ``SURE`` of the distinct pages, of many lengths, show one text there. Where no such slot remains the article is where most
text is: each weighs what the texts at its place have on the average of the template's pages, and from the page's root the way leads into a
container as long as that one holds more than half of the weight. So adverts, footers and comments without any mark stay out.

Folded streams are counted before they are aligned, so a host of any number of pages brings one row for each distinct
stream, and a host with many streams is aligned in parts of about ``STREAMS`` first. Wrappers reach the pages by a broadcast up to
``BROADCAST_BYTES`` (summed first), else by a join on the host.

Defined cases: a null html or url is empty; an empty page has empty text; pages without a host share their templates; markup that is
never closed ends with its parent, and a block element ends an open paragraph or inline element; repeated rows are pages each; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt, log, log1p

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

STREAMS = 500
BROADCAST_BYTES = 32 << 20
#: A slot outside a main element whose commonest text covers this share of its distinct pages is boilerplate; from so many pages on.
CONSTANT, PAGES = 0.5, 3
#: A slot inside a main element is boilerplate if one text covers this share of its distinct pages, and those have so many classes of
#: length, each a tenth longer than the one before: near copies of one article share their texts, but also their length.
SURE, SURE_PAGES, SIZE_CLASS = 0.9, 5, log(1.1)
#: Streams of a template share this part of their slots with its first stream.
ALIKE = 0.5
LINKED = 0.6
#: A container that holds more than this share of the weight is the one to look into.
MOST = 0.5

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav header footer aside form button dialog menu title head".split())
MAIN = frozenset("article main".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption address summary".split())
#: Words of class names and ids that tell boilerplate, and words that say where or what shape a thing is only.
_CUES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice popup modal newsletter subscribe share sharing social related comment comments disqus replies reply form search login pagination skip".split())
_NEUTRAL = frozenset("site page main global top bottom left right primary secondary upper lower inner outer sub wide small big mini list lists item items entry box boxes wrap wrapper container content contents body area block blocks section widget widgets slot unit bar row col column group panel inline sticky fixed floating link links button buttons icon icons text title thread tree author meta count post posts article articles story user reader readers guest signup bottom modal overlay wide js id".split())
_MAIN_CUE = re.compile(r"(?:^|[\s_-])(?:article(?:[_-]?body)?|post[_-]?(?:body|content)|entry[_-]?content|main[_-]?content|story[_-]?body)(?=$|\s)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v   -     　]+")


def _is_boilerplate(names: str) -> bool:
    """Whether a class name or id tells boilerplate: all its parts are cues or neutral, and one is a cue.

    ``site-header``, ``comment-list`` and ``comment-12`` do, ``promo-code-guide``, ``job-search`` and ``with-sidebar`` speak of something else.
    """
    for name in names.split():
        parts = [x for x in re.split(r"[_\W\d]+", name.lower()) if x]
        if any(x in _CUES for x in parts) and all(x in _CUES or x in _NEUTRAL for x in parts):
            return True
    return False


def _mark(tag: str, attrs: str) -> str:
    """A tag with what tells its purpose: '-' for boilerplate, '+' for main content. Attributes count before the tag: comments and adverts may be articles."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs and "=" in attrs or "hidden" in attrs else {}
    names, role = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()
    if role == "main" or (_MAIN_CUE.search(names) and role not in _ROLES):
        return f"{tag}+"
    if tag not in ("body", "html") and (role in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or _is_boilerplate(names)):
        return f"{tag}-"
    return f"{tag}+" if tag in MAIN else f"{tag}-" if tag in DROPPED else tag


Block = tuple[tuple[str, ...], str, int, tuple[int, ...]]


def blocks(page: str) -> Iterator[Block]:
    """(path of marked block elements, text, characters of it inside links, numbers of the elements) of every block of text, in page order."""
    path: list[str] = []
    own: list[int] = []
    text: list[str] = []
    linked = depth = at = count = 0
    skip = ""

    def done() -> Iterator[Block]:
        nonlocal linked
        if text:
            t = _WHITE.sub(" ", html.unescape("".join(text))).strip(" ")
            if t:
                yield tuple(path), t, linked, tuple(own)
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if skip:
            if not (m[1] and m[2] and m[2].lower() == skip):
                continue
            skip, at = "", m.end()
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) if depth else 0
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                skip = tag
        elif tag in INLINE:
            depth = max(0, depth + (-1 if m[1] else 1)) if tag == "a" else depth
        else:
            yield from done()
            depth = 0
            if tag in VOID:
                continue
            names = [x.rstrip("+-") for x in path]
            if m[1]:
                if tag in names:
                    del path[len(names) - 1 - names[::-1].index(tag) :]
                    del own[len(path) :]
            else:
                if names and (names[-1] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and names[-1] == tag)):
                    path.pop()
                    own.pop()
                path.append(_mark(tag, m[3]))
                count += 1
                own = [*own[: len(path) - 1], count]
    if not skip and at < len(page):
        text.append(page[at:])
    yield from done()


def folded(page: str) -> list[tuple[str, str, int, int]]:
    """(path, hash of the texts, characters, linked characters) of each slot; neighbours of one path are one repeated slot."""
    out: list[list] = []
    for path, text, linked, _ in blocks(page):
        p = "/".join(path)
        if out and out[-1][0] == p:
            out[-1][1].update(text.encode())
            out[-1][2] += len(text)
            out[-1][3] += linked
        else:
            out.append([p, hashlib.md5(text.encode()), len(text), linked])
    return [(p, h.hexdigest()[:12], n, k) for p, h, n, k in out]


def is_marked(path: str) -> bool:
    return re.search(r"-(?:/|$)", path) is not None


def is_main(path: str) -> bool:
    return re.search(r"\+(?:/|$)", path) is not None and not is_marked(path)


def matches(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of ``a`` and ``b`` side by side, along their longest common sequence; what only ``a`` has comes first.

    Lengths are bits of whole numbers: bit i of ``row(j)`` says that the longest common sequence of a[i:] and b[j:] does not need a[i]. Every
    ``step``-th row is kept and those between are made again, so memory is n * sqrt(m) bits and time n * m / 64.
    """
    n, m = len(a), len(b)
    if a == b:
        return [(i, i) for i in range(n)]
    full, step, at = (1 << n) - 1, max(1, isqrt(m)), {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << (n - 1 - i)

    def before(row: int, j: int) -> int:
        same = row & at.get(b[j], 0)
        return ((row + same) | (row - same)) & full

    kept, row = {m: full}, full
    for j in range(m - 1, -1, -1):
        row = before(row, j)
        if j % step == 0:
            kept[j] = row
    rows: dict[int, int] = {m: full}

    def row_of(j: int) -> int:
        if j not in rows:
            rows.clear()
            to = min(m, (j // step + 1) * step)
            rows[to] = kept[to]
            for k in range(to - 1, j - 1, -1):
                rows[k] = before(rows[k + 1], k)
        return rows[j]

    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and row_of(j) >> (n - 1 - i) & 1):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """The wrapper of two wrappers: their longest common sequence of slots, with the others optional between."""
    out: list[dict] = []
    for i, j in matches([s["path"] for s in a], [s["path"] for s in b]):
        if i is None or j is None:
            s = (a[i] if j is None else b[j]) | {"optional": True}
        else:
            s = {"path": a[i]["path"], "pages": a[i]["pages"] + b[j]["pages"], "optional": a[i]["optional"] or b[j]["optional"]}
        # a slot that follows its like is the same repeated group
        if out and out[-1]["path"] == s["path"]:
            s = out[-1] | {"pages": max(out[-1]["pages"], s["pages"])}
            out.pop()
        out.append(s)
    return out


def templates(found: list[tuple[list[str], list[dict]]]) -> list[tuple[list[str], list[dict]]]:
    """(first stream, wrapper) of each template of (stream, wrapper)."""
    out: list[tuple[list[str], list[dict]]] = []
    counts: list[Counter] = []
    for stream, slots in found:
        own = Counter(stream)
        alike = [2 * (own & c).total() / (len(stream) + len(first)) for c, (first, _) in zip(counts, out, strict=True)]
        at = max(range(len(out)), key=alike.__getitem__, default=None)
        if at is None or alike[at] < ALIKE:
            out.append((stream, slots))
            counts.append(own)
        else:
            out[at] = (out[at][0], align(out[at][1], slots))
    return out


class Wrappers:
    """The templates of a host, the places in them that are boilerplate, and what the texts of the others weigh."""

    def __init__(self, wrapper: str, found: str | None = None) -> None:
        self.known = [(Counter(first), len(first), Counter(w), w) for first, w in ((first, [s["path"] for s in w]) for first, w in json.loads(wrapper))]
        known = json.loads(found or "[]")
        self.dropped = {p: level for p, level, _ in known if level}
        self.weight = {p: w for p, _, w in known}
        self.placed: dict[tuple[str, ...], list[str]] = {}

    def places(self, stream: tuple[str, ...]) -> list[str]:
        """'template:place' of every slot, empty where the template lacks it; the template that has most of the slots counts."""
        if stream not in self.placed:
            if len(self.placed) > 5000:
                self.placed.clear()
            own, found = Counter(stream), [""] * len(stream)
            best = max(range(len(self.known)), key=lambda t: ((own & self.known[t][2]).total(), (own & self.known[t][0]).total() / (len(stream) + self.known[t][1])), default=None)
            if best is not None:
                for i, j in matches(self.known[best][3], list(stream)):
                    if i is not None and j is not None:
                        found[j] = f"{best}:{i}"
            self.placed[stream] = found
        return self.placed[stream]


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct streams of each batch."""
    for batch in batches:
        found: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            paths = [s[0] for s in folded(page)]
            if paths:
                found[host, "\n".join(paths)] += 1
        rows = [(h, s, n) for (h, s), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "stream", "pages"])


def _templates(part: pd.DataFrame) -> list[tuple[list[str], list[dict]]]:
    """Same streams first, then templates, longest stream first."""
    found: dict[str, list[dict]] = {}
    for stream, w in zip(part.stream, part.wrapper, strict=True):
        own = [{"path": p, "pages": int(w[1:]), "optional": False} for p in stream.split("\n")] if w[0] == "n" else json.loads(w)
        found[stream] = align(found[stream], own) if stream in found else own
    return templates([(s.split("\n"), found[s]) for s in sorted(found, key=lambda s: (-s.count("\n"), s))])


def _of_part(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    out = _templates(part)
    return pd.DataFrame({"host": [key[0]] * len(out), "stream": ["\n".join(s) for s, _ in out], "wrapper": [json.dumps(w) for _, w in out]})


def _of_host(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(_templates(part))]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html); the wrapper is JSON: (first stream, slots) of each template."""
    rows = pages.select("host", "html").mapInArrow(_streams, "host string, stream string, pages long")
    streams = cut(rows.groupBy("host", "stream").agg(F.sum("pages").alias("pages")))
    salts = streams.groupBy("host").agg(F.ceil(F.count("*") / STREAMS).alias("salts"))  # a row for each host
    salted = streams.join(salts, "host").withColumn("salt", F.pmod(F.xxhash64("stream"), "salts"))
    salted = salted.select("host", "salt", "stream", F.concat(F.lit("n"), F.col("pages").cast("string")).alias("wrapper"))
    part = salted.groupBy("host", "salt").applyInPandas(_of_part, "host string, stream string, wrapper string")
    return part.groupBy("host").applyInPandas(_of_host, "host string, wrapper string")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, size, place, text, chars, linked) of the slots that a wrapper decides on; page and text are hashes, size a class of lengths."""
    known: dict[tuple, Wrappers] = {}
    for batch in batches:
        out: list[tuple] = []
        for host, page, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            slots = folded(page)
            if not slots:
                continue
            places = _wrappers(known, wrapper, None).places(tuple(s[0] for s in slots))
            own = [(place, h, n, k) for place, (path, h, n, k) in zip(places, slots, strict=True) if not is_marked(path)]
            of = hashlib.md5(repr([x for x in zip(places, slots, strict=True) if not is_marked(x[1][0])]).encode()).hexdigest()
            size = int(log1p(sum(x[2] for x in own)) / SIZE_CLASS)
            out += [(host, of, size, *x) for x in own if x[0]]
        kinds = {"host": pa.string(), "page": pa.string(), "size": pa.int64(), "place": pa.string(), "text": pa.string(), "chars": pa.int64(), "linked": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def _wrappers(known: dict, wrapper: str, found: str | None) -> Wrappers:
    key = (wrapper, found)
    if key not in known:
        if len(known) > 5000:
            known.clear()
        known[key] = Wrappers(wrapper or "[]", found)
    return known[key]


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, found): JSON of (place, whether it is no main text, mean characters), of pages (host, html, wrapper)."""
    rows = pages.select("host", "html", "wrapper").mapInArrow(_slots, "host string, page string, size long, place string, text string, chars long, linked long")
    once = rows.groupBy("host", "page", "place").agg(F.first("text").alias("text"), F.first("size").alias("size"), F.first("chars").alias("chars"), F.first("linked").alias("linked"))
    texts = once.groupBy("host", "place", "text").agg(F.count("*").alias("n"), F.size(F.collect_set("size")).alias("sizes"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    slots = texts.groupBy("host", "place").agg(F.sum("n").alias("pages"), F.max("n").alias("most"), F.max(F.struct("n", "sizes"))["sizes"].alias("sizes"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    constant = (F.col("pages") >= PAGES) & (F.col("most") > CONSTANT * F.col("pages"))
    dropped = constant | (F.col("linked") > LINKED * F.greatest("chars", F.lit(1)))
    certain = (F.col("sizes") >= SURE_PAGES) & (F.col("most") >= SURE * F.col("pages"))
    level = F.when(certain, 2).when(dropped, 1).otherwise(0)
    one = F.array(F.concat(F.lit('"'), "place", F.lit('"')), level.cast("string"), F.round(F.col("chars") / F.col("pages"), 1).cast("string"))
    return slots.select("host", F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")).alias("one")).groupBy("host").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("one")), ","), F.lit("]")).alias("found"))


def densest(chains: list[tuple[int, ...]], weights: list[float]) -> list[int]:
    """The slots under the container that the way from the root leads to: always into the child that holds most of the weight."""
    left, depth = [i for i, w in enumerate(weights) if w > 0], 0
    while True:
        below: dict[int, float] = {}
        for i in left:
            if len(chains[i]) > depth:
                below[chains[i][depth]] = below.get(chains[i][depth], 0.0) + weights[i]
        best = max(below, key=below.__getitem__, default=None)
        if best is None or below[best] <= MOST * sum(weights[i] for i in left):
            return left
        left = [i for i in left if len(chains[i]) > depth and chains[i][depth] == best]
        depth += 1


def article(page: str, wrapper: Wrappers) -> str:
    """The main text of a page."""
    found = list(blocks(page))
    paths = ["/".join(b[0]) for b in found]
    new = [i == 0 or p != paths[i - 1] for i, p in enumerate(paths)]
    places = wrapper.places(tuple(p for p, first in zip(paths, new, strict=True) if first))
    at = [k - 1 for k in accumulate(new)]
    keep = set(i for i, p in enumerate(paths) if is_main(p) and wrapper.dropped.get(places[at[i]], 0) < 2)
    if not keep:
        blocks_of = [0] * len(places)
        for k in at:
            blocks_of[k] += 1
        weights = []
        for p, k, (_, text, _, _) in zip(paths, at, found, strict=True):
            out = is_marked(p) or wrapper.dropped.get(places[k], 0) > 0
            weights.append(0.0 if out else max(wrapper.weight.get(places[k], len(text) * blocks_of[k]) / blocks_of[k], 0.1))
        keep = set(densest([_container(b) for b in found], weights))
    return "\n\n".join(b[1] for i, b in enumerate(found) if i in keep)


def _container(block: Block) -> tuple[int, ...]:
    """The elements around a block, without those that only hold one text."""
    path, own = block[0], block[3]
    n = len(path)
    while n and path[n - 1].rstrip("+-") in TEXTUAL:
        n -= 1
    return own[:n]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, Wrappers] = {}
    for batch in batches:
        out = [article(page, _wrappers(known, wrapper, found)) for page, wrapper, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every page."""
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    found = cut(wrappers(pages))
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    found = cut(found.join(boilerplate(pages.join(_small(found, size), "host")), "host", "left"))
    size += found.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    kind = pages.schema["id"].dataType.simpleString()
    joined = pages.join(_small(found, size), "host", "left").select("id", "url", "html", "wrapper", "found")
    return joined.mapInArrow(_extract, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)

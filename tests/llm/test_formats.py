"""Chat formatting, page extraction, packing and the pipeline."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import chat, packing, wrapper

SF = "/root/testdata/sf0.001"
EVENTS = "conv_id long, seq long, kind string, target string, role string, text string, extra int"


def test_fold(spark):
    rows = [
        (1, 0, "message", None, "user", "hi", 0), (1, 1, "message", "m", "assistant", "Hel", 0), (1, 2, "delta", "m", None, "lo", 0), (1, 3, "delta", "m", None, "!", 0),
        (1, 4, "message", "n", "user", "more", 0), (1, 5, "edit", "n", None, "less", 0), (1, 6, "regenerate", "m", None, "ignored", 0), (1, 7, "delta", "m", None, "Good", 0), (1, 8, "delta", "m", None, " day", 0),
        (1, 9, "message", "gone", "user", "x", 0), (1, 10, "delete", "gone", None, None, 0), (2, None, "message", None, None, None, 0),
    ]
    out = chat.reconstruct(spark.createDataFrame(rows[::-1], EVENTS)).orderBy("conv_id", "seq").collect()
    assert [(r.conv_id, r.role, r.text) for r in out] == [(1, "user", "hi"), (1, "assistant", "Good day"), (1, "user", "less"), (2, None, "")]


def test_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s><\\\\s>[\\INST]", "<<SYS>><<<</SYS>>>><s", "[[INST]]<s></s>", "", " a\n", "<<<s>", "\\", "é<s>"]
    rows = [(c, i, role, t) for c, role in enumerate(("user", "assistant", "system", "tool", "[INST]", None)) for i, t in enumerate(texts)] + [(0, 0, "user", texts[0]), (9, 0, "assistant", None)]
    data = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")
    segments = chat.render(data)
    for r in segments.collect():
        assert chat.parse(r.segment) == (r.role or "", r.text or "")
        body = r.segment[r.loss_start : r.loss_end] if r.loss_start is not None else ""
        assert (chat.unescape(body) == r.text) if r.role == "assistant" else r.loss_start is None
    found = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((i, role or "", t or "") for x, i, role, t in rows if x == c))
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.render(data.limit(0))).count() == 0
    assert chat.read_back(chat.render(spark.createDataFrame([(None, 1, "user", "x")], data.schema))).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert found[r.page_id] == "\n\n".join(x for x in parts if x)


def test_pages_without_landmarks(spark):
    page = lambda i: f"<html><body><div class='top'><a href='/'>Home</a> <a href='/x'>Shop</a></div><div class='txt'><h2>Title {i}</h2><p>Body text &amp; more of page {i}.<p>Second\n para {i}</div>" + (f"<div class='comments'><p>Nice {i}</p></div>" if i % 2 else "") + "<div class='bottom'>All rights reserved</div></body>"
    rows = [(i, "http://h.example/a", page(i), "x") for i in range(8)] + [(90, None, None, "x"), (91, "http://h.example/b", "", "x"), (92, "x", "plain &lt; text", "x"), (93, "http://h.example/c", "<p>a<script>var b</p>", "x")]
    data = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in wrapper.extract(data.union(data.limit(1))).collect()}
    for i in range(8):
        assert found[i] == f"Title {i}\n\nBody text & more of page {i}.\n\nSecond para {i}"
    assert [found[i] for i in (90, 91, 92, 93)] == ["", "", "plain < text", "a"]
    assert wrapper.extract(data.limit(0)).count() == 0


def test_pages_of_several_templates(spark):
    """A main element on one page decides nothing on others; copies of an article are one page; more than eight texts count exactly."""
    plain = lambda t: f"<html><body><div><a href='/'>Home</a> <a href='/x'>Shop</a></div><div><h2>{t}</h2><p>Body of {t}.</div><div>All rights reserved</div></body>"
    rows = [(i, "http://two.example/a", plain(f"Story {i}")) for i in range(4)]
    rows += [(i, "http://two.example/b", f"<body><nav>Top</nav><article><p>Piece {i}</article><p>Outside</body>") for i in range(4, 7)]
    rows += [(i, None, f"<div><p>Loose {i}</div>") for i in range(10, 14)] + [(14, "x", "<article>Lone</article><p>by</p>")]
    rows += [(i, "http://copies.example/c", plain("Copied")) for i in range(20, 26)] + [(i, "http://copies.example/d", plain(f"Own {i}")) for i in range(26, 30)]
    many = lambda i: f"<table><tr><td>Text {i}</td></tr></table><ul><li>{'Often' if i % 5 < 3 else f'Rare {i}'}</li></ul>"
    rows += [(i, "http://many.example/", many(i)) for i in range(100, 160)]
    found = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert [found[i] for i in range(4)] == [f"Story {i}\n\nBody of Story {i}." for i in range(4)]
    assert [found[i] for i in range(4, 7)] == [f"Piece {i}" for i in range(4, 7)]
    assert [found[i] for i in range(10, 15)] == [*(f"Loose {i}" for i in range(10, 14)), "Lone"]
    assert [found[i] for i in range(20, 30)] == ["Copied\n\nBody of Copied."] * 6 + [f"Own {i}\n\nBody of Own {i}." for i in range(26, 30)]
    assert [found[i] for i in range(100, 160)] == [f"Text {i}" for i in range(100, 160)]


def test_alignment_makes_optional_and_repeated():
    slot = lambda p: {"path": p, "pages": 1, "chars": 5, "linked": 0, "optional": False, "texts": {p: 1}}
    out = wrapper.align([slot("a"), slot("b"), slot("d")], [slot("a"), slot("c"), slot("d")])
    assert [(s["path"], s["optional"], s["pages"]) for s in out] == [("a", False, 2), ("b", True, 1), ("c", True, 1), ("d", False, 2)]


def test_packing(spark):
    odd = ["", None, "a", "  two  blanks ", "\n\nlines\n", "tab\tand wide space   x", "it's 12,5% — “quoted” naïve", "<|endoftext|>", "x " * 3000, "né́", "…　\n"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(i, t) for i, t in enumerate(odd, 10_000)] + [(10_000, ""), (None, "null id")]
    data = docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("start", F.lit("clash"))
    found = packing.pack(data, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [(r.doc_id, r.text or "") for r in data.collect()]
    expected = sorted((-1 if i is None else i, np.array([*e.ids, 0], dtype="<u4").tobytes()) for (i, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True))
    joined = []
    for (i, _), g in found[found.doc_id != 10_000].sort_values("start").groupby(["doc_id", "doc_tokens"], dropna=False):
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]]
        joined.append((-1 if i != i else int(i), b"".join(g.ids)))
    assert sorted(joined) == [x for x in expected if x[0] != 10_000]
    assert (found.ids_crc32 == found.ids.map(zlib.crc32)).all() and (found.doc_id == 10_000).sum() == 2
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    sizes = found.groupby("sequence_id").length.sum()
    assert sorted(sizes.index) == list(range(len(sizes)))
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.01 * sizes.sum()
    assert packing.pack(data.limit(0)).count() == 0


def test_cuts_add_up():
    for r, own in enumerate(packing.cuts(1024)):
        assert sum(own) == r and len(own) <= 6


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = out.select("doc_id").distinct()
    assert kept.join(docs, "doc_id", "left_anti").count() == 0 and 0.6 * docs.count() < kept.count() < docs.count()


def stripped(page):
    """The page without anything that names its parts."""
    page = re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r'<div class="[^"]*">', "<div>", page)


def test_pages_stripped_of_landmarks(spark):
    """Hosts of several pages: the container that slot variation and weight choose is the one that the tags name."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = F.regexp_extract("url", r"://([^/:]+)", 1)
    several = pages.withColumn("h", host).groupBy("h").count().where("count >= 5").select("h")
    own = pages.withColumn("h", host).join(several, "h").select("page_id", "url", "html").collect()
    plain = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in own], pages.schema)
    assert not any(re.search(r"<(article|nav|footer)|class=", r.html) for r in plain.collect())
    with_, without = ({r.page_id: r.text for r in wrapper.extract(x).collect()} for x in (spark.createDataFrame(own, pages.schema), plain))
    same = sum(with_[i] == without[i] for i in with_)
    print(f"{same} of {len(with_)} pages alike")
    assert same >= 0.95 * len(with_) and len(with_) > 60


def test_many_streams_of_a_host_are_split(spark, monkeypatch):
    """Streams of a host are aligned in parts, and parts give what one part gives."""
    page = lambda i: "<body><div><a href='/'>Home</a></div><div>" + "".join(f"<h{1 + (i >> k) % 3}>t{i} {k}</h{1 + (i >> k) % 3}><p>Text {i} of part {k}.</p>" for k in range(1 + i % 6)) + "</div><div>The end</div></body>"
    rows = [(i, "http://one.example/", page(i)) for i in range(120)]
    data = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in wrapper.extract(data).collect()}
    monkeypatch.setattr(wrapper, "STREAMS", 5)
    assert {r.page_id: r.text for r in wrapper.extract(data).collect()} == whole
    assert all(whole[i].startswith(f"t{i} 0\n\nText {i} of part 0.") and "Home" not in whole[i] and "The end" not in whole[i] for i in range(120))

"""Chat logs against a fold in Python, and structured words in packing, dedup and passage removal."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tesserae.llm import chat, minhash, packing, suffix

EVENTS = "conv_id long, seq long, kind string, target string, role string, text string, extra int"


def folded(rows):
    """The messages of one log by its events in order."""
    out, live = [], {}
    for c, seq, kind, target, role, text, _ in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[5] or "")):
        if target is None:
            if kind == "message":
                out.append((c, seq, role, text or ""))
            continue
        m = live.setdefault((c, target), {"seq": seq, "role": None, "text": "", "dropped": False})
        m["role"] = role if role is not None else m["role"]
        if kind in ("message", "edit"):
            m.update(text=text or "", dropped=False)
        elif kind == "regenerate":
            m.update(text="", dropped=False)
        elif kind == "delete":
            m.update(text="", dropped=True)
        elif not m["dropped"]:
            m["text"] += text or ""
    return sorted([*out, *((c, m["seq"], m["role"], m["text"]) for (c, _), m in live.items() if not m["dropped"])], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(6):
        for seq in rnd.sample(range(400), 60):
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            target = rnd.choice(["a", "b", "c", "d"]) if kind != "message" or rnd.random() < 0.8 else None
            rows.append((c, seq, kind, target, rnd.choice(["user", "assistant", None]), rnd.choice(["x", "yy", "", None, "z"]), 0))
    found = chat.reconstruct(spark.createDataFrame(rows, EVENTS).repartition(3)).collect()
    assert sorted(((r.conv_id, r.seq, r.role, r.text) for r in found), key=str) == folded(rows)


def test_text_after_a_deletion_is_dropped(spark):
    rows = [(1, 0, "message", "m", "user", "a", 0), (1, 1, "delete", "m", None, None, 0), (1, 2, "delta", "m", None, "late", 0), (2, 0, "delete", "m", None, None, 0), (2, 0, "edit", "m", "user", "kept", 0)]
    assert [(r.conv_id, r.text) for r in chat.reconstruct(spark.createDataFrame(rows, EVENTS)).collect()] == [(2, "kept")]


def swapped(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_structured_words(spark, n):
    a, b = swapped(n)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = spark.createDataFrame([(1, f"x {a} {b} {a}"), (2, b), (3, a)], "doc_id long, text string").coalesce(1)
    found = packing.pack(data, with_ids=True).toPandas()
    for i, text in ((1, f"x {a} {b} {a}"), (2, b), (3, a)):
        ids = np.frombuffer(b"".join(found[found.doc_id == i].sort_values("start").ids), dtype="<u4")
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(data.where("doc_id > 1")).collect()}
    assert groups == {2: 2, 3: 3}
    kept = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(spark.createDataFrame([(1, a[:300]), (2, b[:300])], "doc_id long, text string")).collect()}
    seen = [t[i : i + 200] for t in (a[:300], b[:300]) for i in range(101)]
    assert all(len(kept[i]) < 300 for i in (1, 2)) == (len(set(seen)) < len(seen))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With a hash that sees lengths only, ids are still those of the bytes."""
    monkeypatch.setattr(packing, "span_hash", lambda prefix, start, end: (end - start).astype(np.uint64))
    cache = packing.Units(packing.default_vocabulary())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("one two six ten", "ten cow one dog", "bee"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ids, count = packing.encode_chunk(cache, data, np.array([0, len(data)]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and count.tolist() == [len(ids)]


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than a piece, and heavy anchors by aggregates, give what whole scans and windows give."""
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    passage = make(700)
    rows = [(1, make(3000) + passage + make(1500)), (2, passage), (3, make(900) + passage[:450]), (4, make(5000)), (5, ""), *((10 + i, make(40) + passage[100:400]) for i in range(30))]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda out: sorted((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in out.collect())
    whole = digest(suffix.remove_repeats(data))
    assert digest(suffix.remove_repeats(data, heavy=2, sample=1)) == whole
    want, got = [], []
    for piece in (suffix.PIECE, 1000):
        monkeypatch.setattr(suffix, "PIECE", piece)
        monkeypatch.setattr(suffix, "texts", lambda column: ((i, i + 1, np.frombuffer((t.as_py() or "").encode(), dtype=np.uint8), np.array([0, len((t.as_py() or "").encode())])) for i, t in enumerate(column)))
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows])], ["id", "k", "text"])
        windows = set()
        for out in suffix._scan(200, 32)(iter([batch])):
            for i, pack in zip(out.column("id").to_pylist(), out.column("pack").to_pylist(), strict=True):
                windows |= {(i, (pack >> 24) + d) for d in range((pack >> 16 & 255) + 1)}
        (got if piece == 1000 else want).append(windows)
    assert want == got and want[0] == {(i, w) for i, t in rows for w in range(len(t) - 199)}

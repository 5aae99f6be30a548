"""Spelling variants, the secret ledger and structure repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tesserae.llm import registry, secrets, spelling, structure

SF = "/root/testdata/sf0.001"


# --- spelling variants


def brute_words(docs, every=199, least=5):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def at_distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if v != w and at_distance_one(w, v)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        out[w] = (len(near), best if best is not None and count[best] >= 5 * n else None)
    rows = set()
    for w, (n_near, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows.add((w, count[w], n_near, form, count.get(form), root))
    return rows


def found_variants(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_variants_of_random_words(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 9))) for _ in range(60)]
    docs = []
    for i in range(300):
        words = [rnd.choice(base) for _ in range(rnd.randrange(60))]
        docs.append((rnd.choice([i, 7, None]), rnd.choice([" ", ", ", "1"]).join(rnd.choice([w, w.upper(), w + rnd.choice("ab")]) for w in words) if i % 17 else rnd.choice(["", None, "12 34"])))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(5)
    count = brute_words(docs)
    assert {(r.word, r.n) for r in spelling.vocabulary(df, every=199).collect()} == set(count.items())
    found = spelling.variants(spelling.vocabulary(df, every=199)).collect()
    assert len(found) == len({r.word for r in found})
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == brute_variants(count)


def test_variants_of_the_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found_variants(registry.QUERIES["op11_spelling_variants"](spark, SF)) == brute_variants(brute_words(docs))


def test_chains_of_forms_ties_and_long_runs(spark):
    long = "ab" * 40_000
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("zzzzzz", 5), ("zzzzzy", 30), ("zzzzyz", 30), (long, 5), (long + "a", 30), (long[:-1] + "c", 29)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert found["aaaaaa"].root == "aaabbb" and found["aaaaab"].form == "aaaabb" and found["aaabbb"].form is None and found["aaabbb"].root == "aaabbb"
    assert (found["zzzzzz"].form, found["zzzzzz"].n_near) == ("zzzzyz", 2)
    assert (found[long].form, found[long].n_near, found[long].root) == (long + "a", 2, long + "a")
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_hashes_of_deletions():
    import numpy as np

    from tesserae.llm.common import deletion_hash, prefix_hash, span_hash

    data = np.frombuffer(b"xxhello worldhelo world", dtype=np.uint8)
    prefix = prefix_hash(data)
    gone = deletion_hash(prefix, np.array([2, 2]), np.array([4, 5]), np.array([13, 13]))
    assert gone[0] == gone[1] == span_hash(prefix, np.array([13]), np.array([23]))[0]


# --- secret ledger


def brute_base(text):
    out = []
    for kind, (pattern, flags, group, least) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("AKIA[A-Z0-9]+", 0, 0, 16), ("[0-9a-f]+", 0, 0, 32)]):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def test_secrets_of_the_query(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: r for r in registry.QUERIES["op12_secret_scan"](spark, SF).collect()}
    assert len(found) == len(docs)
    for i, text in docs:
        base = brute_base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = found[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= {*r.spans.split(","), ""}


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    key = "AKIA" + "Z9" * 8
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.abc"
    rows = [("a", 1, "é token = 'abcdefgh'"), ("a", 2, f"{key} {'0f' * 16}"), ("b", 1, f"{key} {'0f' * 16}"), ("c", 1, None), ("c", 2, ""), (None, 1, jwt), ("b", 1, f"{key} {'0f' * 16}")]
    versions = lambda rows: secrets.addressed(spark.createDataFrame([(*r, 0) for r in rows], "p string, v int, t string, blob int"), "p", "t", "v")
    scanned = lambda: {(r.blob, r.kind, r.version) for r in spark.read.parquet(folder).collect()}
    ledger = secrets.update(versions(rows), folder)
    assert ledger.count() == 4 * len(secrets.RULES) == len(scanned())
    found = secrets.findings(versions(rows), ledger).collect()
    assert len(found) == len(rows)
    spans = {(r.path, r.revision): [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    assert spans == {("a", "1"): [("assign", 2, 19)], ("a", "2"): (two := [("access", 0, 20), ("hex", 21, 53)]), ("b", "1"): two, ("c", "1"): [], ("c", "2"): [], (None, "1"): [("jwt", 0, len(jwt))]}
    # a second run with one new version scans that blob alone
    more = [*rows, ("d", 1, "passwd:hunter22"), ("d", 2, key)]
    new = secrets.scan(versions(more), secrets.read_ledger(spark, folder)).collect()
    assert {r.blob for r in new} == {hashlib.sha256(t.encode()).hexdigest() for t in ("passwd:hunter22", key)}
    secrets.update(versions(more), folder)
    # a new version of one rule is scanned by that rule alone, over all blobs; its earlier results no longer count
    changed = tuple(r._replace(version=2, least=25) if r.kind == "access" else r for r in secrets.RULES)
    ledger = secrets.update(versions(more), folder, changed)
    assert ledger.where("version = 2").count() == 6 and ledger.where("version = 1").count() == 6 * len(secrets.RULES)
    assert {(r.path, r.revision) for r in secrets.findings(versions(more), ledger, changed).where("size(spans) > 0").collect()} == {("a", "1"), ("a", "2"), ("b", "1"), ("d", "1"), (None, "1")}
    assert secrets.scan(versions(more), ledger, changed).isEmpty()


def test_base_patterns_on_random_texts(spark):
    rnd = random.Random(3)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "A1B2C3D4", "abcdef01", "0123456789abcdef", "é", "\n", "x", "ſecret=", "-", "K"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(400)]
    addressed = secrets.addressed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    found = {r.path: [(s.kind, s.start, s.end) for s in r.spans if s.place < 3] for r in secrets.findings(addressed, secrets.ledger_in(addressed)).collect()}
    assert found == {i: brute_base(t) for i, t in rows}
    empty = secrets.addressed(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert secrets.findings(empty, secrets.ledger_in(empty)).isEmpty()


# --- structure repair


def sound(x):
    return re.fullmatch("(s?(ua)+)?", x) is not None


def cheapest(rows):
    """(cost, audit, repaired) by a search over all edits: states are places and initials so far, cut to what the pattern needs."""
    fault, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = lambda q, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, c))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(out), fault
        if (i, q) in done and len(rows) > 7:
            continue
        done.add((i, q))
        ways = []
        if i < len(rows):
            role, text = rows[i]
            ways.append((3, "D", i + 1, q, ()))
            if fault[i] not in ("blank", "duplicate"):
                extra = int(fault[i] == "truncated")
                ways.append((extra, "K", i + 1, step(q, role[:1]), (f"{role}:{text}",)))
                ways += [(2 + extra, "R", i + 1, step(q, to[0]), (f"{to}:{text}",)) for to in ("user", "assistant")]
        ways += [(2, "I", i, step(q, to[0]), (f"{to}:",)) for to in ("user", "assistant")]
        for c, x, j, r, more in ways:
            if r is not None and len(audit) < 2 * len(rows) + 6:
                heapq.heappush(heap, (cost + c, audit + x, j, r, out + more))


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_repair(rows, ids):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for c in ids:
        own = sorted(groups[c])
        cost, audit, repaired, fault = cheapest([(r[2], r[4]) for r in own])
        turns = [r[1] for r in own if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[c] = (gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found_repair(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[x] for x in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_random_conversations(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(150):
        for t in range(rnd.randrange(8)):
            turn = None if rnd.random() < 0.1 else t + 3 * (rnd.random() < 0.1)
            rows.append((None if c == 0 else c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rnd.choice(["a.", "b!", "c", "d?  ", " ", None, "e.e", "f. ", "g.", "h."])))
    rows += [(500, 1, "user", "twice."), (500, 1, "user", "twice.")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(6)
    expected = brute_repair(brute_damage(rows), {r[0] for r in rows})
    assert found_repair(structure.repair(structure.damage(turns), turns)) == expected
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found_repair(structure.repair(turns)) == brute_repair(plain, {r[0] for r in rows})


def test_long_conversation_over_many_partitions(spark):
    rnd = random.Random(1)
    texts = [f"text {i}." for i in range(300)] + ["no stop", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice(texts)) for c, n in ((1, 40), (2, 900), (3, 5)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = structure.faults(turns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = structure._dealt(found.repartition(3))
        assert len(structure._chained(dealt)) >= 3  # one conversation crosses borders
        assert found_repair(structure.repair(turns)) == brute_repair(rows, {1, 2, 3})
        decisions = structure.plan(turns)[1]
        out = structure.repaired(turns, decisions).groupBy("conv_id").count().collect()
        assert sum(r["count"] for r in out) == structure.repaired(turns, decisions, whole=True).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.repair(structure.damage(empty), empty).isEmpty()
    gone = spark.createDataFrame([(9, None, None, None)], "conv_id long, turn long, role string, text string")
    assert found_repair(structure.repair(empty, gone)) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_the_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found_repair(registry.QUERIES["op13_structure_repair"](spark, SF)) == brute_repair(brute_damage(rows), {r[0] for r in rows})

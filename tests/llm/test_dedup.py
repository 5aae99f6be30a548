"""Near-duplicates, repeated passages and decontamination against brute force, with the odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tesserae.llm import decontam, graph, minhash, suffix

ODD = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "one two"), (None, "one")]


def docs_of(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id long, k string")


def closure(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent", "bands"), [(3, 85, 20), (5, 80, 28)])
def test_near_duplicates(spark, width, percent, bands):
    rnd = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 150]))]
        for _ in range(rnd.choice([1, 2, 6, 60])):
            own = list(words)
            for _ in range(rnd.randint(0, 5)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(own).upper()))
    rows += ODD
    found = minhash.near_duplicates(docs_of(spark, rows + rows[:3]), width=width, percent=percent, bands=bands).collect()
    assert len(found) == len(rows) + 2  # the null id is not returned, repeats are
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = closure(sets, linked)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], r.doc_id == expected[r.doc_id])


def test_near_duplicates_around_a_hub(spark):
    """Copies that are near the original only, in buckets too large for pairs."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(120)] = rnd.choice(vocab)
        rows.append((i, " ".join(own)))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    assert found == closure(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (700, 150, 150))
    h = np.concatenate((common, a, common, b))
    sig = minhash.signatures(h, np.repeat([0, 1], [850, 850]), 2, 240)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.1
    few = minhash.signatures(h[:3], np.zeros(3, dtype=np.int64), 1, 80)
    assert (few != np.uint64(2**64 - 1)).all()  # every position is filled by any set


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def removed(rows, length):
    seen = {}
    for n, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((n, i))
    masks = [np.zeros(len((t or "").encode()), dtype=bool) for _, t in rows]
    for at in seen.values():
        if len(at) > 1:
            for n, i in at:
                masks[n][i : i + length] = True
    return masks


@pytest.mark.parametrize("hot", [20_000, 3])
def test_remove_repeats(spark, hot):
    rnd = random.Random(7)
    make = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [make(n) for n in (190, 205, 260, 800)]
    rows = []
    for i in range(30):
        own = make(rnd.randint(0, 400))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            own += p[rnd.randint(0, 20) :] + make(rnd.randint(0, 90))
        rows.append((i, own))
    rows += [(40, "a" * 700), (41, "ab" * 300), (42, rows[1][1]), (43, passages[3]), (44, passages[3] + "x" + passages[3])]
    rows += [r for r in ODD if r[0] is not None] + [rows[0], (45, rows[3][1])]
    found = suffix.remove_repeats(docs_of(spark, [*rows, (None, passages[3])]), hot=hot, carry=("k",)).collect()
    masks = sorted((i, hashlib.sha256(np.frombuffer((t or "").encode(), np.uint8)[~m].tobytes()).hexdigest(), int(m.sum())) for (i, t), m in zip(rows, removed(rows, 200), strict=True))
    assert sorted((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes - len(r.kept)) for r in found) == masks
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept)
        assert r.row.k == "x"


ITEMS = [
    (1, "If a train covers 120 km in 3 hours how far does it go in 5 hours"),
    (2, "the quick brown fox jumps over the lazy dog near the old river"),
    (3, "tell me what Alice paid when Bob gave Alice nine coins today again"),
    (4, "short items match whole"),
    (5, "five words make one item"),
    (None, "the item without an id is left out of all this"),
    (7, None),
]


def test_contaminated(spark):
    rows = [
        (1, "Intro. " + ITEMS[1][1] + " and so on"),
        (2, "We ask: If a train covers 400 miles in 7 hours how far does it go in 9 hours, then."),
        (3, "so tell me what Carol paid when Dave gave Carol nine coins today again"),
        (4, "so tell me what Carol paid when Dave gave Erin nine coins today again"),
        (5, "THE QUICK BROWN FOX".lower() + " jumps over the cat"),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
        (7, "x five words, make one ITEM".lower()),
        (8, "short items match whole"),
        (9, None),
        (10, ""),
        (None, ITEMS[1][1]),
    ]
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id long")
    found = {(r.doc_id, r.item_id): r.n_windows for r in decontam.contaminated(docs_of(spark, rows + rows[:1]), items).collect()}
    # the window of eight tokens in row 4 that ends before Erin is consistent, so the row is found by it
    assert set(found) - {(4, 3)} == {(1, 2), (2, 1), (3, 3), (7, 5), (8, 4)}
    assert found[1, 2] == 2 * (len(re.findall(r"\w+", ITEMS[1][1])) - 7)
    plan = decontam.contaminated(docs_of(spark, rows), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_and_scripts_without_blanks(spark):
    """Items of two to four tokens go by their literal values; of scripts without blanks each letter is a token."""
    items = spark.createDataFrame([(1, "capital of France? Paris"), (2, "日本の首都はどこですか"), (3, "cost 12 km"), (4, "word"), (5, "東京"), (6, "กรุงเทพมหานครอยู่ที่ไหน")], "item_id long, text string")
    rows = [(1, "The capital of France? Paris."), (2, "THE CAPITAL OF FRANCE? PARIS."), (3, "the capital of Spain? Madrid"), (4, "問い:日本の首都はどこですか。東京です"), (5, "日本の首都はどこにあるか"), (6, "Cost 12 km"), (7, "cost 13 km"), (8, "a word"), (9, "abc東京xyz"), (10, "xกรุงเทพมหานครอยู่ที่ไหนx")]
    found = {(r.doc_id, r.item_id): (r.n_windows, r.first_token, r.last_token) for r in decontam.contaminated(docs_of(spark, rows), items).collect()}
    assert {k: v for k, v in found.items() if k[1] not in (2, 6)} == {(1, 1): (1, 1, 5), (2, 1): (1, 1, 5), (4, 5): (1, 13, 15), (6, 3): (1, 0, 3), (9, 5): (1, 1, 3)}
    # the first eight letters of row 5 are a window of the item
    assert {k for k in found if k[1] in (2, 6)} == {(4, 2), (5, 2), (10, 6)} and found[4, 2] == (len(ITEM_JA) - 7, 2, 2 + len(ITEM_JA))


ITEM_JA = "日本の首都はどこですか"


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "add 5 and 5 then take 7 away")], "item_id long, text string")
    rows = [(1, "add 3 and 3 then take 9 away"), (2, "add 3 and 4 then take 9 away"), (3, "add 3 and 3 then take 3 away")]
    assert {r.doc_id for r in decontam.contaminated(docs_of(spark, rows), items).collect()} == {1}


def test_passages_in_capitals_are_found(spark):
    """Every word after a blank looks like a name; what both readings find counts once, repeated rows as often as they occur."""
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id long")
    text = ITEMS[1][1]
    rows = [(1, f"intro {text} and so on"), (2, f"intro {text} and so on".upper()), (3, text.title()), (4, ITEMS[0][1].upper()), (5, "tell me what Alice paid when Bob gave Alice nine coins today again")]
    found = {(r.doc_id, r.item_id): (r.n_windows, r.first_token, r.last_token) for r in decontam.contaminated(docs_of(spark, rows + rows[1:2]), items).collect()}
    n = len(text.split())
    assert found == {(1, 2): (n - 7, 1, n + 1), (2, 2): (2 * (n - 7), 1, n + 1), (3, 2): (n - 7, 0, n), (4, 1): (10, 0, 17), (5, 3): (6, 0, 13)}


def test_windows_of_slots_and_of_several_items(spark):
    """Windows of numbers go by their values, names may begin a sentence, a shared window is found for all its items."""
    numbers, shared = "12 + 30 = 42, 17 * 3 = 51, 9 - 4 = 5", "one two three four five six seven eight"
    items = spark.createDataFrame([(1, numbers), (2, "Tom has 12 red apples"), (3, f"{shared} nine"), (4, shared), (5, "Marie Curie Won Nobel Prizes In Physics And Chemistry")], "item_id long, text string")
    rows = [(1, f"Sums: {numbers}."), (2, numbers.replace("4", "6")), (3, "See. Ben has 30 red apples."), (4, f"zero {shared} ten"), (5, "so Marie Curie Won Nobel Prizes In Physics And Chemistry"), (6, "Ben had 30 red apples.")]
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), items).collect()}
    assert found == {(1, 1), (3, 2), (4, 3), (4, 4), (5, 5)}


def test_empty_tables(spark):
    none = docs_of(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs_of(spark, [(1, "a b c d e f g h i j")]), items).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 500])
def test_components_of_hubs(spark, hot):
    """Hubs, chains of hubs, repeated and null edges, whatever number of edges is many."""
    rnd = random.Random(hot)
    edges = [(100, i) for i in range(101, 160)] + [(160 + i, 100) for i in range(20)] + [(300, 301), (301, 100), (500, 501), (501, 500), (7, 7)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)] + [(None, 3), (4, None)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), hot=hot).collect()}
    ends = [e for e in edges if None not in e]
    assert found == closure({i for e in ends for i in e}, ends)
    assert graph.components(spark.createDataFrame([], "a long, b long"), hot=hot).count() == 0

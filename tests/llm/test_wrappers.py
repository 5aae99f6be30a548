"""Wrappers vote on every page, landmarks are a prior; alignments of very long streams."""

import random
import time

import pytest

from tesserae.llm import wrapper

WORDS = "amber basin cedar delta ember fjord grove heron inlet jetty knoll lagoon maple north orchid prairie quarry ridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def longest(a, b):
    """The plain table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_against_the_plain_table():
    rng = random.Random(5)
    for _ in range(1500):
        k = rng.choice([1, 2, 4, 12])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(40))] for _ in range(2))
        out = wrapper.matches(a, b)
        both = [(i, j) for i, j in out if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == longest(a, b)
        assert [i for i, _ in out if i is not None] == list(range(len(a))) and [j for _, j in out if j is not None] == list(range(len(b)))


def test_alignment_of_very_long_streams():
    rng = random.Random(6)
    a, b = ([str(rng.randrange(3000)) for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    assert len(wrapper.matches(a, b)) <= 40_000
    assert time.perf_counter() - began < 20


def extracted(spark, rows):
    frame = spark.createDataFrame([(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrapper.extract(frame.repartition(4)).collect()}


def test_unmarked_notice_inside_a_main_element(spark):
    """All pages say themselves what their article is; the wrapper finds what they all repeat in it."""
    rng = random.Random(7)
    bodies = [prose(rng, 20 + 12 * k) for k in range(14)]
    page = "<body><nav>Home</nav><main><h1>Title {k}</h1><p>{body}</p><div>Read this in our app</div></main><footer>f</footer></body>"
    found = extracted(spark, [("news", page.format(k=k, body=x)) for k, x in enumerate(bodies)])
    assert found == {k: f"Title {k}\n\n{x}" for k, x in enumerate(bodies)}


def test_near_copies_keep_what_they_share(spark):
    """A host of near copies of one article, and a host with few pages: nothing inside the main element goes."""
    rng = random.Random(8)
    body = prose(rng, 300)
    rows = [("copies", f"<main><h1>One heading</h1><p>{body} {k}</p><div>Its last line</div></main>") for k in range(40)]
    rows += [("few", f"<main><h1>Same</h1><p>{prose(rng, 30 + 30 * k)}</p></main>") for k in range(3)]
    found = extracted(spark, rows)
    assert all(found[k] == f"One heading\n\n{body} {k}\n\nIts last line" for k in range(40))
    assert all(found[40 + k].startswith("Same\n\n") for k in range(3))


def test_main_element_without_an_article(spark):
    """The main element holds only what all pages repeat: the article is where the text is."""
    rng = random.Random(9)
    bodies = [prose(rng, 40 + 15 * k) for k in range(12)]
    page = "<body><main><p>Loading</p></main><div class=wrap><section><p>{body}</p></section></div></body>"
    assert extracted(spark, [("late", page.format(body=x)) for x in bodies]) == dict(enumerate(bodies))


def decided(rows):
    """The same texts from plain loops over all pages of each host: whole tables, dictionaries, no Spark."""
    out = {}
    for host in {h for h, _ in rows}:
        own = [(k, page, wrapper.folded(page)) for k, (h, page) in enumerate(rows) if h == host]
        streams = sorted({tuple(s[0] for s in f) for _, _, f in own if f}, key=lambda s: (-len(s), "\n".join(s)))
        known = wrapper.templates([(list(s), [{"path": p, "pages": 1, "optional": False} for p in s]) for s in streams])
        seen, place_of = {}, {}
        for k, page, slots in own:
            stream = [s[0] for s in slots]
            share = lambda t: (sum(min(stream.count(p), t.count(p)) for p in set(stream)))
            best = max(range(len(known)), key=lambda t: (share([s["path"] for s in known[t][1]]), share(known[t][0]) / (len(stream) + len(known[t][0]))), default=None)
            places = [None] * len(stream)
            for i, j in wrapper.matches([s["path"] for s in known[best][1]], stream) if slots else []:
                if i is not None and j is not None:
                    places[j] = (best, i)
            place_of[k] = places
            plain = [(p, s[1:]) for p, s in zip(places, slots, strict=True) if not wrapper.is_marked(s[0])]
            size = int(wrapper.log1p(sum(s[1] for _, s in plain)) / wrapper.SIZE_CLASS)
            for p, s in plain:
                if p:
                    seen.setdefault(p, {})[tuple(plain)] = (s[0], s[1], s[2], size)
        sure, weak, weight = set(), set(), {}
        for p, pages in seen.items():
            texts = [v[0] for v in pages.values()]
            n, sizes = max((texts.count(t), len({v[3] for v in pages.values() if v[0] == t})) for t in set(texts))
            chars, linked = sum(v[1] for v in pages.values()), sum(v[2] for v in pages.values())
            weight[p] = round(chars / len(texts), 1)
            if sizes >= wrapper.SURE_PAGES and n >= wrapper.SURE * len(texts):
                sure.add(p)
            if (len(texts) >= wrapper.PAGES and n > wrapper.CONSTANT * len(texts)) or linked > wrapper.LINKED * max(chars, 1):
                weak.add(p)
        for k, page, slots in own:
            found, at, last = list(wrapper.blocks(page)), [], None
            for path, *_ in found:
                at.append(at[-1] + (path != last) if at else 0)
                last = path
            main = [i for i, b in enumerate(found) if wrapper.is_main("/".join(b[0])) and place_of[k][at[i]] not in sure]
            if not main:
                share = [0.0 if wrapper.is_marked("/".join(b[0])) or place_of[k][at[i]] in weak | sure else max(weight.get(place_of[k][at[i]], len(b[1]) * at.count(at[i])) / at.count(at[i]), 0.1) for i, b in enumerate(found)]
                main = wrapper.densest([wrapper._container(b) for b in found], share)
            out[k] = "\n\n".join(found[i][1] for i in sorted(main))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        host = rng.choice(["a", "b", ""])
        inner = "".join(rng.choice([f"<p>{prose(rng, rng.randrange(1, 40))}</p>", "<div>Read more</div>", "<p>Shared line</p>", f"<ul><li><a href=x>{rng.choice(WORDS)}</a><li>x</ul>", "<div class=advert>Buy</div>"]) for _ in range(rng.randrange(5)))
        side = rng.choice(["", "<div>Menu <a href=y>of links</a></div>", "<footer>c</footer>", f"<section><p>{prose(rng, 5)}</p></section>"])
        tag = rng.choice(["main", "div", "article"])
        rows.append((host, f"<body>{side}<{tag}>{inner}</{tag}><div>Terms</div></body>"))
    rows += rows[:10]
    assert extracted(spark, rows) == decided(rows)

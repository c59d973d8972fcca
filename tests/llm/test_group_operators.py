"""Embedding near-dedup, n-gram Jaccard join, HTML extraction and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import by_row, words_of
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import covertree, html, jaccard, langid
from graphloom.llm.common import components, near_components


def united(nodes, edges):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(ready):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    df = ready.createDataFrame([*edges, (None, 3)], "a long, b long")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = united(nodes, edges)
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    assert all(want[r.node] == want[r.component] for r in near_components(df, "a", "b").collect())
    assert components(df.limit(0), "a", "b").count() == 0


# --- Jaccard ---------------------------------------------------------------------------------------------------------


def plain_jaccard(rows):
    def shingles(t):
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    comp = united({d for d, _ in sets if d is not None}, edges)
    return Counter((d, len(s), comp.get(d)) for d, s in sets)


@pytest.mark.parametrize("plan", [jaccard.Plan(), jaccard.Plan(sample=0, common=1), jaccard.Plan(worth=0, before=1)])
def test_jaccard(docs, empty, plan):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text != "another text of id three"]
    df = docs.where("text is null or text <> 'another text of id three'")
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.similar_components(df, plan=plan).collect())
    assert got == plain_jaccard(rows)
    assert jaccard.similar_components(empty, plan=plan).count() == 0


def test_jaccard_of_many_near_copies(ready):
    """Chains of edits: members of a component that are far from each other."""
    rng = random.Random(6)
    rows = []
    for g in range(6):
        text = [f"g{g}w{rng.randint(0, 400)}" for _ in range(60 + 10 * g)]
        for _ in range(18):
            text = list(text)
            for _ in range(2):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = ready.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.similar_components(df).collect())
    assert got == plain_jaccard(rows)


@pytest.mark.parametrize("plan", [jaccard.Plan(), jaccard.Plan(sample=0, common=1), jaccard.Plan(sample=0, common=1, worth=0)])
def test_jaccard_of_short_chains_in_one_group(ready, plan):
    """A is linked with B and B with C, but not A with C; many of the chains have one prefix, and A is the least id."""
    rows = []
    for g in range(120):
        b = [f"c{g}w{i}" for i in range(24)]
        for t in ([*b[:-2], f"c{g}x", f"c{g}y"], b, [f"c{g}z", *b[1:]]):
            rows.append((len(rows), " ".join(t)))
    one = [{jaccard._signature(v[: plan.prefix(len(v))], 0) for _, v in jaccard.shingles(pa.array([t for _, t in rows[i : i + 3]]), plan)} for i in range(0, len(rows), 3)]
    assert sum(len(s) == 1 for s in one) >= 5
    df = ready.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard.similar_components(df, plan=plan).collect())
    assert got == plain_jaccard(rows)


# --- embeddings ------------------------------------------------------------------------------------------------------


def test_vectors(ready):
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for label in (0, 1, None):
        for c in rng.standard_normal((12, 8)):
            for _ in range(6):
                rows.append((i, [float(np.float32(x)) for x in c + 0.08 * rng.standard_normal(8)], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, [0.0] * 8, 0), (i + 3, None, 0), (i + 4, [float("nan")] + [1.0] * 7, 0), (i + 5, [], 0), (i + 6, [None] + [1.0] * 7, 1), (i + 7, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    rows += [(i + 8, [1e300] * 3, 0), (i + 9, [1e-300] * 3, 0), (i + 10, [1e300, 2e300, 0.0], 0)]
    df = ready.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    good = [(k, np.array(v, float) / max(map(abs, v)), lab) for k, v, lab in rows if k is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    edges = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    n, comp = Counter(x for e in edges for x in e), united({r[0] for r in rows if r[0] is not None}, edges)
    want = Counter((k, n[k] if k is not None else 0, comp.get(k), k is not None and comp[k] == k) for k, _, _ in rows)
    for part, pivots in ((1500, 32), (7, 4)):
        assert Counter(tuple(r) for r in covertree.near_duplicates(df, part=part, pivots=pivots).collect()) == want
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_dual_traversal_accepts_whole_nodes():
    rng = np.random.default_rng(3)
    raw = 1 + 0.001 * rng.standard_normal((60, 6))
    x = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
    t = covertree.Tree(x, 0.05)
    a, _, p, q = covertree.dual(t, t, raw, raw, np.ones(60, int), np.ones(60, int), 0.98, True)
    assert (a == 59).all() and len(p) < 60 * 10


# --- HTML ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Un&#233;<ul><li>a<li>b</ul><div class="comments"><p>Nice</p></div><script>x("</p>")</script></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & more\nOne two three four\nUné\na\nb"
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- open") == ""
    assert html.main_text("just text <b>here") == "just text here"
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.main_text("<p>a</p></b></div><p title='>'>b") == "a\nb"
    assert len(html.main_text("<p>" + "long " * 40_000)) == 40_000 * 5 - 1


def test_articles_come_in_page_order_and_names_only_weigh():
    assert html.main_text("<main><article><p>first</p></article><article><p>second</p></article></main>") == "first\nsecond"
    page = '<article><h1>T</h1><p class="notice">one</p><p class="share-price">two</p><p>three</p><div class="related-work"><p>four</p></div><section id="post-comment-policy"><p>five</p></section>{}</article>'
    assert html.main_text(page.format("")) == "T\none\ntwo\nthree\nfour\nfive"
    assert html.main_text(page.format('<div class="comment-list"><p>Nice</p></div><div class="adBox">Buy</div>')) == "T\none\ntwo\nthree\nfour\nfive"
    assert html.main_text('<body class="menu-left"><div class="ad">Buy</div><div class="content"><p>Long text of the page</p></div><div class="sidebar"><article><p>Card</p></article></div></body>') == "Long text of the page"
    assert html.main_text("<div><p>" + "The page itself. " * 20 + "</p></div><div class=x><article><p>Teaser</p></article></div>").startswith("The page itself.")


def plain_templates(rows, least, share, block_share):
    """The rule, page by page: (host, element) pairs that are templates."""
    pages, on = {}, {}
    for host, page in rows:
        pages.setdefault(host, set()).add(page)
        root = html.parse(page)
        html.hash_subtrees(root)
        own = html.contents(root)
        content = "\n".join(html.text_blocks(own, frozenset()))
        for inside, nodes in ((True, own), (False, [root])):
            for node, block in html._elements(nodes, inside) if not inside or own[0].tag in ("article", "main") else ():
                on.setdefault((host, node, block), set()).add(content)
    return {(h, n) for (h, n, block), c in on.items() if len(c) >= least and len(c) >= (block_share if block else share) * len(pages[h])}


def test_templates_equal_the_rule(ready):
    rng = random.Random(9)
    parts = ["<div class=a1>Top</div>", "<ul><li>x<li>y</ul>", "<section><p>Read more</p></section>", "<p>Same</p>"]
    rows = []
    for i in range(120):
        host = "h.example" if i % 3 else f"g{i % 4}.example"
        body = "".join(p for p in parts if rng.random() < 0.4)
        rows.append((host, f"<body>{body}<article><p>Text {rng.randint(0, 70)}</p>{body}</article></body>"))
    df = ready.createDataFrame([(f"http://{h}/p", p) for h, p in rows], "url string, html string")
    got = {(r.host, n) for r in html.templates(df).collect() for n in r.nodes}
    assert got == plain_templates(rows, 5, 0.01, 0.3) and got


def test_templates_go_and_articles_stay(ready):
    def page(i):
        body = f"<p>Story {i} text</p><p>Same line in all</p>"
        return f"<body><article><div class=x1><span>Follow us</span></div>{body}</article></body>" if i % 2 else f"<body><div class=q9><i>Top links</i></div><div><p>Tale {i}</p></div></body>"

    rows = [(i, "http://h.example/a", page(i)) for i in range(40)] + [(100, "http://h.example/a", page(1))] * 7 + [(200, None, page(3)), (201, "http://other.example/", page(5)), (202, "http://h.example", None)]
    df = ready.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars) for r in by_row(html.extract(df, ["page_id"]))}
    texts = dict((p, t) for p, t, _ in got)
    assert texts[1] == texts[100] == "Story 1 text\nSame line in all" and texts[2] == "Tale 2"
    assert texts[200].startswith("Follow us") and texts[201].startswith("Follow us") and texts[202] == ""
    assert all(n == len(t) for _, t, n in got)
    assert html.extract(df.limit(0), ["page_id"]).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(ready, docs, empty):
    columns = docs.columns
    rows, before = docs, docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        rows = ready.createDataFrame(stage(ready, rows, "unused").collect(), None if name == "best-fit packing" else docs.schema)
        seen.append((name, rows.count()))
        if name != "best-fit packing":
            assert rows.columns == columns
        if name == "language ID":
            gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows.collect()}
            assert gone == {4, 5, 6, 7, 18}
        if name == "n-gram Jaccard join":
            kept = {r.doc_id for r in rows.collect()}
            assert not kept & {1, 2, 3, 19} and {0, 10, 11, 12, None} <= kept
        if name == "substring dedup":
            by_id = {r.doc_id: r for r in rows.collect()}
            assert len(by_id[12].text.split()) == 0 and by_id[10].text == docs.where("doc_id = 10").first().text
            assert all(r.n_chars == len(r.text) for r in by_id.values() if r.doc_id not in (None, 3))
        if name == "PII":
            t = {r.doc_id: r.text for r in rows.collect()}[17]
            assert "a.b@c.de" not in t and "[EMAIL]" in t and "[CARD]" in t
    assert before >= seen[0][1] >= seen[1][1] == seen[2][1] == seen[3][1]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(ready, empty, "unused").count() == 0, name


def test_pipeline_sends_each_text_once(ready, docs):
    own = corpus_pipeline._shielded(docs)
    assert sorted(map(str.lower, own.columns[:2])) == ["doc_id", "text"] and len(own.columns) == len(docs.columns)
    model = langid.train(docs, F.lit(True))
    plan = langid.predict(own, model, own.columns)._jdf.queryExecution().optimizedPlan()
    sent = plan.children().head().output()
    assert sent.size() == len(own.columns)
    a, b = (sorted(map(str, langid.predict(own, model, keep).select("doc_id", "lang_pred", "score").collect())) for keep in (own.columns, ["doc_id"]))
    assert a == b

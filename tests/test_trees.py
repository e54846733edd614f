"""Page trees and cards against trees that the pages were made from."""

import random
from html import escape

from pyspark.sql import functions as F

from plaza.sources import trees as T


def grown(draw, depth=0):
    """A random element: [tag, attributes, children, closed]; a child is an element or a text."""
    tag = draw.choice(["div", "article", "p", "h2", "a", "time", "section", "br"])
    attributes = {"href": draw.choice(["/x", "y", ""])} if tag == "a" else {"class": draw.choice(["card", "card wide", "other"])} if tag in ("div", "article") else {}
    children = [] if tag == "br" else [draw.choice([f" t{draw.randint(0, 9)} ", "a & b"]) if depth > 3 or draw.random() < 0.5 else grown(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return [tag, attributes, children]


def html(node):
    if isinstance(node, str):
        return escape(node)
    tag, attributes, children = node
    said = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f"<{tag}{said}>" + ("" if tag == "br" else "".join(map(html, children)) + f"</{tag}>")


def text(node):
    return node if isinstance(node, str) else "".join(map(text, node[2]))


def flat(node):
    yield node
    if not isinstance(node, str):
        for child in node[2]:
            yield from flat(child)


def outermost(node, test):
    """Elements that pass, none inside another."""
    if isinstance(node, str):
        return []
    return [node] if test(node) else [x for child in node[2] for x in outermost(child, test)]


def is_card(node):
    return "card" in node[1].get("class", "").split()


def test_nodes_and_cards_of_random_trees(spark):
    draw = random.Random(5)
    roots = [["body", {}, [grown(draw) for _ in range(5)]] for _ in range(40)]
    pages = spark.createDataFrame([(k, html(r)) for k, r in enumerate(roots)], "page long, html string")
    nodes = T.page_nodes(pages, "page").cache()
    for k, root in enumerate(roots):
        got = sorted((r for r in nodes.where(f"page = {k}").collect()), key=lambda r: r.enter)
        want = [x for x in flat(root)]
        elements = [r for r in got if r.tag != "#text"]
        assert [r.tag for r in elements] == [x[0] for x in want if not isinstance(x, str)] and all(r.closed for r in got)
        for r, x in zip(elements, [x for x in want if not isinstance(x, str)]):
            inner = [g for g in got if r.enter < g.enter < r.leave]
            assert "".join(g.text for g in inner if g.tag == "#text") == text(x) and r.attributes == x[1]
            assert sum(g.tag != "#text" for g in inner) == sum(not isinstance(y, str) for y in flat(x)) - 1
    tests = {"heading": F.col("tag") == "h2", "link": F.col("tag") == "a", "date": F.col("tag") == "time"}
    found = T.cards(nodes, "page", T.has_class("card"), tests).collect()
    clean = lambda s: " ".join(s.split())
    got = {}
    for r in found:
        got.setdefault(r.page, []).append((r.card, *[[(x.text, dict(x.attributes)) for x in r[f]] for f in tests]))
    for k, root in enumerate(roots):
        want = [tuple([(clean(text(x)), x[1]) for x in outermost(["", {}, c[2]], lambda n, t=t: n[0] == t)] for t in ("h2", "a", "time")) for c in outermost(root, is_card)]
        assert [x[1:] for x in sorted(got.get(k, []), key=lambda x: x[0])] == want


def test_unclosed_and_awkward_pages(spark):
    pages = [
        (1, "<div class=card><h2>A</h2><div class='card'><h2>cut"), (2, None), (3, ""), (4, "<script>var a = '<div>';</script><p>x</p></p></b>"), (5, "<ul><li>one<li>two</ul>"), (6, "plain"),
        (7, "<article><h2>T</h2><a href='/e'>go</a><time datetime='2024-01-05'>Fri</time></article><h2>next</h2><article><time>2024-02-01</time><h2>U</h2><a href=e2>go</a></article>"),
    ]
    df = spark.createDataFrame(pages, "enter long, html string")  # a key named as a column of nodes would be: renamed before
    nodes = T.page_nodes(df.withColumnRenamed("enter", "page"), "page")
    got = {}
    for r in nodes.collect():
        got.setdefault(r.page, []).append((r.enter, r.tag, r.closed))
    assert 2 not in got and 3 not in got and [x[1:] for x in sorted(got[6])] == [("#text", True)]
    assert [x[1:] for x in sorted(got[4])] == [("script", True), ("p", True), ("#text", True)]
    assert [x[1:] for x in sorted(got[5])] == [("ul", True), ("li", False), ("#text", True), ("li", False), ("#text", True)]
    tests = {"heading": F.col("tag") == "h2", "link": F.col("tag") == "a", "date": F.col("tag") == "time"}
    assert T.cards(nodes, "page", T.has_class("card"), tests).isEmpty()  # neither card of page 1 is closed
    events = T.card_events(T.cards(nodes, "page", F.col("tag") == "article", tests), "page", F.lit("https://a.example/b/c"))
    assert sorted(map(tuple, events.select("title", "url", "start", "rejection").collect())) == [("T", "https://a.example/e", "2024-01-05", None), ("U", "https://a.example/b/e2", "2024-02-01", None)]


def test_rejections_are_counted(spark):
    card = lambda *inside: f"<article>{''.join(inside)}</article>"
    head, link, date = "<h2>T</h2>", "<a href='/e'>x</a>", "<time>2024-01-01</time>"
    page = card(head, link, date) + card(link, date) + card(head, "<h2>V</h2>", link, date) + card(head, date) + card(head, link, "<a href='/f'>y</a>", date) + card(head, link) + card(head, link, date, "<time>2025-01-01</time>") + card(head, "<a href='mailto:a@b'>m</a>", date)
    nodes = T.page_nodes(spark.createDataFrame([(1, page)], "page long, html string"), "page")
    tests = {"heading": F.col("tag") == "h2", "link": F.col("tag") == "a", "date": F.col("tag") == "time"}
    events = T.card_events(T.cards(nodes, "page", F.col("tag") == "article", tests), "page", F.lit("https://a.example"))
    assert {r.rejection: r.n for r in T.rejections(events, "page").collect()} == {"no_heading": 1, "several_headings": 1, "no_link": 2, "several_links": 1, "no_date": 1, "several_dates": 1}


def test_tables_become_records(spark):
    page = """<table><tr><th>Name</th><th>Town</th></tr><tr><td> A  B </td><td><b>Hali</b>fax</td></tr><tr><td>short</td></tr></table><table><tr><td>x</td><td>x</td></tr><tr><td>1</td><td>2</td></tr></table>
    <table><tr><th>Only</th></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table><table><tr><th>open</th></tr><tr><td>lost"""
    nodes = T.page_nodes(spark.createDataFrame([(1, page), (2, None)], "page long, html string"), "page")
    got = [(r.row, r.record, r.rejection) for r in sorted(T.table_records(nodes, "page").collect(), key=lambda r: (r.table, r.row))]
    assert got == [(1, {"Name": "A B", "Town": "Halifax"}, None), (2, None, "cells_differ"), (1, None, "heads_unclear"), (1, {"Only": "in"}, None)]


def test_directories(spark):
    page = "<ul><li><a href='/a'>A</a></li><li><a href='/b'><img></a><a href='/b'>B</a></li><li>none</li><li><a href='/c'>C</a><a href='/d'>D</a></li><li><a href='#top'>up</a></li></ul>"
    nodes = T.page_nodes(spark.createDataFrame([(1, page)], "page long, html string"), "page")
    got = [(r.name, r.url, r.rejection) for r in T.directory(nodes, "page", F.col("tag") == "li", F.lit("https://x.example/m/")).orderBy("card").collect()]
    assert got == [("A", "https://x.example/a", None), ("B", "https://x.example/b", None), (None, None, "no_link"), (None, None, "several_links"), (None, None, "no_link")]

"""Stop rules of crawls by brute force, and link reports with planted faults."""

import datetime as dt
import random

import pytest

from plaza.sources import crawl


def stops(pages, most, empty):
    """The rules page by page, as a crawler meets them."""
    out, going, seen, prints = {}, {}, {}, {}
    for c, page, links in sorted(pages, key=lambda x: x[:2]):
        links = links or []
        new = set(links) - seen.setdefault(c, set())
        before = out.get((c, page - 1))
        if not links:
            verdict = ("no_links" if empty == 1 else "two_empty" if before and before[0] == 0 else "page_limit" if page >= most else "go_on")
        elif links in prints.setdefault(c, []):
            verdict = "repeated"
        elif page > 1 and not new:
            verdict = "no_new_links"
        else:
            verdict = "page_limit" if page >= most else "go_on"
        seen[c] |= new
        prints.setdefault(c, []).append(links)
        out[c, page] = (len(links), len(new), verdict, going.get(c, True))
        going[c] = going.get(c, True) and verdict == "go_on"
    return out


@pytest.mark.parametrize("empty", [1, 2])
def test_stops_by_brute_force(spark, empty):
    draw = random.Random(empty)
    pages = [(f"c{c}", p, draw.choice([None, [], *[[f"l{draw.randrange(4 * p)}" for _ in range(draw.randrange(1, 4))] for _ in range(5)]])) for c in range(40) for p in range(1, 1 + draw.randrange(1, 12))]
    got = crawl.crawl_stops(spark.createDataFrame(pages, "crawl string, page int, links array<string>"), 8, empty)
    assert {(r.crawl, r.page): (r.n_links, r.new_links, r.verdict, r.read) for r in got.collect()} == stops(pages, 8, empty)


def test_stops_of_odd_rows(spark):
    pages = spark.createDataFrame([(None, 1, ["a"], "x"), ("c", None, ["a"], "y"), ("d", 1, ["a"], "z"), ("d", 1, ["a"], "z")], "crawl string, page int, links array<string>, verdict string")
    got = sorted((str(r.crawl), str(r.page), r.new_links, r.verdict, r.read) for r in crawl.crawl_stops(pages).collect())
    assert [g for g in got if g[0] == "d"] == [("d", "1", 1, "go_on", True)] * 2
    assert [g[3:] for g in got if g[0] != "d"] and all(g[3:] == ("unnumbered", False) for g in got if "None" in g[:2])
    assert crawl.crawl_stops(pages.limit(0)).count() == 0


RESULT = "url string, state string, attempted boolean, attempt int, attempted_at timestamp, assessed_at timestamp, observed_at timestamp, status int, final_url string, confirmed_broken boolean"
RECEIPT = "url string, seq int, attempt int, request_id string, request_url string, status int, redirect_url string, attempted_at timestamp, observed_at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 16, 12, minute)


def report(spark, results, receipts, urls, holds=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((results, RESULT), (receipts, RECEIPT), ([(u,) for u in urls], "url string"), (holds, "scope string, value string"))]
    return {r.url: r.problems for r in crawl.report_problems(*frames).collect()}


def asked(url, seq, status, attempt=1, to=None, of=None, minute=None, request=None):
    minute = seq if minute is None else minute
    return (of or url, seq, attempt, request or f"{abs(hash((of or url, seq)))}", url, status, to, at(minute), at(minute))


def result(url, state, status=None, final=None, attempt=1, seen=None, broken=False):
    made = attempt > 0
    return (url, state, made, attempt, at(0) if made else None, at(30), at(seen) if seen is not None else None, status, final, broken)


def test_right_reports_have_no_problems(spark):
    a, b, c, d, e = (f"https://{x}.example/" for x in "abcde")
    results = [
        result(a, "ok", 200, a + "en", seen=2), result(b, "broken", 410, b, 2, seen=2, broken=True), result(c, "held", attempt=0),
        result(d, "transient"), result(e, "transient", 429, e, seen=1),
    ]
    receipts = [asked(a, 1, 302, to=a + "en"), asked(a + "en", 2, 200, of=a), asked(b, 1, 404), asked(b, 2, 410, 2), asked(e, 1, 429)]
    assert report(spark, results, receipts, [a, b, c, d, e], [("host", "c.example")]) == {u: [] for u in (a, b, c, d, e)}


def test_faults_of_reports(spark):
    urls = [f"https://u{k}.example/" for k in range(14)]
    u = urls
    results = [
        result(u[0], "ok", 200, u[0], seen=2), result(u[1], "ok", 404, u[1], seen=1), result(u[2], "broken", 404, u[2], seen=1, broken=True),
        result(u[3], "ok", 200, u[3], seen=5), result(u[4], "ok", attempt=0), result(u[5], "ok", 200, u[5], seen=1), result(u[6], "ok", 200, u[6], seen=1),
        result(u[7], "ok", 200, "https://other.example/", seen=2), result(u[8], "ok", 200, u[8], 2, seen=2), result(u[9], "ok", 200, u[9], seen=1), result(u[9], "ok", 200, u[9], seen=1),
        result(u[10], "ok", 200, u[10], seen=1), result(u[11], "transient", 301, u[11], seen=1), result("https://new.example/", "transient"),
    ]
    receipts = [
        asked(u[0], 1, 200), asked(u[0], 2, 200), asked(u[1], 1, 404), asked(u[2], 1, 404), *[asked(u[3], k, 301 if k < 5 else 200, to=u[3]) for k in range(1, 6)],
        asked(u[4], 1, 200), asked(u[5], 1, 200, request="7"), asked(u[6], 1, 200, request="7"), asked(u[7], 1, 302, to="https://other.example/"), asked("https://other.example/", 2, 200, of=u[7]),
        asked(u[8], 1, 500), asked(u[8], 2, 200, 2), asked(u[9], 1, 200), asked(u[10], 1, 200, minute=1), asked(u[11], 1, 301, to=u[11]),
    ]
    got = report(spark, results, receipts, urls[:13], [("url", u[10])])
    want = {
        0: ["broken_chain"], 1: ["wrong_state"], 2: ["unconfirmed_broken"], 3: ["too_many_hops"], 4: ["beyond_attempts", "clock", "invented_request", "invented_result", "no_basis"],
        5: ["repeated_request"], 6: ["repeated_request"], 7: ["other_host"], 8: ["broken_chain", "unfounded_retry"], 9: ["repeated_result"], 10: ["held_requested", "hold_ignored"],
        11: ["not_last_response", "wrong_state"], 12: ["not_covered"],
    }
    assert got == {u[k]: v for k, v in want.items()} | {"https://new.example/": ["unexpected"]}


def test_empty_reports(spark):
    assert report(spark, [], [], []) == {}
    assert report(spark, [], [], ["https://a.example/", None]) == {"https://a.example/": ["not_covered"]}

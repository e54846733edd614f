"""Resolvers against brute force over random names."""

import random

import pytest

from plaza.operators import resolve as R


def names(draw, n):
    base = ["".join(draw.choice("abc") for _ in range(draw.randint(4, 9))) for _ in range(n // 3)]
    grown = ["".join((draw.choice("abc") * draw.randint(0, 2), draw.choice(base), draw.choice("abc") * draw.randint(0, 2))) for _ in range(n - len(base))]
    return base + grown + ["aaaaa", "aaaaaa", "", None, "é" * 5, "xé" + "é" * 5]


def touch(a, b, ratio=None):
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    return len(short) >= 5 and (short in long) and (not ratio or 100 * len(short) >= round(100 * ratio) * len(long))


@pytest.mark.parametrize("ratio", [None, 0.65, 0.8, 1.0])
def test_containment(spark, ratio):
    draw = random.Random(3)
    a, b = names(draw, 90), names(draw, 90)
    df = lambda values, c: spark.createDataFrame([(x,) for x in values * 2], f"{c} string")
    got = {(r.a, r.b) for r in R.either_contains(df(a, "a"), df(b, "b"), ratio=ratio).collect()}
    assert got == {(x, y) for x in a for y in b if touch(x, y, ratio)} and got
    assert R.either_contains(df([], "a"), df(b, "b")).isEmpty()


def test_containment_within(spark):
    draw = random.Random(4)
    a, b = ([(draw.choice("uvw"), x) for x in names(draw, 60)] for _ in range(2))
    got = R.either_contains(spark.createDataFrame(a, "host string, a string"), spark.createDataFrame(b, "host string, b string"), ("host",)).collect()
    assert {tuple(r) for r in got} == {(h, x, y) for h, x in a for k, y in b if h == k and touch(x, y)} and len({tuple(r) for r in got}) == len(got)


def by_hand(lead, places):
    i, name, street, host = lead
    exact = [p for p in places if name and p[1] == name]
    if len({p[0] for p in exact}) == 1:
        return i, exact[0][0], "exact_name", "high", None
    at = [p for p in places if street and p[2] == street]
    if len({p[0] for p in at}) == 1:
        return i, at[0][0], "street_address", "high", None
    refs = [p for p in places for h in p[3] or () if host and h == host]
    if len(refs) == 1:
        return i, refs[0][0], "unique_website_host", "high", None
    ids = {p[0] for p in refs if touch(name, p[1])}
    if len(ids) == 1:
        return i, ids.pop(), "website_host_name", "probable", None
    near = {p[0] for p in places if touch(name, p[1], 0.65)}
    if len(near) == 1:
        return i, near.pop(), "fuzzy_name", "probable", None
    several = len(near) > 1 or len({p[0] for p in exact}) > 1 or len({p[0] for p in at}) > 1
    first = lambda rows: sorted(set(rows))[:12]
    shown = list(dict.fromkeys([*first(p[0] for p in exact), *first(p[0] for p in at), *first(near)]))[:12]
    return i, None, "conflict" if several else "unresolved", "needs_review", shown


def test_leads(spark):
    draw = random.Random(8)
    pool = [x for x in names(draw, 120)]
    hosts = [f"h{k}" for k in range(25)] + ["", None]
    places = [(k, draw.choice(pool), draw.choice([f"{draw.randint(1, 90)} s", "", None]), draw.choice([None, [], [draw.choice(hosts)], [draw.choice(hosts), draw.choice(hosts)]])) for k in range(80)]
    places += [(200 + k, "sharedname", "9 hot", ["hot"]) for k in range(30)]  # a hot name, street and host
    leads = [(k, draw.choice([*pool, "sharednames"]), draw.choice([f"{draw.randint(1, 90)} s", "9 hot", None]), draw.choice([*hosts, "hot"])) for k in range(300)]
    got = R.resolve_leads(spark.createDataFrame(leads, "lead long, name string, street string, host string"), spark.createDataFrame(places, "place long, name string, street string, hosts array<string>"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((by_hand(x, places) for x in leads), key=str)
    assert {r.method for r in got.collect()} >= {"exact_name", "street_address", "unique_website_host", "website_host_name", "fuzzy_name", "conflict", "unresolved"}


def test_events(spark):
    draw = random.Random(2)
    tokens = ["sym", "symphony", "port", "harbour", "art", "library", "ar", "cent re"]
    organizers = [(k, [f"s{draw.randint(0, 20)}"], draw.sample(tokens, 2)) for k in range(8)]
    venues = [(k, [f"s{draw.randint(0, 20)}"] if k % 2 else None, [f"hall{draw.randint(0, 9)}", ""]) for k in range(10)]
    events = [(k, draw.choice([f"s{draw.randint(0, 40)}", "", None]), draw.choice([f"hall{draw.randint(0, 15)}", "", None]), draw.choice([None, "", " ".join(draw.choice(["Symphonyx", "ART", "airport", "a", "Cent Re", "night"]) for _ in range(3))])) for k in range(200)]

    def want(e):
        i, source, hall, title = e
        direct = [v for v, s, _ in venues if source and source in (s or ())]
        called = [v for v, _, n in venues if hall and hall in n]
        venue = (max(direct), "source_id") if direct else (max(called), "exact_normalized_venue_name") if called else (None, None)
        runs = [o for o, s, _ in organizers if source and source in s]
        said = {o for o, _, t in organizers if any(len(x) >= 3 and x in (title or "").lower() for x in t)}
        run = (max(runs), "source_id") if runs else (said.pop(), "source_name_token") if len(said) == 1 else (None, None)
        return i, *venue, *run

    got = R.resolve_events(
        spark.createDataFrame(events, "event long, source string, venue_name string, title string"), spark.createDataFrame(venues, "venue long, sources array<string>, names array<string>"),
        spark.createDataFrame(organizers, "organizer long, sources array<string>, tokens array<string>"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(want, events))
    assert {r.organizer_basis for r in got.collect()} == {"source_id", "source_name_token", None}

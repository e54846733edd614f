"""Additions in rounds, scores and pairs, access sweeps: against brute force over random rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plaza.operators import evaluation as E
from plaza.operators import reconcile, sets

DAY0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def in_rounds(rows_, additions, steps):
    found, used = {}, set()
    for k, step in enumerate(steps):
        value = lambda r, k=k: r[k]
        left, right = [r for r in rows_ if r[0] not in used], [a for a in additions if a[0] not in found]
        n, m = Counter(map(value, left)), Counter(map(value, right))
        hits = [(a[0], r[0]) for a in right for r in left if value(a) and value(a) == value(r) and n[value(a)] == m[value(a)] == 1]
        for a, r in hits:
            found[a] = (r, step)
            used.add(r)
    return sorted(((a[0], *found.get(a[0], (None, None))) for a in additions), key=str)


def test_assignment_in_rounds(spark):
    for seed in range(4):
        draw = random.Random(seed)
        make = lambda n, p: [(f"{p}{k}" if draw.random() < 0.7 else f"s{k}", draw.choice(["x", "y", "z", "u", "v", "", None]), draw.choice([f"o{draw.randint(0, 9)}", None])) for k in range(n)]  # noqa: E731, B023
        old, new = make(14, "r"), make(12, "a")
        schema = "id string, title string, place string"
        got = sets.assign(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", ["id", "title", "place"])
        assert rows(got) == in_rounds(old, new, ["id", "title", "place"])


def test_additions_merge(spark):
    schema = "id string, title string, place string, city string, observed int, tags array<string>, supersedes array<string>"
    old = [("1", "A", "p1", "old", 5, ["x"], None), ("2", "B", "p2", "old", 9, ["y"], None), ("3", "C", "p3", None, 1, None, None), ("4", "D", "p4", "kept", 1, None, None), ("5", "E", "p5", "gone", 1, None, None), ("6", "T", "p6", "a", 1, None, None), ("7", "T", "p7", "b", 1, None, None)]
    new = [("1", None, "n1", None, 1, ["z", "x"], ["5", "1"]), ("n2", "other", "p2", "new", 3, ["w"], None), ("n3", "C", "q", "new", 1, None, ["4x"]), ("n4", "T", "q4", "c", 1, None, None)]
    got = sets.apply_additions(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", ["id", "title", "place"], "observed", "supersedes", ["tags"])
    found = {r.id: r for r in got.collect()}
    assert sorted(found) == ["1", "4", "6", "7", "n2", "n3", "n4"]
    assert (found["1"].title, found["1"].place, found["1"].city, found["1"].tags) == ("A", "n1", "old", ["z", "x"])
    assert (found["n2"].title, found["n2"].city, found["n2"].tags) == ("B", "old", ["w", "y"])  # the row was observed later
    assert (found["n3"].place, found["n3"].city, found["n4"].city) == ("q", "new", "c")  # a shared title is no match


def forecasts(draw, n, side):
    out = []
    for _ in range(n):
        start = DAY0 + timedelta(hours=draw.randint(0, 60))
        end = start + timedelta(hours=draw.choice([1, 1, 3]))
        out.append((draw.choice("ab"), "t", draw.choice(["C", None]), None, start, end, start - timedelta(hours=draw.choice([1, 2, -9])), float(draw.randint(0, 9)), side))
    return out


CASE = "location string, variable string, unit string, event string, valid_start timestamp_ntz, valid_end timestamp_ntz, issued_at timestamp_ntz"


def test_scores_and_pairs(spark):
    draw = random.Random(7)
    a, b = forecasts(draw, 150, "a"), forecasts(draw, 150, "b")
    truths = []
    for f in draw.sample(a + b, 180):
        early = draw.choice([0, 0, 0, -1])
        truths.append((*f[:6], draw.choice([None, 3.0, 5.0]), f[5] + timedelta(hours=early), f[5] + timedelta(hours=draw.choice([1, 1, 900])), f"r{len(truths)}"))
    scored_at = DAY0 + timedelta(days=9)

    def want(f):
        mine = [t for t in truths if t[:6] == f[:6]]
        if not f[6] < f[5]:
            return None, None, "issued_late"
        if len(mine) > 1:
            return None, None, "truth_ambiguous"
        if not mine or mine[0][6] is None:
            return None, None, "truth_missing"
        t = mine[0]
        if not (t[7] >= f[5] and t[8] >= t[7]):
            return None, None, "truth_early"
        return (None, None, "truth_unavailable") if t[8] > scored_at else (f[7] - t[6], t[9], "scored")

    table = spark.createDataFrame(truths, CASE.replace(", issued_at timestamp_ntz", "") + ", value double, available_at timestamp_ntz, retrieved_at timestamp_ntz, receipt string")
    scored = {}
    for side, own in (("a", a), ("b", b)):
        got = E.score(spark.createDataFrame(own, CASE + ", prediction double, side string"), table, F.lit(scored_at).cast("timestamp_ntz")).cache()
        assert rows(got.select(*E.CASE, "prediction", "error", "receipt", "state")) == sorted(((*f[:8], *want(f)) for f in own), key=str)
        scored[side] = got.where("state = 'scored'")
    pairs = E.pair(scored["a"], scored["b"])
    of = {s: Counter(tuple(r[c] for c in E.CASE) for r in scored[s].collect()) for s in "ab"}
    states = Counter("duplicate" if max(of["a"][c], of["b"][c]) > 1 else "unpaired_challenger" if not of["b"][c] else "unpaired_baseline" if not of["a"][c] else "paired" for c in {*of["a"], *of["b"]})
    assert Counter(r.state for r in pairs.collect()) == states and states["paired"] and states["duplicate"]
    report = E.paired_report(pairs).first()
    assert (report.paired, report.unpaired_challenger, report.unpaired_baseline, report.duplicate) == tuple(states[s] for s in ("paired", "unpaired_challenger", "unpaired_baseline", "duplicate"))


def test_learning_without_leaks(spark):
    draw = random.Random(11)
    hour = timedelta(hours=1)
    scores = []
    for k in range(120):
        start = DAY0 + draw.randint(0, 90) * hour
        issued = start - draw.choice([6, 6, 12]) * hour
        seen = start + hour + draw.randint(0, 3) * hour
        scores.append((k if k % 40 else 0, draw.choice("ab"), "t", "C", None, start, start + hour, issued, "alg", "r", "l", draw.choice(["v", "w"]), draw.random() < 0.9, seen, seen + draw.choice([0, 1]) * hour, seen + 2 * hour))
    issue_at = DAY0 + 60 * hour
    issues = [("i1", issue_at, 6, "a", "t", "C", None, DAY0 + 20 * hour, DAY0 + 21 * hour, "alg", "r", "l", "v"), ("i2", issue_at + 9 * hour, 12, "b", "t", "C", None, DAY0 + 80 * hour, DAY0 + 81 * hour, "alg", "r", "l", "w")]
    scope = "algorithm string, registry string, locations string, versions string"
    got = E.eligible(
        spark.createDataFrame(scores, f"score int, {CASE}, {scope}, versions_known boolean, available_at timestamp_ntz, retrieved_at timestamp_ntz, scored_at timestamp_ntz"),
        spark.createDataFrame(issues, "issue string, issued_at timestamp_ntz, lead_hours int, " + CASE.replace(", issued_at timestamp_ntz", "") + f", {scope}"), "issue",
    )
    ids, cases = Counter(s[0] for s in scores), Counter(s[1:8] for s in scores)
    want = [
        (i[0], s[0]) for i in issues for s in scores
        if ids[s[0]] == cases[s[1:8]] == 1 and s[12] and s[8:12] == i[9:13] and s[1:5] == i[3:7] and max(s[13], s[14], s[15], s[6]) < i[1] and s[5] != i[7] and s[6] != i[8] and (s[5] - s[7]) == i[2] * hour
    ]
    assert rows(got) == sorted(want, key=str) and {w[0] for w in want} == {"i1", "i2"}


def test_access_sweep(spark):
    draw = random.Random(3)
    requests = []
    for k in range(200):
        start = DAY0 + timedelta(minutes=draw.randint(0, 60)) if k % 50 else None
        end = start and (start + timedelta(minutes=draw.randint(1, 15)) if draw.random() < 0.93 else None)
        requests.append((k, draw.choice("abcd"), start, end, (draw.choice([200] * 12 + [429]) if end else None)))
    requests = [r if r[1] != "d" or r[4] != 429 else (*r[:4], 200) for r in requests]  # one host is never suspended
    got = reconcile.access_sweep(spark.createDataFrame(requests, "id int, host string, started timestamp_ntz, ended timestamp_ntz, code int"), "host", "started", "ended", "code").collect()
    for host in "abcd":
        own = [r for r in requests if r[1] == host]
        stop = min((r[3] for r in own if r[4] == 429), default=None)
        flying = [r for r in own if stop and r[2] and r[2] < stop and (r[3] is None or r[3] >= stop)]
        drained = None if not stop or any(r[3] is None for r in flying) else max(r[3] for r in flying)
        for g in (g for g in got if g.host == host):
            r = requests[g.id]
            if r[2] is None:
                state = "unknown"
            elif not stop:
                state = "settled" if r[3] else "unsettled"
            elif r[2] >= stop:
                state = "refused"
            elif r[3] is None:
                state = "unsettled"
            else:
                state = "settled" if r[3] < stop else "denied" if r[3] == stop and r[4] == 429 else "late"
            assert (g.suspended_at, g.state, g.in_flight, g.drained_at) == (stop, state, len(flying) if stop else None, drained)
        assert sorted(g.number for g in got if g.host == host) == [*range(1, len(own) + 1)]
    assert {g.state for g in got} == {"unknown", "settled", "unsettled", "refused", "denied", "late"}

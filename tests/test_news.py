"""Registries of news sources and accepted items with planted faults."""

import hashlib

from plaza.operators import news

SOURCE = "source_id string, name string, kind string, hosts array<string>, enabled boolean, status string, home_url string, feed_url string, reviewed_at string, evidence map<string,string>"
ITEM = "id string, url string, source_id string, source_name string, kind string, guid string, title string, region string, region_evidence string, topics array<string>, published_at string, precision string, modified_at string, observed_at string, reviewed_at string, correction string, summary string, summary_kind string, reviewer string, rights_basis string"
names = lambda schema: [c.split(" ")[0] for c in schema.split(", ")]


def source(**other):
    own = dict(source_id="s", name="City", kind="newsroom", hosts=["a.example"], enabled=True, status="admitted", home_url="https://a.example/", feed_url="https://a.example/feed", reviewed_at="2024-01-01T00:00:00.000Z", evidence=dict.fromkeys(("access", "schema", "date", "rights"), "seen"))
    return own | other


def item(n=0, **other):
    url = other.get("url", f"https://a.example/{n}")
    own = dict(id="news-" + hashlib.sha256(str(url).encode()).hexdigest()[:24], url=url, source_id="s", source_name="City", kind="newsroom", guid="g", title="Bridge opens", region="North", region_evidence="named", topics=["roads"], published_at="2024-01-02T00:00:00.000Z", precision="instant", modified_at=None, observed_at="2024-01-03T00:00:00.000Z", reviewed_at="2024-01-04T00:00:00.000Z", correction="none", summary=None, summary_kind="none", reviewer="r", rights_basis="stated")
    return own | other


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in names(schema)) for r in rows], schema)


def test_registry(spark):
    faults = {
        "ok": ({}, []), "proposed": ({"status": "proposed", "enabled": False, "feed_url": None, "evidence": None}, []), "a": ({"name": " City"}, ["text"]), "b": ({"kind": "blog"}, ["kind"]),
        "c": ({"hosts": ["A.example"]}, ["hosts", "url"]), "d": ({"hosts": None}, ["hosts", "url"]), "e": ({"status": None}, ["status", "not_admitted"]), "f": ({"feed_url": "https://b.example/feed"}, ["url"]),
        "g": ({"feed_url": None}, ["not_admitted"]), "h": ({"evidence": {"access": "seen"}}, ["evidence"]), "i": ({"reviewed_at": "2024-02-31T00:00:00.000Z"}, ["evidence"]), "j": ({"home_url": "http://a.example/"}, ["url"]),
    }
    rows = [source(**change, source_id=k) for k, (change, _) in faults.items()] + [source(source_id="twice")] * 2
    got = {r.source_id: r.problems for r in news.registry_problems(frame(spark, rows, SOURCE)).collect()}
    assert got == {k: want for k, (_, want) in faults.items()} | {"twice": ["repeated_id"]}


def test_items(spark):
    faults = [
        ({}, []), ({"precision": "day", "published_at": "2024-01-02"}, []), ({"modified_at": "2024-01-02T12:00:00.000Z", "correction": "corrected"}, []), ({"summary": "Told anew.", "summary_kind": "reviewed_original"}, []),
        ({"source_id": "t"}, ["unknown_source"]), ({"source_id": None}, ["unknown_source"]), ({"source_name": "Town"}, ["source_differs"]), ({"url": "https://b.example/x"}, ["url"]), ({"title": "<b>"}, ["text"]), ({"title": "x" * 301}, ["text"]),
        ({"title": None}, ["text"]), ({"topics": ["t"] * 9}, ["topics"]), ({"topics": None}, ["topics"]), ({"topics": []}, []), ({"observed_at": "2024-01-03"}, ["dates"]), ({"modified_at": "soon"}, ["dates"]),
        ({"observed_at": "2024-01-01T00:00:00.000Z"}, ["clock_order"]), ({"reviewed_at": "2024-01-02T12:00:00.000Z"}, ["clock_order"]), ({"modified_at": "2024-01-03T12:00:00.000Z"}, ["clock_order"]),
        ({"correction": "perhaps"}, ["correction"]), ({"summary": "Told.", "summary_kind": "none"}, ["summary"]), ({"summary_kind": "reviewed_original"}, ["summary"]), ({"url": "https://a.example/21?utm_source=x"}, ["url"]),
    ]
    rows = [item(k, **change) for k, (change, _) in enumerate(faults)]
    want = {r["id"]: w for r, (_, w) in zip(rows, faults)}
    same = item(100)
    rows += [same, same, item(101, url="https://a.example/t"), item(102, url="https://a.example/t", id="news-other")]
    got = sorted((r.id, r.problems) for r in news.item_problems(frame(spark, rows, ITEM), frame(spark, [source(), source(source_id="t", status="proposed")], SOURCE)).collect())
    assert {k: v for k, v in got if k in want} == want
    assert [v for k, v in got if k == same["id"]] == [["repeated_id", "repeated_url"]] * 2
    assert sorted(v for k, v in got if k in (rows[-1]["id"], rows[-2]["id"])) == [["repeated_url"], ["repeated_url", "url"]]


def test_empty(spark):
    assert news.item_problems(frame(spark, [], ITEM), frame(spark, [], SOURCE)).count() == 0
    assert news.registry_problems(frame(spark, [], SOURCE)).count() == 0

"""Forecast bodies: whole ones give an hour a row, others their problems."""

import copy
import datetime as dt
import json

from plaza.sources import geojson

SCHEMA = "id string, body string, retrieved_at timestamp"
NOW = dt.datetime(2024, 1, 16, 12, 5)


def measured(value, unit):
    return {"units": {"en": unit}, "value": {"en": value}}


def body():
    hours = [
        {"timestamp": f"2024-01-{16 + (13 + k) // 24:02d}T{(13 + k) % 24:02d}:00:00Z", "temperature": measured(k - 10.5, "C"), "lop": measured(k, "%"), "wind": {"speed": measured(20, "km/h")}}
        for k in range(24)
    ]
    group = {"timestamp": {"en": "2024-01-16T12:00:00Z"}, "hourlyForecasts": hours}
    return {"features": [{"id": x, "properties": {"hourlyForecastGroup": copy.deepcopy(group)}} for x in "ab"]}


def spoilt(change):
    """A body both of whose features are changed alike."""
    out = body()
    for feature in out["features"]:
        group = feature["properties"]["hourlyForecastGroup"]
        change(group, group["hourlyForecasts"])
    return json.dumps(out)


def judged(spark, rows):
    out = {}
    for r in geojson.forecast_hours(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r.id, []).append(r)
    return out


def test_whole_body(spark):
    text = spoilt(lambda group, hours: (hours[3].update(temperature=None), hours[4]["lop"]["value"].update(en=None)))
    rows = sorted(judged(spark, [("x", text, NOW)])["x"], key=lambda r: r.hour)
    assert [r.hour for r in rows] == list(range(24)) and all(r.problems == [] for r in rows)
    assert [r.valid_at for r in rows] == [dt.datetime(2024, 1, 16, 13) + dt.timedelta(hours=k) for k in range(24)]
    assert [r.temperature_c for r in rows] == [None if k == 3 else k - 10.5 for k in range(24)]
    assert [r.probability_percent for r in rows] == [None if k == 4 else k for k in range(24)]
    assert {(r.wind_kmh, r.gust_kmh) for r in rows} == {(20.0, None)}


def test_problems(spark):
    one, other, third = body(), body(), body()
    del one["features"][1]
    other["features"][1]["properties"]["hourlyForecastGroup"]["hourlyForecasts"][2]["temperature"]["value"]["en"] = 30
    third["features"].append(copy.deepcopy(third["features"][0]))
    cases = {
        "not_json": "{", "no_body": None, "not_a_list": json.dumps({"features": {"a": body()["features"][0], "b": 1}}), "feature_count": json.dumps(one), "three": json.dumps(third), "diverged": json.dumps(other),
        "hour_count": spoilt(lambda g, h: h.pop()), "no_hours": spoilt(lambda g, h: g.pop("hourlyForecasts")), "bad_clock": spoilt(lambda g, h: h[7].update(timestamp="2024-02-31T00:00:00Z")),
        "hour_gap": spoilt(lambda g, h: h.insert(0, h.pop())), "not_after_issue": spoilt(lambda g, h: g["timestamp"].update(en="2024-01-16T13:00:00Z")), "units": spoilt(lambda g, h: h[1]["wind"]["speed"]["units"].update(en="kn")),
        "no_unit": spoilt(lambda g, h: h[1]["lop"].pop("units")), "out_of_bounds": spoilt(lambda g, h: h[1]["lop"]["value"].update(en=100.5)), "text": spoilt(lambda g, h: h[1]["lop"]["value"].update(en="50")),
        "too_large": json.dumps(body() | {"more": "x" * geojson.MOST_BYTES}),
    }
    got = judged(spark, [(k, v, NOW) for k, v in cases.items()] + [("no_clock", json.dumps(body()), None), ("twice", json.dumps(body()), NOW), ("twice", json.dumps(body()), NOW), (None, json.dumps(body()), NOW)])
    assert all(len(rows) == 1 and rows[0].hour is None for rows in got.values())
    want = {k: [k] for k in cases if k not in ("no_body", "three", "no_hours", "no_unit", "text", "not_a_list")}
    want |= {"no_body": ["not_json"], "three": ["feature_count"], "no_hours": ["hour_count"], "no_unit": ["units"], "text": ["out_of_bounds"], "no_clock": ["no_clock"], "twice": ["feature_count"]}
    want["not_after_issue"] = ["not_after_issue", "issued_later"]
    want["not_a_list"] = ["feature_count", "hour_count"]
    want["twice"] = got["twice"][0].problems  # and what follows from four features
    assert {k: rows[0].problems for k, rows in got.items()} == want
    assert "feature_count" in want["twice"]


def test_empty_table(spark):
    assert judged(spark, []) == {}

"""Faceted searches as values that turn into lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.operators import predicates as P


@dataclass(frozen=True)
class _Query:
    page: int = 1

    @classmethod
    def from_hash(cls, route: str):
        """State of a hash route; what it doesn't name is at its default, what it doesn't know is dropped."""
        given = dict(parse_qsl(route.partition("?")[2], keep_blank_values=False))
        kinds = {f.name: f.type for f in fields(cls)}
        known = {k: v for k, v in given.items() if k in kinds}
        if not known.get("page", "1").isdigit():
            known.pop("page")
        return replace(cls(), **{k: int(v) if kinds[k] == "int" else v for k, v in known.items()})

    def to_hash(self, name: str) -> str:
        """The route of this state; defaults are left out."""
        changed = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}
        return f"#{name}" + ("?" + urlencode(changed) if changed else "")


@dataclass(frozen=True)
class PlaceQuery(_Query):
    q: str = ""
    cuisine: str = "all"
    area: str = "all"
    feature: str = "all"
    sort: str = "recommended"

    size = 12
    orders = {"recommended": ("-score", "name", "id"), "name": ("name", "id"), "neighbourhood": ("area", "name", "id"), "fresh": ("-fresh", "id")}

    def matching(self, places: DataFrame) -> DataFrame:
        """``places`` (id, name, search, cuisines, area, features, score, fresh) that fit."""
        conditions = [P.search("search", self.q), P.facet_any("cuisines", self.cuisine), P.facet("area", self.area), P.facet_any("features", self.feature)]
        return places.where(P.all_of(conditions))

    def run(self, places: DataFrame) -> DataFrame:
        order = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in self.orders[self.sort]]
        return self.matching(places).orderBy(*order).offset((max(self.page, 1) - 1) * self.size).limit(self.size)


@dataclass(frozen=True)
class EventQuery(_Query):
    q: str = ""
    category: str = "all"
    city: str = "all"
    cost: str = "all"
    time: str = "all"
    duration: str = "short"
    window: str = "all"
    sort: str = "soonest"

    size = 24

    def matching(self, events: DataFrame, as_of: str) -> DataFrame:
        """``events`` (id, title, categories, city, cost, time, start, end) that fit and are still on at ``as_of``."""
        today = F.to_date(D.local(D.moment(as_of)))
        conditions = [
            P.still_on("end", as_of), P.search("title", self.q), P.facet_any("categories", self.category), P.facet("city", self.city),
            P.facet("cost", self.cost), P.facet("time", self.time), P.facet(D.duration_kind(D.local_date("start"), D.local_date("end")), self.duration),
        ]
        if self.window != "all":
            conditions.append(D.overlaps(D.local_date("start"), D.local_date("end"), *D.window_bounds(self.window, today)))
        return events.where(P.all_of(conditions))

    def long_running(self, events: DataFrame, as_of: str) -> DataFrame:
        """What runs over a week beside a short search in a date window; else nothing."""
        found = replace(self, duration="long").matching(events, as_of)
        return found if self.window != "all" and self.duration == "short" else found.where(F.lit(False))

    def run(self, events: DataFrame, as_of: str) -> DataFrame:
        """Pages add up: the second shows the first too."""
        now = D.moment(as_of)
        start = F.when(F.col("end") >= now, F.greatest(F.col("start"), now)).otherwise(F.col("start"))
        order = {"soonest": [start.asc_nulls_last(), "id"], "latest": [start.desc_nulls_last(), "id"], "title": ["title", "id"]}[self.sort]
        return self.matching(events, as_of).orderBy(*order).limit(max(self.page, 1) * self.size)


@dataclass(frozen=True)
class NewsQuery(_Query):
    q: str = ""
    month: str = "all"
    region: str = "all"
    topic: str = "all"

    size = 12

    def matching(self, items: DataFrame) -> DataFrame:
        """``items`` (id, title, month, region, topics) that fit."""
        return items.where(P.all_of([P.search("title", self.q), P.facet("month", self.month), P.facet("region", self.region), P.facet_any("topics", self.topic)]))

    def run(self, items: DataFrame) -> DataFrame:
        return self.matching(items).orderBy(F.col("month").desc(), "id").offset((max(self.page, 1) - 1) * self.size).limit(self.size)

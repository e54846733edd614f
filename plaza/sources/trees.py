"""Pages as tables of nodes, and records from their cards.

A page's elements and texts become rows that are numbered in reading order: a node
enters at one number and leaves at another, and what stands inside it has its
numbers between these two. Cards, and the fields inside them, are then found by
intervals alone: outermost cards don't overlap, so the card of a node is the last
one that entered before it, if that has not left yet. One window over a page's
nodes tells this for cards and fields together; no node is joined with another.

Only elements that are closed count: one whose end the page leaves to its parents
could have borrowed what belongs to its neighbour.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = ("script", "style")
NODE = "enter int, leave int, depth int, tag string, attributes map<string,string>, text string, closed boolean"


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__()
        self.at, self.open, self.done = 0, [], []

    def _next(self) -> int:
        self.at += 1
        return self.at

    def _leave(self, closed: bool) -> None:
        enter, depth, tag, attributes = self.open.pop()
        self.done.append((enter, self._next(), depth, tag, attributes, None, closed))

    def handle_starttag(self, tag, attrs):
        self.open.append((self._next(), len(self.open), tag, {k: v or "" for k, v in attrs}))
        if tag in VOID:
            self._leave(True)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(True)

    def handle_endtag(self, tag):
        if any(own[2] == tag for own in self.open):
            while self.open[-1][2] != tag:
                self._leave(False)
            self._leave(True)

    def handle_data(self, data):
        if not self.open or self.open[-1][2] not in OPAQUE:
            at = self._next()
            self.done.append((at, at, len(self.open), "#text", None, data, True))

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self._leave(False)
        return self.done


@F.udtf(returnType=NODE)
class _PageNodes:
    def eval(self, html: str):
        if html is not None:
            parser = _Nodes()
            parser.feed(html)
            yield from parser.finish()


def page_nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, enter, leave, depth, tag (``#text`` for a text), attributes, text, closed of every node of every page; none of a null page.

    Contents of scripts and styles are no texts, comments are nothing. An end tag
    closes the last open element of its name, and leaves those inside it unclosed.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("_html")).alias("p")
    return rows.lateralJoin(_PageNodes(F.col("p._html").outer())).drop("_html").withColumnRenamed("_key", key)


def has_class(name: str) -> Column:
    """Whether a node's class attribute has ``name`` among its names."""
    return F.array_contains(F.split(F.coalesce(F.try_element_at("attributes", F.lit("class")), F.lit("")), r"\s+"), name)


def _cover(nodes: DataFrame, within: list[str], marks: dict[str, Column]) -> DataFrame:
    """``nodes`` with, for each mark, (enter, leave) of the outermost closed element so marked, of those with equal columns ``within``, that a node is in, or is; else null."""
    before = Window.partitionBy(*within).orderBy("enter")
    out = nodes
    for name, test in marks.items():
        own = F.when(F.coalesce(test, F.lit(False)) & F.col("closed") & (F.col("tag") != "#text"), F.struct("enter", "leave"))
        out = out.withColumn(name, own)
        # an element inside an earlier one of its kind is not outermost
        last = F.max(F.col(f"{name}.leave")).over(before.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(name, F.when(F.col("enter") > F.coalesce(last, F.lit(0)), F.col(name)))
        out = out.withColumn(name, F.last(name, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn(name, F.when(F.col("enter") <= F.col(f"{name}.leave"), F.col(name)))
    return out


def cards(nodes: DataFrame, key: str, card: Column, fields: dict[str, Column]) -> DataFrame:
    """key, card (where it enters) and, for each of ``fields``, its elements in the card in reading order: array of (text, attributes).

    ``card`` and ``fields`` are tests of a node. Of nested cards, and of nested
    elements of a field, the outermost counts; a text is that of all that is
    inside, its white space single. A card without an element of a field has an
    empty array there; unclosed cards are not among the rows.
    """
    inside = _cover(nodes, [key], {"_card": card}).where("_card is not null").withColumn("card", F.col("_card.enter"))
    # fields are those of what stands in the card; the rows are dealt by page already
    marked = _cover(inside.where("enter > card"), [key, "card"], {f"_f{k}": test for k, test in enumerate(fields.values())})
    of = [F.when(F.col(f"_f{k}").isNotNull(), F.struct(F.lit(name).alias("field"), F.col(f"_f{k}.enter").alias("at"))) for k, name in enumerate(fields)]
    told = marked.select(key, "card", "enter", "tag", "attributes", "text", F.explode(F.array_compact(F.array(*of))).alias("of"))
    empty = inside.where("enter = card").select(key, "card", *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("enter", "tag", "attributes", "text", "of")])  # a card without fields is a row, too
    told = told.unionByName(empty)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "#text", F.struct("enter", "text")))), lambda x: x["text"]), "")
    clean = F.trim(F.regexp_replace(said, r"[\s ]+", " "))
    # maps can't be compared, so the attributes of the field's own node are taken by its place
    own = F.max_by("attributes", F.when(F.col("enter") == F.col("of.at"), 1).otherwise(0))
    elements = told.groupBy(key, "card", "of").agg(clean.alias("text"), own.alias("attributes"))
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("of.field") == name, F.struct(F.col("of.at").alias("at"), F.col("text").alias("text"), F.map_entries("attributes").alias("attributes"))))), lambda x: F.struct(x["text"].alias("text"), F.map_from_entries(x["attributes"]).alias("attributes")))
    return elements.groupBy(key, "card").agg(*[pick(name).alias(name) for name in fields])


#: Why a card is no event, in the order in which it is asked.
REJECTIONS = ("no_heading", "several_headings", "no_link", "several_links", "no_date", "several_dates")


def card_events(found: DataFrame, key: str, base: Column) -> DataFrame:
    """key, card, title, url, start (the date as the page states it) and rejection (null for an event) of cards with heading, link and date.

    A card is an event if it has one heading with a text, one link to somewhere
    (several to one place are one) and one date; dates are the ``datetime`` of the
    element, or its text. Nothing is filled in: a rejected card has all three null.
    ``base`` is the page's address, for links that are relative to it.
    """
    stated = lambda x: F.coalesce(F.try_element_at(x["attributes"], F.lit("datetime")), x["text"])
    texts = lambda column, of: F.array_distinct(F.filter(F.transform(column, of), lambda x: F.coalesce(x, F.lit("")) != ""))
    heads, dates = texts("heading", lambda x: x["text"]), texts("date", stated)
    links = texts("link", lambda x: absolute(F.try_element_at(x["attributes"], F.lit("href")), base))
    number = lambda values, none, many: [(F.size(values) == 0, none), (F.size(values) > 1, many)]
    tests = [*number(heads, *REJECTIONS[0:2]), *number(links, *REJECTIONS[2:4]), *number(dates, *REJECTIONS[4:6])]
    why = F.coalesce(*[F.when(test, F.lit(name)) for test, name in tests])
    rows = found.withColumn("rejection", why)
    value = lambda values: F.when(F.col("rejection").isNull(), F.try_element_at(values, F.lit(1)))
    return rows.select(key, "card", value(heads).alias("title"), value(links).alias("url"), value(dates).alias("start"), "rejection")


def absolute(href: Column, base: Column) -> Column:
    """A link as an address: http and https as they are, ``//host``, ``/path`` and plain names from ``base``; null for other schemes and fragments."""
    origin, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    clean = F.trim(F.regexp_replace(href, r"#.*$", ""))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(clean == "", None).when(clean.rlike(r"^(?i:https?)://[^/]"), clean).when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(origin == "", None).when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), clean)).when(clean.startswith("/"), F.concat(origin, clean))
        .otherwise(F.concat(folder, clean))
    )


def rejections(events: DataFrame, key: str) -> DataFrame:
    """key, rejection, n: how many cards of each page were rejected for each reason."""
    return events.where("rejection is not null").groupBy(key, "rejection").agg(F.count("*").alias("n"))


def table_records(nodes: DataFrame, key: str) -> DataFrame:
    """key, table, row, record (map from the table's heads to the row's cells) and rejection of the rows of closed tables.

    The first row of a table has its heads; it is no record. ``cells_differ``: the
    row has not as many cells as there are heads; ``heads_unclear``: a head is
    empty or comes twice. A rejected row's record is null. Tables inside tables
    belong to the outer one's cells.
    """
    inside = _cover(nodes, [key], {"_table": F.col("tag") == "table"}).where("_table is not null")
    inside = inside.withColumn("_of", F.struct(F.col(key).alias("page"), F.col("_table.enter").alias("table"))).drop("_table", key)
    rows = cards(inside, "_of", F.col("tag") == "tr", {"cells": F.col("tag").isin("td", "th")})
    own = Window.partitionBy("_of").orderBy("card")
    rows = rows.withColumn("cells", F.transform("cells", lambda c: c["text"])).withColumns({"row": F.row_number().over(own) - 1, "heads": F.first("cells").over(own)}).where("row > 0")
    unclear = F.exists("heads", lambda h: h == "") | (F.size(F.array_distinct("heads")) < F.size("heads"))
    why = F.when(unclear, "heads_unclear").when(F.size("cells") != F.size("heads"), "cells_differ")
    return rows.select(F.col("_of.page").alias(key), "_of.table", "row", F.when(why.isNull(), F.map_from_arrays("heads", "cells")).alias("record"), why.alias("rejection"))


def directory(nodes: DataFrame, key: str, member: Column, base: Column) -> DataFrame:
    """key, card, name, url and rejection of the members of a directory page: elements ``member`` with one link that has a text and leads somewhere.

    ``no_link``: none does; ``several_links``: links lead to several places. Of links to one place the first with a text gives the name.
    """
    rows = cards(nodes, key, member, {"link": F.col("tag") == "a"})
    links = F.transform("link", lambda x: F.struct(x["text"].alias("name"), absolute(F.try_element_at(x["attributes"], F.lit("href")), base).alias("url")))
    links = F.filter(links, lambda x: x["url"].isNotNull() & (x["name"] != ""))
    rows = rows.withColumn("_links", links)
    places = F.size(F.array_distinct(F.transform("_links", lambda x: x["url"])))
    why = F.when(places == 0, "no_link").when(places > 1, "several_links")
    first = lambda field: F.when(why.isNull(), F.try_element_at("_links", F.lit(1))[field])
    return rows.select(key, "card", first("name").alias("name"), first("url").alias("url"), why.alias("rejection"))

"""Resolvers by name: containment through an index of letter q-grams, leads to places in five steps, events to venues and organizers.

Containment is found without comparing all pairs. The longer texts are indexed by
their q-grams; of a shorter text one gram is looked up, the rarest of its own, as
whatever contains the text contains that gram. With a least ratio of lengths, the
lengths that a longer text may have are part of the join's key. What meets is
verified. A text with a gram that no longer text has meets nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = 4


def grams(text: Column, q: Column | int) -> Column:
    """The distinct parts of q code points of a text; none if it is shorter."""
    q = F.lit(q) if isinstance(q, int) else q
    starts = F.when(F.char_length(text) >= q, F.sequence(F.lit(1), F.char_length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, q)))


def contained(short: DataFrame, long: DataFrame, within: tuple[str, ...] = (), least: int = 5, ratio: float | None = None, q: int = Q) -> DataFrame:
    """Distinct pairs (short, long) of texts, of equal columns ``within``, of which ``long`` contains ``short``.

    ``short`` and ``long`` are tables with a column of that name. The shorter text
    has at least ``least`` code points; with a ``ratio`` it has at least that part
    of the longer one's. Equal texts contain each other. Null and empty texts
    contain nothing and are contained in nothing; repeated texts count once.
    """
    if least < 1:
        raise ValueError("the shorter text needs a letter")
    q, by = min(q, least), list(within)
    size = F.char_length("short")
    shorts = short.select(*by, "short").where(size >= least).distinct()
    longs = long.select(*by, "long").where(F.char_length("long") >= least).distinct()
    index = longs.select(*by, F.explode(grams(F.col("long"), q)).alias("gram"), F.char_length("long").alias("length"), "long")
    key = [*by, "gram"]
    if ratio:  # whole hundredths, so that no length at the edge is lost to rounding
        part = round(ratio * 100)
        shorts = shorts.withColumn("lengths", F.sequence(size, F.floor(size * 100 / part).cast("int")))
    asked = shorts.withColumn("gram", F.explode(grams(F.col("short"), q)))
    # one gram of each text: the rarest in the index; a text that has one of none meets nothing
    found = asked.join(index.groupBy(*key).agg(F.count("*").alias("texts")), key, "left")
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0).cast("long")).alias("texts"), "gram")).alias("rarest")
    chosen = found.groupBy(*by, "short", *(["lengths"] if ratio else [])).agg(rarest).where("rarest.texts > 0").withColumn("gram", F.col("rarest.gram"))
    if ratio:
        chosen, key = chosen.withColumn("length", F.explode("lengths")), [*key, "length"]
    return chosen.join(index, key).where(F.contains("long", "short")).select(*by, "short", "long")


def either_contains(a: DataFrame, b: DataFrame, within: tuple[str, ...] = (), least: int = 5, ratio: float | None = None) -> DataFrame:
    """Distinct pairs (a, b) of which one contains the other, the shorter of at least ``least`` code points and ``ratio`` of the longer one's."""
    swap = lambda df, x, y: df.withColumnRenamed(x, y)
    inside = contained(swap(a, "a", "short"), swap(b, "b", "long"), within, least, ratio)
    around = contained(swap(b, "b", "short"), swap(a, "a", "long"), within, least, ratio)
    names = [*within, "a", "b"]
    return inside.withColumnsRenamed({"short": "a", "long": "b"}).select(*names).union(around.withColumnsRenamed({"short": "b", "long": "a"}).select(*names)).distinct()


#: How many places a lead that stays open is shown with.
MOST_REVIEWED = 12


def _by_key(places: DataFrame, key: str) -> DataFrame:
    """Of each key: how many places have it, and the first of them."""
    rows = places.select(key, "place").where(F.col(key) != "").distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    first = rows.withColumn("_n", nth).where(F.col("_n") <= MOST_REVIEWED).groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("first"))
    return rows.groupBy(key).agg(F.count("*").alias("n")).join(first, key)


def resolve_leads(leads: DataFrame, places: DataFrame, ratio: float = 0.65) -> DataFrame:
    """lead, place, method, confidence, candidates of every lead, by the first step that leads to exactly one place.

    ``leads`` has lead, name, street, host; ``places`` has place, name, street,
    hosts (array); names, streets and hosts as keys. exact_name and street_address
    need one place with that key; unique_website_host needs the host to stand once
    among all places' hosts; website_host_name one place of the host, and
    fuzzy_name one of any, whose name contains the lead's or is contained in it
    (five letters at least, and for fuzzy_name ``ratio`` of the longer). A lead
    that none resolves is a conflict if several places share its name or street
    or are near by name, and unresolved otherwise; its candidates are the first
    of them, by name, street and nearness.

    Null and empty keys fit nothing. Rows of ``leads`` stay each; places repeated
    with all their keys count once, but for their hosts. Work is done per distinct
    key, so a name, street or host of many rows on both sides makes no product.
    """
    named, street = _by_key(places.withColumnRenamed("name", "key"), "key"), _by_key(places.withColumnRenamed("street", "key"), "key")
    refs = places.select("place", F.col("name").alias("b"), F.explode("hosts").alias("host")).where("host <> ''")
    once = refs.groupBy("host").agg(F.count("*").alias("n_host"), F.min("place").alias("by_host")).where("n_host = 1")
    asked = leads.select("host", F.col("name").alias("a")).where("host <> '' and a <> ''").distinct()
    # names of one host by their places: of a pair of names, how many places, and one
    of_host = refs.groupBy("host", "b").agg(F.count_distinct("place").alias("n"), F.min("place").alias("place"))
    in_host = either_contains(asked, refs.select("host", "b"), ("host",)).join(of_host, ["host", "b"])
    in_host = in_host.groupBy("host", "a").agg(F.count_distinct("place").alias("n_in_host"), F.max("n").alias("most"), F.min("place").alias("in_host")).where("n_in_host = 1 and most = 1")
    near = either_contains(leads.select(F.col("name").alias("a")), places.select(F.col("name").alias("b")), (), 5, ratio)
    near = near.join(named.withColumnRenamed("key", "b"), "b")
    nth = F.row_number().over(Window.partitionBy("a").orderBy("place"))
    first = near.select("a", F.explode("first").alias("place")).withColumn("_n", nth).where(F.col("_n") <= MOST_REVIEWED).groupBy("a").agg(F.array_sort(F.collect_list("place")).alias("near_first"))
    near = near.groupBy("a").agg(F.sum("n").alias("n_near")).join(first, "a")
    side = lambda rows, key, name: rows.select(F.col("key").alias(key), F.col("n").alias(f"n_{name}"), F.col("first").alias(f"{name}_first"))
    rows = leads.select("lead", "name", "street", "host").join(side(named, "name", "name"), "name", "left").join(side(street, "street", "street"), "street", "left")
    rows = rows.join(once.select("host", "by_host"), "host", "left").join(in_host.withColumnRenamed("a", "name").select("host", "name", "in_host"), ["host", "name"], "left")
    rows = rows.join(near.withColumnRenamed("a", "name"), "name", "left")
    steps = [
        ("exact_name", "high", F.col("n_name") == 1, F.col("name_first")[0]), ("street_address", "high", F.col("n_street") == 1, F.col("street_first")[0]), ("unique_website_host", "high", F.col("by_host").isNotNull(), F.col("by_host")),
        ("website_host_name", "probable", F.col("in_host").isNotNull(), F.col("in_host")), ("fuzzy_name", "probable", F.col("n_near") == 1, F.col("near_first")[0]),
    ]
    choose = lambda value: reduce(lambda c, s: c.when(s[2], value(s)), steps[1:], F.when(steps[0][2], value(steps[0])))
    kind = rows.schema["name_first"].dataType.simpleString()
    some = lambda c: F.coalesce(F.col(c), F.array().cast(kind))
    several = F.coalesce(F.greatest("n_near", "n_name", "n_street"), F.lit(0)) > 1
    place = choose(lambda s: s[3])
    return rows.select(
        "lead", place.alias("place"),
        F.coalesce(choose(lambda s: F.lit(s[0])), F.when(several, "conflict").otherwise("unresolved")).alias("method"),
        F.coalesce(choose(lambda s: F.lit(s[1])), F.lit("needs_review")).alias("confidence"),
        F.when(place.isNull(), F.slice(F.array_distinct(F.concat(some("name_first"), some("street_first"), some("near_first"))), 1, MOST_REVIEWED)).alias("candidates"),
    )


def unique_owner(texts: DataFrame, tokens: DataFrame, owner: str, least: int = 3) -> DataFrame:
    """Of each distinct text that contains a token: (text, owner), where all tokens it contains belong to one owner.

    ``texts`` has text, ``tokens`` has token and the owner's column; tokens of
    fewer than ``least`` code points are not used. Each token stands once in the
    join, with its one owner or the remark that it has several, so an owner's
    number of tokens or a token's number of owners multiplies nothing.
    """
    owned = tokens.where(F.char_length("token") >= least).groupBy("token").agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias(owner))
    met = contained(owned.select(F.col("token").alias("short")), texts.select(F.col("text").alias("long")), (), least).join(owned.withColumnRenamed("token", "short"), "short")
    per = met.groupBy(F.col("long").alias("text")).agg(F.max("owners").alias("owners"), F.min(owner).alias(owner), F.max(owner).alias("_last"))
    return per.where((F.col("owners") == 1) & (F.col(owner) == F.col("_last"))).select("text", owner)


def resolve_events(events: DataFrame, venues: DataFrame, organizers: DataFrame) -> DataFrame:
    """event, venue, venue_basis, organizer, organizer_basis of every row of ``events`` (event, source, venue_name, title).

    ``venues`` has venue, sources (array) and names (array of keys), ``organizers``
    organizer, sources and tokens (arrays). A venue is found by source_id, then by
    exact_normalized_venue_name; an organizer by source_id, then by
    source_name_token, if the title contains tokens of one organizer only. Of
    several owners of a source or name the last one stands. Null and empty keys
    fit nothing; each step's null leaves the row unresolved with a null basis.
    """
    last = lambda rows, column, key, value: rows.select(F.explode(column).alias(key), value).where(F.col(key) != "").groupBy(key).agg(F.max(value).alias(value))
    by_source, by_name = last(venues, "sources", "source", "venue").withColumnRenamed("venue", "v1"), last(venues, "names", "venue_name", "venue").withColumnRenamed("venue", "v2")
    runs = last(organizers, "sources", "source", "organizer").withColumnRenamed("organizer", "o1")
    tokens = organizers.select("organizer", F.explode("tokens").alias("token")).select("organizer", F.lower("token").alias("token"))
    titled = unique_owner(events.select(F.lower("title").alias("text")), tokens, "organizer").withColumnsRenamed({"organizer": "o2", "text": "_text"})
    rows = events.join(by_source, "source", "left").join(by_name, "venue_name", "left").join(runs, "source", "left").withColumn("_text", F.lower("title")).join(titled, "_text", "left")
    basis = lambda a, b, second: F.when(F.col(a).isNotNull(), "source_id").when(F.col(b).isNotNull(), second)
    return rows.select("event", F.coalesce("v1", "v2").alias("venue"), basis("v1", "v2", "exact_normalized_venue_name").alias("venue_basis"), F.coalesce("o1", "o2").alias("organizer"), basis("o1", "o2", "source_name_token").alias("organizer_basis"))

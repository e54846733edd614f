"""Filters and verdicts on single rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.functions import text as S
from plaza.functions.text import either


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def search(text, query: str) -> Column:
    """The query as it is, or both without accents and marks, inside the text; an empty query meets all."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    plain = F.contains(F.lower(either(text)), F.lit(q))
    compact = S.compact_key(F.lit(q))
    return plain | ((compact != "") & F.contains(S.compact_key(text), compact))


def facet(column, wanted: str | None, off: str = "all") -> Column:
    """A scalar facet: equal whatever the case; ``off`` disables it."""
    return F.lit(True) if wanted in (None, off) else F.lower(either(column)) == wanted.lower()


def facet_any(array, wanted: str | None, off: str = "all") -> Column:
    return F.lit(True) if wanted in (None, off) else F.exists(either(array), lambda x: F.lower(x) == wanted.lower())


def still_on(end, as_of, grace_minutes: int = 30) -> Column:
    return either(end) >= D.moment(as_of) - F.expr(f"interval {grace_minutes} minutes")


# What a sports season's title says, and what a single game's does.
SEASON = "(^|[^a-z])(season|schedule|home games)([^a-z]|$)"
GAME = "(^|[^a-z])(vs|versus|game|match)([^a-z]|$)"


def sports_season(title, days: Column) -> Column:
    text = F.lower(either(title))
    return (days > 7) & text.rlike(SEASON) & ~text.rlike(GAME)


def first_action(links) -> Column:
    """The link that leads; if it is rejected none moves up."""
    return F.try_element_at(either(links), F.lit(1))


# The day on which a season ends, at midnight of a zone three hours behind UTC.
SEASON_ENDS = {"spring": (6, 21), "summer": (9, 22), "fall": (12, 21), "autumn": (12, 21), "winter": (3, 21)}


def post_expiry(title, published, expires, days: int = 60) -> Column:
    """Earliest of the look-back's end, a stated end, and the end of the season that the title names first.

    A season before the word garden is the garden's. A winter named from October on ends in the next year.
    Without a date of publication there is none, whatever end is stated.
    """
    at = either(published).cast("timestamp_ntz")
    season = F.regexp_extract(F.lower(either(title)), S.borders(rf"\b({'|'.join(SEASON_ENDS)})\b(?! garden)"), 1)
    ends = F.lit(None).cast("timestamp_ntz")
    for name, (month, day) in SEASON_ENDS.items():
        year = F.year(at) + F.when((F.lit(name) == "winter") & (F.month(at) >= 10), 1).otherwise(0)
        ends = F.when(season == name, F.make_timestamp_ntz(year, F.lit(month), F.lit(day), F.lit(3), F.lit(0), F.lit(0))).otherwise(ends)
    return F.when(at.isNotNull(), F.least(at + F.expr(f"interval {days} days"), either(expires).cast("timestamp_ntz"), ends))


def current_offer(status, source_type, verified, expires, review_due, valid_from, valid_to, as_of, days: int = 30) -> Column:
    now = D.moment(as_of)
    open_end = lambda c: either(c).isNull() | (either(c) >= now)
    return F.coalesce(
        (either(status) == "verified_current") & ~either(source_type).isin("official_website_link", "verified_restaurant_owned_page") & D.is_recent(verified, as_of, days)
        & open_end(expires) & open_end(review_due) & open_end(valid_to) & (either(valid_from).isNull() | (either(valid_from) <= now)),
        F.lit(False),
    )


# States in which a place takes no visitors.
INACTIVE = ("closed", "permanently_closed", "temporarily_closed", "seasonal_closed", "relocated")


def active(status, season_end, as_of, zone: str = D.ZONE) -> Column:
    """Not in an inactive state and, for a season, not past its last local day."""
    today = F.to_date(D.local(D.moment(as_of), zone))
    return ~F.coalesce(either(status), F.lit("")).isin(*INACTIVE) & F.coalesce(either(season_end) >= today, F.lit(True))


def chain_policy(rows: DataFrame, labels: dict[str, str | Column], hosts: dict[str, str | Column], chains: list[str], chain_hosts: list[str]) -> DataFrame:
    """Rows with ``chain``: reason, field, token and value of the first field that names a chain; null if none does.

    ``labels`` (field to column) are read first: the words of a chain open, close
    or are the label, possessives included. Then ``hosts``: the host of the URL is
    a chain's or under it. Both lists are fixed and small, so each is a branch of
    one expression.
    """

    def verdict(reason, field, token, value):
        return F.when(token.isNotNull(), F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field"), token.alias("token"), either(value).alias("value")))

    def by_label(value):
        words = F.concat(F.lit(" "), S.spaced_key(F.regexp_replace(either(value), "['’]s", "")), F.lit(" "))
        return F.coalesce(F.lit(None).cast("string"), *[F.when(F.startswith(words, F.lit(k)) | F.endswith(words, F.lit(k)), F.lit(c)) for c in chains for k in [f" {c} "]])

    def by_host(value):
        host = S.host_key(either(value))
        return F.coalesce(F.lit(None).cast("string"), *[F.when((host == h) | F.endswith(host, F.lit("." + h)), F.lit(h)) for h in chain_hosts])

    found = [verdict("non_local_chain_label", f, by_label(v), v) for f, v in labels.items()]
    found += [verdict("non_local_chain_website", f, by_host(v), v) for f, v in hosts.items()]
    return rows.withColumn("chain", F.coalesce(*found))


def link_state(status) -> Column:
    code = either(status)
    return (
        F.when(code.between(200, 399), "ok").when(code.isin(404, 410), "broken").when(code.isin(401, 403, 429), "restricted").when((code >= 500) | code.isin(408, 425), "transient").otherwise("http_error")
    )


def held(rows: DataFrame, holds: DataFrame, url: str) -> DataFrame:
    """Rows with whether their host (429) or their URL (401, 403) is on hold. Needs scope and value of the holds."""
    hosts = holds.where("scope = 'host'").select(F.col("value").alias("_host"), F.lit(True).alias("_h")).distinct()
    urls = holds.where("scope = 'url'").select(F.col("value").alias(url), F.lit(True).alias("_u")).distinct()
    out = rows.withColumn("_host", S.host_key(url)).join(hosts, "_host", "left").join(urls, url, "left")
    return out.withColumn("held", F.coalesce(F.col("_h") | F.col("_u"), F.col("_h"), F.col("_u"), F.lit(False))).drop("_host", "_h", "_u")


def hold_scope(status) -> Column:
    return F.when(either(status) == 429, "host").when(either(status).isin(401, 403), "url")


def permitted(flags, allowed: tuple[str, ...]) -> Column:
    """Every alias of a permission that is set allows; one that denies outweighs all."""
    known = F.array_compact(either(flags))
    return (F.size(known) > 0) & F.forall(known, lambda x: x.isin(*allowed))


def usable_phone(column) -> Column:
    n = F.length(F.regexp_replace(either(column), "[^0-9]", ""))
    return F.coalesce(n.between(7, 15) & either(column).rlike("^[+0-9][0-9 ().-]*$"), F.lit(False))


def usable_address(column) -> Column:
    return F.coalesce(either(column).rlike("^[0-9]+[A-Za-z]? [A-Za-z]") & (F.length(either(column)) <= 120), F.lit(False))


def disposition(official, mentions) -> Column:
    return F.when(either(official) & either(mentions), "verified").when(either(official) | either(mentions), "needs_review").otherwise("rejected")


def special_status(as_of, source_verified, verified_at, valid_from, valid_to, recurrence, located, identified, days: int = 30) -> Column:
    now = D.moment(as_of)
    return (
        F.when(~F.coalesce(either(located), F.lit(True)) | ~F.coalesce(either(identified), F.lit(True)), "source_lead")
        .when(either(valid_to) < now, "expired")
        .when(either(valid_from) > now, "source_lead")
        .when(either(source_verified) & D.is_recent(verified_at, as_of, days), "verified_current")
        .when(either(source_verified), "stale")
        .when(S.truthy(recurrence).isNotNull(), "likely_recurring_verify")
        .otherwise("source_lead")
    )


# Whole price texts that mean free entry.
FREE = (
    "free", "no charge", "free admission", "admission free", "admission is free", "free entry", "entry free", "entry is free", "free to attend", "free event",
    "no admission fee", "no entry fee", "no charge for admission", "no charge to attend", "complimentary admission", "complimentary entry", "free admission for everyone", "free admission for everybody",
    "$0 admission", "$0.00 admission", "admission $0", "admission $0.00", "admission: $0", "admission: $0.00", "$0 entry", "$0.00 entry", "entry $0", "entry $0.00", "general admission $0", "$0 general admission",
)
# Words by which a clause says what a price is for, and those that may stand between.
ENTRY_WORDS = ("admission", "entry", "ticket", "tickets")
GROUP_WORDS = ("adult", "adults", "non-member", "non-members", "nonmember", "nonmembers", "public")
_TOKEN = r"\$ ?[0-9]+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]+)? ?(?:cad|dollars?)\b|[0-9]+(?:\.[0-9]+)?|[a-z]+(?:-[a-z]+)*|[:—–-]"


def _priced(clause: Column) -> Column:
    """Of each amount in a clause: its value, whether it is for entry or for a group that pays, whether that is denied."""

    def read(tokens):
        at = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))

        def one(i):
            after, then = at(i + 1), at(i + 2)
            linked = F.when(at(i - 1).isin("is", "are", "cost", "costs", "at", ":", "of"), i - 2).otherwise(i - 1)
            named = F.when(at(linked).isin("fee", "price", "cost") & at(linked - 1).isin(*ENTRY_WORDS), linked - 1).otherwise(linked)
            payer = F.when(at(i - 1).isin("pay", "at", ":", "—", "–", "-"), i - 2).otherwise(i - 1)
            entry_before, group_before = at(named).isin(*ENTRY_WORDS), at(payer).isin(*GROUP_WORDS)
            entry = entry_before | after.isin(*ENTRY_WORDS) | ((after == "general") & then.isin(*ENTRY_WORDS))
            group = group_before | ((after == "for") & (then.isin(*GROUP_WORDS[:-1]) | ((then == "the") & (at(i + 3) == "public"))))
            first = F.when(entry_before, F.when(at(named - 1) == "general", named - 1).otherwise(named)).when(group_before, payer).otherwise(i)
            return F.struct(
                F.regexp_extract(at(i), "[0-9]+(?:\\.[0-9]+)?", 0).cast("double").alias("value"), entry.alias("entry"), group.alias("group"),
                ((entry | group) & at(first - 1).isin("no", "not", "without")).alias("denied"),
            )

        amounts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i).rlike("^\\$|[0-9] ?(cad|dollars?)$"))
        return F.when(F.size(tokens) > 0, F.transform(amounts, one))

    return F.element_at(F.transform(F.array(F.regexp_extract_all(clause, F.lit(_TOKEN), 0)), read), 1)


def cost_kind(price) -> Column:
    """free, paid or unknown from what an event says of its price.

    A price counts if it is for entry (``$5 admission``, ``tickets are $5``) or
    for a group that pays (``adults $5``, ``$5 for non-members``). One that is
    denied tells nothing; so does one for entry beside free entry, unless a group
    pays. A text that is an amount alone counts too.
    """
    text = F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(either(price), F.lit("")), "\\s+", " ")), "[.!]+$", "")))
    found = F.filter(F.flatten(F.transform(F.split(text, "[;|,]+"), lambda c: F.coalesce(_priced(c), F.array().cast("array<struct<value:double,entry:boolean,group:boolean,denied:boolean>>")))), lambda x: x["entry"] | x["group"])
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit("[a-z0-9$]+"), 0), " "), F.lit(" "))
    free_entry = F.exists(F.array(*[F.lit(f" {w} ") for w in ("free admission", "free entry", "admission free", "entry free", "admission is free", "entry is free")]), lambda w: F.contains(words, w))
    only = F.regexp_extract(text, "^(?:\\$ ?([0-9]+(?:\\.[0-9]{1,2})?)|([0-9]+(?:\\.[0-9]+)?)(?: ?(?:cad|dollars?))?)$", 0)
    alone = F.regexp_extract(only, "[0-9]+(?:\\.[0-9]+)?", 0).cast("double")

    def verdict(x):
        unsure = free_entry & F.exists(x, lambda p: p["entry"]) & ~F.exists(x, lambda p: p["group"])
        return (
            F.when(text == "", "unknown").when(text.isin(*FREE), "free").when(F.exists(x, lambda p: p["denied"]), "unknown")
            .when(F.exists(x, lambda p: p["value"] > 0), F.when(unsure, "unknown").otherwise("paid"))
            .when(only != "", F.when(alone == 0, "free").otherwise("paid")).otherwise("unknown")
        )

    return F.element_at(F.transform(F.array(found), verdict), 1)

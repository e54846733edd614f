"""String, URL and keyword functions, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def either(column) -> Column:
    """A column given by name or as itself."""
    return F.col(column) if isinstance(column, str) else column


def borders(pattern: str) -> str:
    """``pattern`` with its word borders read as ASCII ones: letters with marks are no part of words, as in most engines but Java's."""
    return pattern.replace(r"\b", "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def holds_any(column, pattern: str) -> Column:
    """Whether a text matches one of the alternatives of ``pattern``, words with at most borders and optional characters in them.

    Words are looked for as they are, which takes a small part of a regular expression's time;
    an alternative that is more than its word is tried only where its first letters are.
    """
    found = F.lit(False)
    for alternative in pattern.split("|"):
        word = re.match(r"(?:\\b)?([\w -]*\w(?![?*+{]))", alternative)
        if not word or re.search(r"[()]", alternative):
            raise ValueError(f"no alternative that begins with letters: {alternative}")
        said = F.contains(either(column), F.lit(word[1]))
        found = found | (said if word[0] == alternative and word[1] == alternative else said & either(column).rlike(borders(alternative)))
    return found


def truthy(column) -> Column:
    """A string, or null where it is blank."""
    text = F.trim(either(column))
    return F.when(text != "", text)


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks up to U+1FFF, and their bare letters, from Unicode decompositions."""
    pairs = [(chr(cp), unicodedata.normalize("NFKD", chr(cp))) for cp in range(0xC0, 0x2000)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all("\u0300" <= c <= "\u036f" for c in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(column) -> Column:
    """Lower case without accents, for keys: letters with marks lose them, also marks that stand apart. ``fold_compatible`` folds all else that NFKD does."""
    return F.lower(F.regexp_replace(F.translate(either(column), *_accents()), "[\u0300-\u036f]", ""))


_MARKS = dict.fromkeys(range(0x300, 0x370))


@F.pandas_udf(StringType())
def fold_compatible(text: pd.Series) -> pd.Series:
    """Lower case of the NFKD form without the marks U+0300 to U+036F: ligatures, widths and such are folded too."""
    return text.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKD", t).translate(_MARKS).lower())


def compact_key(column) -> Column:
    """Letters and digits only, without accents and the word ``the``."""
    return F.regexp_replace(F.regexp_replace(fold(column), "(^|[^a-z0-9])the($|[^a-z0-9])", "$1$2"), "[^a-z0-9]+", "")


def spaced_key(column, stop_words=()) -> Column:
    """Folded words apart by one space, less the stop words."""
    words = F.split(F.trim(F.regexp_replace(F.replace(fold(column), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words)) if stop_words else words, " ")


# Words that say nothing about which place is meant.
PLACE_WORDS = ("the", "restaurant", "resto", "cafe", "bar", "pub", "eatery", "kitchen")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "drive", "dr", "place", "pl", "boulevard", "blvd", "highway", "hwy")


def address_key(column) -> Column:
    return spaced_key(column, STREET_WORDS)


def civic_number(column) -> Column:
    """The number that opens an address; null for ranges and unit-first addresses."""
    text = F.trim(either(column))
    first = F.regexp_extract(text, "^([0-9]+[A-Za-z]?)[ ,]", 1)
    return F.when(~text.rlike("^[0-9]+ *[-/]") & (first != ""), F.upper(first))


def postal_code(column) -> Column:
    found = F.regexp_extract(F.upper(either(column)), "([A-Z][0-9][A-Z]) ?([0-9][A-Z][0-9])", 0)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))


def phone_key(column) -> Column:
    """The last ten digits; null with fewer."""
    digits = F.regexp_replace(either(column), "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def street_fingerprint(column) -> Column:
    """The civic number and up to three words after it."""
    words = F.split(F.trim(F.regexp_replace(fold(column), "[^a-z0-9]+", " ")), " ")
    return F.when(F.element_at(words, 1).rlike("^[0-9]+[a-z]?$"), F.array_join(F.slice(words, 1, 4), " "))


def slug(column, most: int = 70) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(fold(column), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


# Named entities that pages use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def entities(column) -> Column:
    """Named entities decoded; the ampersand last."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, either(column))


def html_text(column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; entities decoded; single spaces."""
    bare = F.regexp_replace(either(column), "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(entities(F.regexp_replace(bare, "<[^>]*>", " ")), "[ \\t\\n\\r]+", " "))


def post_text(column, limit: int = 240) -> Column:
    """Text of a post without tags, links and overlong tokens, cut to ``limit`` with dots."""
    bare = F.regexp_replace(F.regexp_replace(either(column), "<[^>]*>", " "), "https?://[^ ]+", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " ")), " "), lambda w: F.length(w) <= 36)
    text = F.array_join(words, " ")
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("..."))).otherwise(text)


def ellipsis(column, most: int = 100) -> Column:
    text = either(column)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def host_key(url) -> Column:
    """Host of a URL in lower case, without ``www.`` or ``m.`` and a final dot."""
    host = F.lower(F.regexp_extract(either(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, "^(www|m)\\.", ""), "\\.$", "")


def url_path(url) -> Column:
    return F.regexp_extract(either(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url) -> Column:
    return F.regexp_extract(either(url), "^[^?#]*\\?([^#]*)", 1)


def same_site(host: Column, other: Column) -> Column:
    """Equal hosts, or one below the other."""
    return (host == other) | F.endswith(host, F.concat(F.lit("."), other)) | F.endswith(other, F.concat(F.lit("."), host))


def safe_url(url, blocked=()) -> Column:
    """The URL if it is http or https and its host isn't blocked."""
    ok = either(url).rlike("^https?://[^/?#]+")
    return F.when(ok & ~host_key(url).isin(*blocked) if blocked else ok, either(url))


# Query parameters that only track.
TRACKING = "^(utm_[^=]*|fbclid|gclid)(=|$)"


def canonical_url(url, hosts=()) -> Column:
    """An https URL of an allowed host, without fragment and tracking, its parameters sorted; else null."""
    raw = either(url)
    kept = F.array_sort(F.filter(F.split(url_query(raw), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.lower(F.regexp_extract(raw, "^https://([^/?#]*)", 1))
    path = F.when(url_path(raw) == "", "/").otherwise(url_path(raw))
    ok = (host != "") & (host.isin(*hosts) if hosts else F.lit(True))
    return F.when(ok, F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def hash_id(parts, digits: int = 16) -> Column:
    """A content id: parts that aren't blank, joined and hashed."""
    return F.left(F.sha2(F.concat_ws("|", *[truthy(p) for p in parts]), 256), F.lit(digits))


def escape_html(column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), either(column))


def escape_ics(column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ("\n", "\\n"), (",", "\\,"), (";", "\\;")), either(column))


def escape_csv(column) -> Column:
    text = either(column)
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def keyword_hits(column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Map of each group to its terms found in the text; groups without a hit are left out."""
    text = F.lower(F.coalesce(either(column), F.lit("")))
    entries = [F.struct(F.lit(k).alias("key"), F.filter(F.array(*map(F.lit, v)), lambda t: F.contains(text, t)).alias("value")) for k, v in groups.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def primary(hits: Column, priorities: dict[str, int]) -> Column:
    """The group with the highest priority among the hits; ties go to the first name."""
    ranked = sorted(priorities, key=lambda k: (-priorities[k], k))
    return F.coalesce(*[F.when(F.map_contains_key(hits, k), F.lit(k)) for k in ranked])


def ladder(column, rules, other=None) -> Column:
    """The label of the first (pattern, label) that the lower-cased text meets."""
    text = F.lower(F.coalesce(either(column), F.lit("")))
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(other)


def labels(column, rules) -> Column:
    """Labels of all (pattern, label) that the lower-cased text meets, in order."""
    text = F.lower(F.coalesce(either(column), F.lit("")))
    return F.array_compact(F.array(*[F.when(text.rlike(p), label) for p, label in rules]))


def collapse_repeat(column) -> Column:
    """White space made single; ``a b a b`` becomes ``a b``."""

    def once(words):
        half = F.floor(F.size(words) / 2).cast("int")
        twice = (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
        return F.array_join(F.when(twice, F.slice(words, F.lit(1), half)).otherwise(words), " ")

    spaced = F.trim(F.regexp_replace(either(column), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced.isNotNull(), F.element_at(F.transform(F.array(F.split(spaced, " ")), once), 1))


# Fixed value: the badge that a library's listing puts before or between titles.
BADGE = "Featured Event. "


def display_title(column) -> Column:
    """A title without its badge: ``Badge x``, ``x Badge x`` and ``Badge x Badge x`` become ``x``; a badge between two different titles stays."""

    def clean(title):
        bare = F.when(F.startswith(title, F.lit(BADGE)), F.substr(title, F.lit(len(BADGE) + 1))).otherwise(title)
        halves = F.split(bare, rf" ?{BADGE.replace('.', '[.]')}", -1)
        return F.when((F.size(halves) == 2) & (halves[0] == halves[1]), halves[0]).otherwise(bare)

    return F.element_at(F.transform(F.array(collapse_repeat(column)), clean), 1)


def containment(a: Column, b: Column, least: int = 5) -> Column:
    """Length ratio of the shorter to the longer where the longer holds it and it is long enough; else 0."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when((F.length(short) >= least) & F.contains(long, short), F.length(short) / F.length(long)).otherwise(0.0)


def completes(short: Column, full: Column) -> Column:
    """Whether ``short`` is ``full`` cut off with an ellipsis."""
    stem = F.rtrim(F.regexp_replace(short, "(…|\\.\\.\\.)$", ""))
    return short.rlike("(…|\\.\\.\\.)$") & (stem != "") & F.startswith(full, stem)


def tag_attributes(html, tag: str, attribute: str) -> Column:
    """Values of an attribute in all tags of a kind, in order."""
    return F.regexp_extract_all(either(html), F.lit(f'(?i)<{tag}[^>]*? {attribute}="([^"]*)"'), F.lit(1))


def hash_state(fragment, defaults: dict[str, str]) -> Column:
    """State of a hash route: its parameters over the defaults."""
    query = F.regexp_extract(either(fragment), "\\?(.*)$", 1)
    given = F.str_to_map(query, F.lit("&"), F.lit("="))
    return F.struct(*[F.coalesce(F.when(given[k] != "", F.url_decode(given[k])), F.lit(v)).alias(k) for k, v in defaults.items()])


def state_hash(name: str, values: dict[str, Column], defaults: dict[str, str]) -> Column:
    """A hash route; parameters at their defaults are left out."""
    parts = [F.when(v != defaults[k], F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in values.items()]
    query = F.concat_ws("&", *parts)
    return F.concat(F.lit(f"#{name}"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

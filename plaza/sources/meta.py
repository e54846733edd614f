"""Images and publication dates that pages state about themselves."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from plaza.functions.dates import moment
from plaza.functions.text import either

# Names under which pages state their picture and their date, and types whose date is a publication's.
IMAGE_NAMES = ("og:image", "og:image:secure_url", "twitter:image", "twitter:image:src")
DATE_NAMES = ("article:published_time", "datepublished", "pubdate", "publishdate", "publication_date")
DATED_TYPES = "Article|BlogPosting"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2}))?$"


def tags(html, names: str) -> Column:
    """The opening tags of some kinds (``meta|time``) in order."""
    return F.coalesce(F.regexp_extract_all(either(html), F.lit(rf"(?i)<(?:{names})\b[^>]*>"), F.lit(0)), F.array().cast("array<string>"))


def attribute(tag: Column, *names: str) -> Column:
    """The value of the first of some attributes that a tag has and that isn't empty, in either kind of quotes; else null."""
    found = lambda name, quote: F.nullif(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{quote}([^{quote}]*){quote}", 1), F.lit(""))
    return F.coalesce(*[found(name, quote) for name in names for quote in ('"', "'")])


def first_of_srcset(value) -> Column:
    """The first address of a srcset; null if there is none."""
    parts = F.filter(F.transform(F.split(either(value), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.split(F.try_element_at(parts, F.lit(1)), r"\s+")[0]


def stated_images(html) -> Column:
    """Addresses of a page's pictures as stated in its head, then of those in its text (src, a lazy one, or the first of a srcset), each once; empty for null."""
    named = F.filter(tags(html, "meta"), lambda t: F.lower(attribute(t, "property", "name")).isin(*IMAGE_NAMES))
    shown = F.transform(tags(html, "img"), lambda t: F.coalesce(attribute(t, "src", "data-src", "data-lazy-src"), first_of_srcset(attribute(t, "srcset", "data-srcset"))))
    return F.array_distinct(F.array_compact(F.concat(F.transform(named, lambda t: attribute(t, "content")), shown)))


@F.pandas_udf(ArrayType(StringType()))
def _linked_dates(html: pd.Series) -> pd.Series:
    block, dated = re.compile(r"""<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S), re.compile(DATED_TYPES, re.I)

    def one(page):
        out = []
        for text in block.findall(page or ""):
            try:
                waiting = [json.loads(text)]
            except (ValueError, RecursionError):
                continue
            while waiting:
                value = waiting.pop()
                if isinstance(value, dict):
                    if dated.search(str(value.get("@type") or "")) and isinstance(value.get("datePublished"), str):
                        out.append(value["datePublished"])
                    waiting.extend(value.values())
                elif isinstance(value, list):
                    waiting.extend(value)
        return out

    return html.map(one)


def published_dates(html, as_of) -> Column:
    """Instants at which a page says it was published, in its date tags or its linked data, each once, the latest first.

    A day alone is its start. Dates that can't be read, or that are after ``as_of``, are
    left out; linked data that isn't JSON says nothing; a null page has no dates.
    """
    named = F.filter(tags(html, "meta|time"), lambda t: F.lower(attribute(t, "property", "name", "itemprop")).isin(*DATE_NAMES))
    stated = F.concat(F.transform(named, lambda t: attribute(t, "content", "datetime")), F.coalesce(_linked_dates(either(html)), F.array().cast("array<string>")))
    read = F.transform(stated, lambda d: F.when(F.trim(d).rlike(_STAMP), F.regexp_replace(F.trim(d), "T([0-9]{2}:[0-9]{2})(Z|[+-]|$)", "T$1:00$2").try_cast("timestamp")))
    return F.sort_array(F.array_distinct(F.filter(read, lambda d: d <= moment(as_of))), asc=False)

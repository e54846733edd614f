"""Arrays, maps and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plaza.functions.text import either


def distinct_truthy(array) -> Column:
    """Distinct values of a string array that aren't blank, in first-seen order."""
    return F.array_distinct(F.filter(either(array), lambda x: x.isNotNull() & (x != "")))


def keyed_union(first, second, key: str) -> Column:
    """Two arrays of structs; of a key the first stays."""
    return F.aggregate(
        F.concat(either(first), either(second)),
        F.slice(either(first), 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: y[key] == x[key]), acc).otherwise(F.array_append(acc, x)),
    )


def first_valid(array, test) -> Column:
    return F.try_element_at(F.filter(either(array), test), F.lit(1))


def slots(array, most: int, test) -> Column:
    """The first ``most`` elements that pass; those cut off never move up."""
    return F.filter(F.slice(either(array), 1, most), test)


def canonical_json(names) -> Column:
    """JSON of the named columns, keys sorted."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def meaningful_hash(names, clocks=()) -> Column:
    """Hash of a row's content without its clocks."""
    return F.sha2(canonical_json([n for n in names if n not in clocks]), 256)


@F.pandas_udf(StringType())
def sorted_json(text: pd.Series) -> pd.Series:
    """Any JSON text with keys sorted at every depth; null if it isn't JSON."""

    def one(value):
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def tolerant_json(column) -> Column:
    """Text with control characters made spaces, for a tolerant parse."""
    return F.regexp_replace(either(column), "[\\x00-\\x1f]+", " ")

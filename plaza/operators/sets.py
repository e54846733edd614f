"""Set operations and deduplication. Order is a column, never the order rows arrive in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each key, the first by ``order``; a null key is never grouped. The input is read once."""
    known = reduce(lambda a, b: a & b, [(F.col(k) if isinstance(k, str) else k).isNotNull() for k in keys])
    own = F.when(~known, F.monotonically_increasing_id())  # a group of its own for each row without a key
    numbered = rows.withColumn("_own", own)
    w = Window.partitionBy(*keys, "_own").orderBy(*order)
    return numbered.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_own")


def last_wins(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    return first_wins(rows, keys, [F.col(o).desc() for o in order])


def priority_merge(rows: DataFrame, key: str, priority: str, order: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row of each key: scalars from the highest priority that has one, arrays joined, ties to the first by ``order``."""
    rank = lambda c: F.struct((-F.col(priority)).alias("p"), F.col(order).alias("o"), F.col(c).alias("v"))
    first = [F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), rank(c)))["v"].alias(c) for c in scalars]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays]
    return rows.groupBy(key).agg(*first, *union)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of several sources under one schema; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reconcile(incoming: DataFrame, retained: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows win over retained ones of the same key."""
    both = incoming.withColumn("_rank", F.lit(0)).unionByName(retained.withColumn("_rank", F.lit(1)))
    return first_wins(both, keys, ["_rank", *order]).drop("_rank")


def merge_unique(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and the previous ones whose key isn't among them."""
    return current.unionByName(previous.join(current.select(*keys).distinct(), keys, "left_anti"))


def upsert(rows: DataFrame, additions: DataFrame, key: str) -> DataFrame:
    """``additions`` replace rows of their key and are added else; a key is unique on each side."""
    return rows.join(additions.select(key), key, "left_anti").unionByName(additions)


def supersede(rows: DataFrame, superseded: DataFrame, key: str) -> DataFrame:
    return rows.join(superseded.select(key), key, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has that the other lacks, and whether both are equal."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.lit(0), F.lit(1)))
    total = sides.agg(F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("only_right"))
    return total.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def keep_published_ids(current: DataFrame, previous: DataFrame, key: str, id_col: str) -> DataFrame:
    """Current rows under the id that their key had before; a key with several old ids is ambiguous and keeps its new one."""
    old = previous.groupBy(key).agg(F.min(id_col).alias("_old"), F.count_distinct(id_col).alias("_ids"))
    joined = current.join(old, key, "left")
    return joined.withColumns({"ambiguous": F.coalesce(F.col("_ids") > 1, F.lit(False)), id_col: F.when(F.col("_ids") == 1, F.col("_old")).otherwise(F.col(id_col))}).drop("_old", "_ids")


def canonical_events(rows: DataFrame, key: Column, order: str, provenance: list[str]) -> DataFrame:
    """Rows of one canonical key as one: the first by ``order``, with the joined provenance; a null key stays alone."""
    rows = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("~"), F.col(order).cast("string"))))
    union = [F.array_sort(F.collect_set(c)).alias(f"{c}_all") for c in provenance]
    first = F.min_by(F.struct(*[c for c in rows.columns if c != "_key"]), order).alias("_row")
    return rows.groupBy("_key").agg(first, F.count("*").alias("merged"), *union).select("_row.*", "merged", *[f"{c}_all" for c in provenance])


def assign(rows: DataFrame, additions: DataFrame, id_col: str, steps: list[str]) -> DataFrame:
    """addition, row, step: what each addition is of ``rows``, found in rounds.

    Both tables have ``id_col`` and the columns ``steps``. A round takes the rows and
    additions that no round before has matched, and matches those whose value
    stands exactly once on both sides; so a row that its id finds is out of reach
    for a title that it shares. An addition that no round matches is new: row and
    step are null. Ids are unique on each side; null and empty values match nothing.
    """
    found = None
    for step in steps:
        left, right = rows.select(F.col(id_col).alias("row"), F.col(step).alias("_v")), additions.select(F.col(id_col).alias("addition"), F.col(step).alias("_v"))
        if found is not None:
            left, right = left.join(found.select("row"), "row", "left_anti"), right.join(found.select("addition"), "addition", "left_anti")
        once = lambda side, name: side.where(F.coalesce(F.col("_v").cast("string"), F.lit("")) != "").groupBy("_v").agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")
        met = once(left, "row").join(once(right, "addition"), "_v").select("addition", "row", F.lit(step).alias("step"))
        found = met if found is None else found.unionByName(met)
    return additions.select(F.col(id_col).alias("addition")).join(found, "addition", "left")


def apply_additions(rows: DataFrame, additions: DataFrame, id_col: str, steps: list[str], observed: str, superseded: str, sets: list[str]) -> DataFrame:
    """``rows`` with the additions that ``assign`` finds merged into them, the others added, and those gone that an addition supersedes.

    A merged row has the addition's id. By id or any step but the last, the
    addition's values stand and the row's fill nulls; by the last step (the same
    occurrence told by another source), those that were ``observed`` later stand,
    the row's if both were at once. ``sets`` (arrays) are united, the addition's
    first. A row whose id is in some addition's ``superseded`` (array) goes, unless
    it is an addition's id. Both tables have the same columns.
    """
    found = assign(rows, additions, id_col, steps)
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    both = side(additions, "a").join(found, F.col(f"a_{id_col}") == F.col("addition"), "left").join(side(rows, "r"), F.col("row") == F.col(f"r_{id_col}"), "left")
    kept = (F.col("step") == steps[-1]) & F.coalesce(F.col(f"r_{observed}") >= F.coalesce(F.col(f"a_{observed}"), F.col(f"r_{observed}")), F.lit(False))
    value = lambda c: F.when(kept, F.coalesce(f"r_{c}", f"a_{c}")).otherwise(F.coalesce(f"a_{c}", f"r_{c}"))

    def merged(c: str):
        if c == id_col:
            return F.col(f"a_{c}").alias(c)
        if c in sets:
            none = F.array().cast(dict(rows.dtypes)[c])
            return F.array_distinct(F.concat(F.coalesce(f"a_{c}", none), F.coalesce(f"r_{c}", none))).alias(c)
        return value(c).alias(c)

    others = rows.join(found.where("row is not null").select(F.col("row").alias(id_col)), id_col, "left_anti").select(*rows.columns)
    gone = additions.select(F.explode(superseded).alias(id_col)).distinct().join(additions.select(id_col), id_col, "left_anti")
    return both.select(*[merged(c) for c in rows.columns]).unionByName(others).join(gone, id_col, "left_anti").select(*rows.columns)

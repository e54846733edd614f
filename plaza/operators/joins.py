"""Joins and entity resolution. Every input row keeps one output row with a state; none is lost by a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaza.operators.sets import last_wins


def one(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join with at most one match; of several rows of a key the last stands."""
    return left.join(last_wins(right, [key], order), key, "left")


def nested(left: DataFrame, right: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Left join with all matches as one sorted array; empty without a match."""
    many = right.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = many.schema[name].dataType.simpleString()
    return left.join(many, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def with_reason(left: DataFrame, right: DataFrame, key: str, reason: str) -> DataFrame:
    """All rows; those without a partner with the reason.

    Both sides are dealt by the key, and a task holds the keys of its part: broadcast, all keys would
    have to fit each executor, and the size of a compressed column says too little about that.
    """
    ids = right.select(key).distinct().withColumn("_met", F.lit(True)).hint("shuffle_hash")
    return left.join(ids, key, "left").select(*left.columns, F.when(F.col("_met").isNull(), reason).alias("reason"))


def with_orphans(left: DataFrame, right: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have a partner, and those that don't with the reason."""
    rows = with_reason(left, right, key, reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def unknown(rows: DataFrame, known: DataFrame, variants: list[Column], known_variants: list[Column], id_col: str) -> DataFrame:
    """Rows none of whose keys is among the keys of ``known``."""
    keys = known.select(F.explode(F.array_compact(F.array(*known_variants))).alias("_k")).distinct()
    met = rows.select(id_col, F.explode(F.array_compact(F.array(*variants))).alias("_k")).join(keys, "_k", "left_semi")
    return rows.join(met.select(id_col).distinct(), id_col, "left_anti")


def by_alias(rows: DataFrame, places: DataFrame, ref: str, id_col: str, aliases: str) -> DataFrame:
    """Left join of ``ref`` with a place's id or any of its aliases."""
    names = places.select(F.explode(F.array_distinct(F.concat(F.array(id_col), F.coalesce(aliases, F.array().cast("array<string>"))))).alias(ref), F.col(id_col).alias("canonical_id"))
    return rows.join(names.groupBy(ref).agg(F.min("canonical_id").alias("canonical_id")), ref, "left")


def migrate(saved: DataFrame, owners: DataFrame, alias: str, id_col: str) -> DataFrame:
    """Saved aliases become the id of their owner if there is exactly one."""
    single = owners.groupBy(alias).agg(F.count_distinct(id_col).alias("_n"), F.min(id_col).alias("_id")).where("_n = 1").drop("_n")
    return saved.join(single, alias, "left").withColumn("resolved", F.coalesce("_id", alias)).drop("_id")


def decide(explicit: Column, same_name: Column, place: Column) -> Column:
    """match, review or distinct from identity, name and place (same, different, conflict, unknown)."""
    off = place.isin("different", "conflict")
    return (
        F.when(~explicit & ~same_name, "distinct")
        .when(off, F.when(explicit | (place == "conflict"), "review").otherwise("distinct"))
        .when(explicit | (place == "same"), "match")
        .otherwise("review")
    )


def place_of(same_address: Column, metres: Column) -> Column:
    """same, different, conflict or unknown from whether two addresses agree (null: one is missing) and their distance."""
    return (
        F.when(same_address & (metres > 250), "conflict")
        .when(same_address & (metres <= 75), "same")
        .when(same_address, "unknown")
        .when(same_address.isNull() & (metres > 250), "different")
        .when(same_address.isNull(), "unknown")
        .otherwise("different")
    )


def resolve_identity(pairs: DataFrame, incoming: str, existing: str, state: str) -> DataFrame:
    """For each incoming row its one match, else review (several matches or a conflict), else distinct."""
    count = lambda s: F.count_if(F.col(state) == s)
    out = pairs.groupBy(incoming).agg(count("match").alias("m"), count("review").alias("r"), F.min(F.when(F.col(state) == "match", F.col(existing))).alias("hit"))
    verdict = F.when((F.col("m") == 1), "match").when((F.col("m") > 1) | (F.col("r") > 0), "review").otherwise("distinct")
    return out.select(incoming, verdict.alias("decision"), F.when(F.col("m") == 1, F.col("hit")).alias("matched_id"))


def merge_provenance(rows: DataFrame, key: str, order: str, scalars: list[str], sets: list[str]) -> DataFrame:
    """One row of each key: the first non-blank of each scalar, distinct values of each set, and how many layers."""
    first = [F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in scalars]
    return rows.groupBy(key).agg(*first, *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], F.count("*").alias("layers"))


def overlay(rows: DataFrame, reviewed: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Reviewed values: those of ``overwrite`` stand, those of ``fill`` only where there is none."""
    marked = reviewed.select(key, *[F.col(c).alias(f"_{c}") for c in (*overwrite, *fill)])
    joined = rows.join(marked, key, "left")
    new = {c: F.coalesce(f"_{c}", c) for c in overwrite} | {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")) for c in fill}
    return joined.withColumns(new).select(*rows.columns)


def top_per(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def blocked_pairs(left: DataFrame, right: DataFrame, blocks: list[tuple[Column, Column]], id_col: str = "id") -> DataFrame:
    """Distinct pairs that meet in at least one block; a null block meets nothing. Columns of the right start with ``r_``.

    Blocks join narrow rows (key and id), which are made distinct before either
    side's columns are added. A block should be as narrow as the evidence it
    stands for (a name, a phone, a street with its number): pairs of a block grow
    with the product of its sides.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r_id = f"r_{id_col}"
    keyed = lambda rows, key, name: rows.select(key.alias("_b"), name).where("_b is not null").distinct()
    parts = [keyed(left, a, id_col).join(keyed(right, b, r_id), "_b").drop("_b") for a, b in blocks]
    return reduce(DataFrame.unionByName, parts).distinct().join(left, id_col).join(right, r_id)


def pair_score(name_equal, name_within, phone_equal, domain_equal, postal_equal, street_equal, similarity, metres, conflicts) -> Column:
    """Evidence that a candidate is a place, in fixed points."""
    points = [
        F.when(name_equal, 35).when(name_within, 15), F.when(phone_equal, 45), F.when(domain_equal, 50), F.when(postal_equal, 30),
        F.when(street_equal & (similarity >= 0.55), 35).when(similarity >= 0.75, 20), F.when(metres <= 60, 40).when(metres <= 200, 25).when(metres <= 500, 10),
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points]) - conflicts * 20


def classify_best(scored: DataFrame, candidate: str, place: str) -> DataFrame:
    """The best place of each candidate and what its score, margin and evidence allow.

    Needs score, exact_name, near_name, strong (pieces of evidence besides the
    name), evidence (all pieces) and conflicts. A held best gives no way to the
    runner-up.
    """
    w = Window.partitionBy(candidate).orderBy(F.col("score").desc(), place)
    best = scored.withColumns({"_n": F.row_number().over(w), "second": F.lead("score").over(w)}).where("_n = 1")
    margin = F.col("score") - F.coalesce("second", F.lit(0))
    named = F.col("exact_name") | F.col("near_name")
    state = (
        F.when(F.col("conflicts") > 0, F.when((F.col("score") >= 80) & (margin >= 20), "review_conflict").otherwise("unresolved_conflict"))
        .when(~named & (F.col("strong") > 0), "non_name_evidence_review")
        .when((F.col("score") >= 75) & (F.col("strong") >= 1) & (margin >= 20), "resolved_high")
        .when((F.col("score") >= 60) & (F.col("evidence") >= 2) & (margin >= 15), "resolved_probable")
        .when((F.col("score") >= 35) & F.col("exact_name"), "name_only_review")
        .otherwise("unresolved")
    )
    return best.select(candidate, place, "score", margin.alias("margin"), state.alias("state"))


def cascade(rows: DataFrame, places: DataFrame, steps: list[tuple[str, Column, Column]], id_col: str) -> DataFrame:
    """The place of the first step whose key fits exactly one place, and that step's name."""
    out = rows
    for k, (_, key, place_key) in enumerate(steps):
        single = places.groupBy(place_key.alias(f"_k{k}")).agg(F.count_distinct(id_col).alias("_n"), F.min(id_col).alias(f"_p{k}")).where(f"_n = 1 and _k{k} is not null").drop("_n")
        out = out.withColumn(f"_k{k}", key).join(single, f"_k{k}", "left")
    how = reduce(lambda c, k: c.when(F.col(f"_p{k}").isNotNull(), steps[k][0]), range(1, len(steps)), F.when(F.col("_p0").isNotNull(), steps[0][0]))
    return out.withColumns({"place_id": F.coalesce(*[f"_p{k}" for k in range(len(steps))]), "how": how}).drop(*[f"_{x}{k}" for x in "kp" for k in range(len(steps))])


def near_pairs(rows: DataFrame, id_col: str, key: str, distance, most: float) -> DataFrame:
    """Pairs of one key no further apart than ``most``; ``distance(prefix_a, prefix_b)`` makes the column."""
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))).where(distance("a_", "b_") <= most)


def token_similarity(a: Column, b: Column) -> Column:
    """Shared distinct words by the larger number of them; 0 without any."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def shared_keys(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows with how many entities use their key, and whether it is shared."""
    used = rows.groupBy(key).agg(F.count_distinct(id_col).alias("n_entities"))
    return rows.join(used, key).withColumn("shared", F.col("n_entities") > 1)

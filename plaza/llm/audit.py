"""Audit of how filters interact: what each removes, after every set of filters before it.

Each batch of rows becomes an index of packed bits (64-bit NumPy words), one
bitset for each filter's failures, for each label and for the parts: rows are
ordered by part and every part begins at a new word, so a part is a run of words.
For each set of filters that may come before (a prefix set) and each filter after
it, ``failures AND NOT (failures of the prefix set)`` is counted by popcount, run
by run; the counts of batches and partitions are summed. An order of filters needs
no count of its own: what a step removes depends on the set before it only.

One filter, of repeated texts, needs the whole table: texts are told apart by
their SHA-256 digests, and those found more than once are joined back by shuffle
with the smallest id that has them.

Defined results: a null text is empty, a null source the part ``''``; a row whose
id is null never repeats another, and has no labels; of rows repeated with one
id, all that share a text with a smaller id fail; a document with several labels
is good (toxic) if any of them says so; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.common import cut, forget, or_empty, released, table

#: Letters of the filters, in the order of their bits; ``E`` is that of repeated texts.
FILTERS = "ABCDE"
#: Failure conditions: fewer words, fewer distinct words a hundred, more capitals a hundred code points, any of these symbols.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SYMBOLS = b"#$%&*|"

#: A task sends its sums on when it holds so many parts.
MOST_PARTS = 4096

_CAPITALS = bytes(range(65, 91))
_TAIL = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """The filters that the text alone fails, as bits."""
    words = text.split()
    distinct = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    points = len(text.translate(None, _TAIL))
    capitals = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return (len(words) < LEAST_WORDS) | distinct << 1 | capitals << 2 | symbols << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of the filters of one text), digest of every row."""

    def rows(batches):
        forget()
        for batch in batches:
            fails, digests = [], []
            for text in batch.column(2).cast(pa.binary()):
                text = text.as_py() or b""
                fails.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    chosen = docs.select(F.col("doc_id").cast("long"), or_empty(F.col("source").cast("string")), F.col("text").cast("string"))
    return chosen.mapInArrow(released(rows), "doc_id long, part string, fails int, digest binary")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of all filters), good, toxic of every row."""
    rows = cut(judged(docs))
    # both written first, so that Spark can split a hot digest or id among tasks
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = cut(said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic"))
    rows = rows.join(first, "digest", "left").join(said, "doc_id", "left")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select("part", F.col("fails").bitwiseOR(F.shiftleft(repeats, len(FILTERS) - 1)).alias("fails"), no("good"), no("toxic"))


def _packed(bits: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """``bits`` (rows x kinds) at their places of as many bitsets, as 64-bit words."""
    spread = np.zeros((bits.shape[1], words * 64), np.uint8)
    spread[:, places] = bits.T
    return np.packbits(spread, axis=1, bitorder="little").view(np.uint64)


def _prefix_sets(k: int) -> list[tuple[int, int]]:
    """Each set of filters with each filter that is not in it."""
    return [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def indexed(part: np.ndarray, parts: int, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, k: int = len(FILTERS)) -> np.ndarray:
    """Counts (part, cell of ``_prefix_sets``, [removed, good, toxic, kept]) of rows whose parts are numbered from 0."""
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    words = -(-sizes // 64)
    starts = np.cumsum(words) - words
    places = np.arange(len(part)) + np.repeat(starts * 64 - (np.cumsum(sizes) - sizes), sizes)
    kinds = np.column_stack([fails[order, None] >> np.arange(k) & 1, good[order], toxic[order], np.ones(len(part), int)]).astype(np.uint8)
    index = _packed(kinds, places, int(words.sum()))
    of, (is_good, is_toxic, is_row) = index[:k], index[k:]
    union = np.zeros((1 << k, index.shape[1]), np.uint64)
    for s in range(1, 1 << k):
        low = s & -s
        union[s] = union[s ^ low] | of[low.bit_length() - 1]
    out = np.zeros((parts, k << (k - 1), 4), np.int64)
    for cell, (s, f) in enumerate(_prefix_sets(k)):
        gone = of[f] & ~union[s]
        for kind, bits in enumerate((gone, gone & is_good, gone & is_toxic, is_row & ~union[s | 1 << f])):
            out[:, cell, kind] = np.add.reduceat(np.bitwise_count(bits), starts, dtype=np.int64)
    return out


def prefix_counts(rows: DataFrame) -> DataFrame:
    """part, prefix (set of filters, as bits), filter (its bit's number), removed, good, toxic, kept."""
    cells = np.array(_prefix_sets(len(FILTERS)), np.int32)
    names = ["part", "prefix", "filter", "removed", "good", "toxic", "kept"]

    def sent(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = np.concatenate(list(sums.values()))
        columns = [pa.array(np.tile(cells[:, x], len(sums))) for x in (0, 1)] + [pa.array(counts[:, x]) for x in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(list(sums)).take(pa.array(np.repeat(np.arange(len(sums)), len(cells)))), *columns], names=names)

    def counted(batches):
        forget()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            fails, good, toxic = (batch.column(x).to_numpy(zero_copy_only=False) for x in (1, 2, 3))
            found = indexed(coded.indices.to_numpy(), len(coded.dictionary), fails, good, toxic)
            for part, own in zip(coded.dictionary.to_pylist(), found):
                sums[part] = sums[part] + own if part in sums else own
            if len(sums) > MOST_PARTS:
                yield sent(sums)
                sums = {}
        if sums:
            yield sent(sums)

    parts = rows.mapInArrow(released(counted), "part string, prefix int, filter int, removed long, good long, toxic long, kept long")
    return parts.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in names[3:]])


def orders(filters: str = FILTERS) -> pa.Table:
    """Every step of every order of the filters: filter_order, step, prefix, filter. k! times k rows."""
    bit = {f: k for k, f in enumerate(filters)}
    rows = [("".join(o), n + 1, sum(1 << bit[f] for f in o[:n]), bit[o[n]]) for o in permutations(filters) for n in range(len(filters))]
    return pa.table({name: pa.array(x, t) for name, x, t in zip(("filter_order", "step", "prefix", "filter"), zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32()))})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, for each part and step of every order."""
    k = len(FILTERS)
    before = F.bit_count("prefix")
    orders_with = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]), before + 1)
    others = F.expr(f"{(1 << k) - 1} ^ shiftleft(1, filter)")
    cells = prefix_counts(labelled(docs, labels)).groupBy("part", "filter").agg(
        F.sum(F.when(before == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("prefix") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders_with).alias("shapley"),
        F.collect_list(F.struct("prefix", "removed", "good", "toxic", "kept")).alias("cells"),  # one for each set without the filter
    )
    cells = cells.select("part", "filter", "fails", "unique_fails", "shapley", F.inline("cells"))
    steps = docs.sparkSession.createDataFrame(orders())
    return cells.join(F.broadcast(steps), ["prefix", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def query(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id
), m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), s AS (
  SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before, substr(filter_order, 1, step) AS upto FROM o, range(1, 6) r(step)
), c AS (
  SELECT part, filter_order, step, x,
         sum(n) FILTER (WHERE translate(fails, upto, '') = fails) AS kept,
         sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS removed,
         sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') <> fails) AS redundant,
         sum(n) FILTER (WHERE fails = x) AS unique_fails,
         sum(good) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS good_lost,
         sum(toxic) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM c
"""

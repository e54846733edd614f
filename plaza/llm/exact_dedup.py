"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for each text, two positions of a counting bit table and keeps
the positions that were hit twice or more. Pass two probes: a row both of whose
positions are repeated possibly has a copy. Only those rows shuffle, on their
digest; every other row passes straight through.

The table of repeated positions is broadcast only when its counted rows are at
most ``BROADCAST_WORDS`` (64 positions and 16 bytes each), that of groups of
equal texts when it has at most ``BROADCAST_GROUPS`` (about 150 bytes each); above
that they are joined by shuffle, which is slower and gives the same rows.

Defined results: a null text counts as empty; texts without any visible
character form one group; among equal texts the row with the most code points,
then the smallest ``doc_id`` (null first) stays; rows repeated with the same
id and length are all marked kept by ``mark`` and reduced to one by ``dedup``;
an empty table gives an empty table; input columns named like an output column
are replaced by ``mark`` and untouched by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.common import WHITE, cut, or_empty, table, without

BITS_PER_ROW = 16
BROADCAST_WORDS = 1 << 20
BROADCAST_GROUPS = 100_000
#: Rows of equal texts are summed up in so many parts before they meet.
PARTS = 64
OUT = ("keep_id", "group_size", "kept", "text_sha256")
#: Working columns of a row: digest, code points, whether a copy is possible.
DIGEST, POINTS, MAYBE = "_xd_digest", "_xd_points", "_xd_maybe"


def _prints(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the digest of its normalised text and its length in code points."""
    plain = or_empty(F.col(text))
    return docs.withColumns({DIGEST: F.sha2(F.regexp_replace(plain, WHITE + "+", ""), 256), POINTS: F.char_length(plain)})


def _repeated(prints: DataFrame, bits: int) -> DataFrame:
    """Words of 64 positions each, of the positions hit at least twice."""
    position = F.explode(F.array(_slot(0, bits), _slot(1, bits))).alias("p")
    twice = prints.select(position).groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))


def _slot(k: int, bits: int):
    """Position ``k`` of a row; each of the two has its own half of the table."""
    return F.pmod(F.xxhash64(DIGEST, F.lit(k)), F.lit(bits)) + F.lit(k * bits)


def candidates(prints: DataFrame) -> DataFrame:
    """Rows that have DIGEST with MAYBE: a copy is possible."""
    bits = 1 << max(16, (BITS_PER_ROW * max(prints.count(), 1) - 1).bit_length())
    words = cut(_repeated(prints, bits))
    small = words.count() <= BROADCAST_WORDS
    out = prints
    for k in (0, 1):
        side = words.select(F.col("word").alias(f"_xd_w{k}"), F.col("bits").alias(f"_xd_b{k}"))
        slot = _slot(k, bits)
        out = out.withColumn(f"_xd_w{k}", F.shiftright(slot, 6))
        out = out.join(F.broadcast(side) if small else side, f"_xd_w{k}", "left")
        out = out.withColumn(f"_xd_h{k}", F.coalesce(F.getbit(f"_xd_b{k}", F.pmod(slot, F.lit(64)).cast("int")), F.lit(0)) == 1)
    return out.withColumn(MAYBE, F.col("_xd_h0") & F.col("_xd_h1")).drop(*[f"_xd_{c}{k}" for c in "wbh" for k in (0, 1)])


def mark(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256."""
    return _marked(_prints(without(docs, *OUT), text), id_col)


def _marked(prints: DataFrame, id_col: str) -> DataFrame:
    rows = candidates(prints)
    alone = rows.where(~F.col(MAYBE)).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    maybe = rows.where(MAYBE)
    groups = maybe.groupBy(DIGEST).agg(F.min(_first(id_col)).alias("_xd_best"), F.count("*").alias("group_size"))
    # written first, so that Spark can split the rows of a hot text among tasks
    best = cut(groups.where("group_size > 1"))
    both = maybe.join(F.broadcast(best) if best.count() <= BROADCAST_GROUPS else best, DIGEST, "left")
    both = both.withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("_xd_best.id")),
        "kept": F.col("group_size").isNull() | F.col(id_col).eqNullSafe(F.col("_xd_best.id")) & (F.col(POINTS) == -F.col("_xd_best.n")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
    })
    return alone.unionByName(both.drop("_xd_best")).withColumnRenamed(DIGEST, "text_sha256").drop(POINTS, MAYBE)


def _first(id_col: str):
    """Least for the row that stays."""
    return F.struct((-F.col(POINTS)).alias("n"), F.col(id_col).alias("id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``; rows that differ in neither text nor id leave one."""
    rows = candidates(_prints(docs, text))
    maybe = rows.where(MAYBE).withColumn("_xd_part", F.pmod(F.xxhash64(id_col), F.lit(PARTS)))
    row = F.struct(*docs.columns).alias("row")
    # a hot text is first settled in parts, so no task gets all its copies
    some = maybe.groupBy(DIGEST, "_xd_part").agg(F.min_by(row, _first(id_col)).alias("row"), F.min(_first(id_col)).alias("first"))
    once = some.groupBy(DIGEST).agg(F.min_by("row", "first").alias("row")).select("row.*")
    return rows.where(~F.col(MAYBE)).select(*docs.columns).union(once)


def query(spark, sf_dir):
    prints = cut(_prints(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text"))
    return _marked(prints, "doc_id").select("doc_id", *OUT)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), b AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b
"""

"""Exact Jaccard join of documents' word n-gram sets, down to its connected groups.

Method: set relations let the join skip work on two levels.

* Index lists are cut into blocks by set size, and an entry's position in its
  set's global order bounds the sizes of the partners it can still reach, so an
  entry meets only the blocks within that bound (``_partners``).
* Sets highly similar to a pivot inherit the pivot's answers: the overlap of two
  sets differs from the overlap of their pivots by no more than what each lacks
  or has besides, so most pairs are decided by that alone (``_with_sets``,
  ``_in_blocks``); pairs whose sets are already connected need no answer at all.

Steps:

1. Each text becomes a set of 64-bit n-gram hashes. Equal sets form one class,
   whose key is a 64-bit digest of the set.
2. n-grams below a fixed point of the hash range are counted; of the n-grams a
   class has there, one found in no other class is lost to any link. A class that
   has lost more than a link allows is linked with nothing. Of the few classes
   that are left, all n-grams are counted, and the same is asked again.
3. The n-grams of a class get an order: those lost, then those below the fixed
   point by document frequency, then the others; a prefix must meet a partner's
   prefix.
4. Each class is compared with the pivot that most of its prefix lists name;
   the classes linked with one pivot stand for one entry from then on.
5. Of lists that still name several groups, pivots not yet connected are
   compared; where a link around them is possible, classes around the one are
   compared with the other, and where these answers leave it open, blocks of
   the classes around both are compared.

No list of an n-gram is gathered in one task; frequent ones are joined in
parts (Spark's skew handling) after connected sets have left them. Shingles are
made anew for the counting pass and for the classes left, rather than stored.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and is its own component; fewer words than n form one n-gram; each
row counts by its own text, also where an id is repeated; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaza.llm.common import Scratch, cut, released, table, worker_memory
from plaza.llm.components import components

WORDS = 4
PERCENT = 85
#: Part of the hash range whose n-grams are counted for all classes.
COUNTED = 0.3
#: Ids are broadcast only up to this counted number (8 bytes each).
BROADCAST_IDS = 2_000_000
#: A worker forgets its words' hashes beyond so many, and sends its sets on beyond so many n-grams.
MOST_WORDS = 100_000
MOST_GRAMS = 250_000
#: n-grams of a block of sets that are compared with another block.
BLOCK_GRAMS = 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTORS = np.array([int.from_bytes(xxhash.xxh64_digest(str(k))) | 1 for k in range(64)], np.uint64)  # one odd number for each place in an n-gram


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _hashes() -> _Hashes:
    return worker_memory("hashes of words", _Hashes)


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The set of hashed n-grams of a text, sorted as unsigned 64-bit numbers."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = _hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * _FACTORS[i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(29)
    if len(known) > MOST_WORDS:
        known.clear()
    return np.unique(s)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _below(part: float) -> np.uint64:
    return np.uint64(min(int(part * 2**64), 2**64 - 1))


def _each(docs: DataFrame, n: int, schema: str, columns: Callable[[list, list[np.ndarray]], list]) -> DataFrame:
    """``columns`` of the ids and sets of all rows, some rows at a time."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            ids, own, grams = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(doc)
                own.append(shingles(text.as_py(), n))
                grams += len(own[-1])
                if grams > MOST_GRAMS or len(own) == 256:
                    yield pa.RecordBatch.from_arrays(columns(ids, own), names=names)
                    ids, own, grams = [], [], 0
            if own:
                yield pa.RecordBatch.from_arrays(columns(ids, own), names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(rows), schema)


def _digests(own: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(s) for s in own], np.uint64).view(np.int64))


def sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and key (digest of the set) of every row."""
    return _each(docs, n, "doc_id long, n_shingles long, key long", lambda ids, own: [pa.array(ids, pa.int64()), pa.array([len(s) for s in own], pa.int64()), _digests(own)])


def _counted(docs: DataFrame, n: int, counted: float) -> DataFrame:
    """key and the counted n-grams of every row."""
    return _each(docs, n, "key long, grams array<long>", lambda ids, own: [_digests(own), _lists([s[: np.searchsorted(s, _below(counted))] for s in own])])


def _full(docs: DataFrame, n: int, percent: int, counted: float) -> DataFrame:
    """key, n, grams (the whole set), early (how many of them are counted ones) and n_low: how many of its first may be in a prefix."""

    def columns(ids, own):
        early = [int(np.searchsorted(s, _below(counted))) for s in own]
        low = [min(len(s), max(e, (100 - percent) * len(s) // 100 + 1)) for s, e in zip(own, early)]
        return [_digests(own), pa.array([len(s) for s in own], pa.int64()), _lists(own), pa.array(early, pa.int32()), pa.array(low, pa.int32())]

    return _each(docs, n, "key long, n long, grams array<long>, early int, n_low int", columns)


def _may_lose(percent: int):
    """n-grams that a set may lack in a partner it is linked with."""
    return F.floor(F.col("n") * (100 - percent) / 100)


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, counted: float = COUNTED) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return _named(_components(docs, n, percent, counted)).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null last), then the smallest key.

    Rows are dropped by id. Where an id is null or repeated, they are dropped by
    id and key, and of equal ones any one stays.
    """
    found = cut(_named(_components(docs, n, percent, COUNTED)).select("doc_id", "n_shingles", "key", "component"))
    full = found.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = full.groupBy("component").agg(F.min(row).alias("kept"), F.count("*").alias("size")).where("size > 1")
    others = full.join(kept, "component").where(row != F.col("kept")).select("doc_id", "key")
    odd = cut(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"))
    if odd.isEmpty():
        return _lacking(docs, others.select("doc_id"), "doc_id")
    odd = odd.where("doc_id is not null")
    unnamed = F.col("doc_id").isNull()
    plain = _lacking(_lacking(docs.where(~unnamed), odd, "doc_id"), _lacking(others.where(~unnamed), odd, "doc_id").select("doc_id"), "doc_id")
    rest = keyed(docs.where(unnamed).union(_having(docs, odd, "doc_id").select(*docs.columns)), n, "_jc_key")
    gone = others.select(F.col("doc_id").alias("_jc_id"), F.col("key").alias("_jc_gone"))
    rest = rest.join(gone, F.col("_jc_id").eqNullSafe(F.col("doc_id")) & (F.col("_jc_gone") == F.col("_jc_key")), "left_anti")
    empty = rest.where("_jc_key is null").drop("_jc_key")
    return plain.select(*docs.columns).union(empty).union(rest.where("_jc_key is not null").dropDuplicates(["doc_id", "_jc_key"]).drop("_jc_key"))


def keyed(docs: DataFrame, n: int, name: str) -> DataFrame:
    """``docs`` with the digest of each row's set, null if it is empty."""
    schema = StructType([*docs.schema.fields]).add(name, "long")
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            own = [shingles(t.as_py(), n) for t in batch.column(at).cast(pa.string()).cast(pa.binary())]
            keys = pa.array([d if len(s) else None for s, d in zip(own, _digests(own).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=schema.names)

    return docs.mapInArrow(released(rows), schema)


def _components(docs: DataFrame, n: int, percent: int, counted: float):
    """The rows of ``sets``; (key, component) of the classes that have a link."""
    own = cut(sets(docs, n))
    classes = own.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        once = _lost(_counted(docs, n, counted))
        reps = scratch.cut(_not_alone(classes, once, percent))
        named = lambda df: df.withColumn("_jc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
        chosen = _having(named(docs.select("doc_id", "text")), named(reps).select("_jc_id"), "_jc_id")
        full = scratch.cut(_full(chosen, n, percent, counted).dropDuplicates(["key"]))
        left = scratch.cut(_not_alone(full.select("key", "n"), _lost(full, _late("g", counted)), percent).drop("n"))
        full = scratch.cut(full.join(F.broadcast(left) if left.count() <= BROADCAST_IDS else left, "key"))
        return own, cut(_groups(scratch, full, percent, counted))


def _named(found) -> DataFrame:
    own, groups = found
    named = own.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    # classes of a component have one number, so the hot ones meet in a join that Spark can split
    return named.join(least, "component", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))


def _having(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is among ``ids``."""
    ids = ids.distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def _lacking(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is not among ``ids``."""
    ids = cut(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_anti")


def _lost(sets_: DataFrame, late=None) -> DataFrame:
    """key, lost, lost_low: how many of its ``grams`` are in no other class; of them, how many are not late."""
    grams = sets_.select("key", F.explode("grams").alias("g"))
    once = grams.groupBy("g").agg(F.min("key").alias("key"), F.max("key").alias("key_")).where("key = key_")
    return once.groupBy("key").agg(F.count("*").alias("lost"), F.count_if(~late if late is not None else F.lit(True)).alias("lost_low"))


def _not_alone(classes: DataFrame, lost: DataFrame, percent: int) -> DataFrame:
    """The classes that share enough n-grams with others to have a link, with lost and lost_low."""
    return classes.join(lost, "key", "left").na.fill(0, ["lost", "lost_low"]).where(F.col("lost") <= _may_lose(percent))


def _late(g: str, counted: float):
    """Whether an n-gram is not below the point up to which all are counted; as signed numbers, hashes below 2**63 are the positive ones."""
    edge = int(_below(counted))
    return (F.col(g) < 0) | (F.col(g) >= edge) if edge < 2**63 else (F.col(g) < 0) & (F.col(g) >= edge - 2**64)


def _groups(scratch: Scratch, full: DataFrame, percent: int, counted: float) -> DataFrame:
    """(key, component) of the classes that have a link."""
    lists = scratch.cut(_prefixes(scratch, full, percent, counted))
    votes = scratch.cut(_pivots(scratch, lists, percent))
    checked = scratch.cut(_overlaps(votes, full))
    near = checked.where(_linked("o", percent)).select("a", "b")
    labels = components(near)
    around = scratch.cut(_around(full, checked, labels, percent))
    pairs = scratch.cut(_partners(scratch, lists, around, percent))
    asked = pairs.select("a", "b").join(_either_way(checked).select("a", "b"), ["a", "b"], "left_anti")
    known = scratch.cut(_either_way(checked).union(_overlaps(asked, full).select("a", "b", "na", "nb", "o")))
    met = scratch.cut(_with_sets(scratch, pairs, known, around, full, percent))
    links = near.union(met.where(_linked("o", percent)).select("a", "b"))
    now = components(links)
    return components(links.union(_in_blocks(scratch, met, around, now, full, percent))).withColumnRenamed("node", "key")


def _either_way(rows: DataFrame) -> DataFrame:
    """Pairs with the lesser key first."""
    back = F.col("a") > F.col("b")
    turn = lambda x, y: F.when(back, F.col(y)).otherwise(F.col(x)).alias(x)
    return rows.select(turn("a", "b"), turn("b", "a"), turn("na", "nb"), turn("nb", "na"), "o").dropDuplicates(["a", "b"])


def _linked(overlap: str, percent: int):
    return F.col(overlap) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))


def _prefixes(scratch: Scratch, full: DataFrame, percent: int, counted: float) -> DataFrame:
    """The index lists: g, rep (key of a class), n, at (position in the global order), lost (n-grams found nowhere else, of 1000).

    The order: n-grams found once; counted ones by rising document frequency,
    then by hash; then the others by hash. Those found once stand first and take
    places, but have no list; late ones found once among these classes only may
    go unnoticed, so a place is a least one.
    """
    low = full.select(F.col("key").alias("rep"), "n", (F.col("lost") - F.col("lost_low") + F.col("early")).alias("lost"), F.explode(F.slice("grams", F.lit(1), F.col("n_low"))).alias("g"))
    often = scratch.cut(low.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))  # written first, so that Spark can split a hot n-gram among tasks
    own = Window.partitionBy("rep")
    placed = low.join(often, "g").withColumn("late", _late("g", counted))
    # the unsigned order of hashes: positive first
    order = own.orderBy("late", F.when(F.col("late"), 0).otherwise(F.col("df")), F.col("g") < 0, "g")
    placed = placed.withColumns({"met": F.count_if(~F.col("late")).over(own), "k": F.row_number().over(order)})
    placed = placed.withColumn("lost", F.col("lost") - F.col("met"))
    placed = placed.withColumn("at", F.col("lost") + F.col("k") - 1)
    return placed.where(F.col("at") <= _may_lose(percent)).select("g", "rep", "n", "at", F.expr("1000 * lost div n").alias("lost"))


def _pivots(scratch: Scratch, lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class, the pivot named by most of its lists. A list's pivot is its class with the fewest n-grams of its own."""
    pivot = scratch.cut(lists.groupBy("g").agg(F.min(F.struct("lost", "rep", "n")).alias("p")).select("g", F.col("p.rep").alias("b"), F.col("p.n").alias("nb")))
    named = lists.join(pivot, "g").where("rep <> b").where(_sizes("n", "nb", percent))
    votes = named.groupBy("rep", "b").agg(F.count("*").alias("v"))
    best = votes.groupBy("rep").agg(F.max(F.struct("v", (-F.col("b")).alias("b"))).alias("x"))
    return best.select(F.col("rep").alias("a"), (-F.col("x.b")).alias("b"))


def _sizes(a: str, b: str, percent: int):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _around(full: DataFrame, checked: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """rep, n, p, more, less, c of every class: the pivot that it is linked with (else itself), n-grams it has besides the pivot's and lacks of them, its group so far."""
    near = checked.where(_linked("o", percent)).select(F.col("a").alias("rep"), F.col("b").alias("p"), (F.col("na") - F.col("o")).alias("more"), (F.col("nb") - F.col("o")).alias("less"))
    rows = full.select(F.col("key").alias("rep"), "n").join(near, "rep", "left").join(labels.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left")
    return rows.select("rep", "n", F.coalesce("p", "rep").alias("p"), F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("less", F.lit(0)).alias("less"), F.coalesce("c", "rep").alias("c"))


def _partners(scratch: Scratch, lists: DataFrame, around: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of pivots in different groups so far, around which classes meet in a list and may be linked.

    An entry stands for all classes around one pivot, so a list has no more
    entries than pivots. ``most``: with the first shared n-gram at position
    ``at``, the overlap is at most n - at, so a partner has at most that many
    n-grams. A list's blocks hold the sizes within one factor of the threshold;
    an entry is sent to the blocks between its least and most partner size only.
    Lists that name one group only have no pairs.
    """
    most = F.expr(f"cast(floor((({100 + percent}) * (n - at) - {percent} * n) / {percent}) as bigint)")
    least = F.expr(f"cast(ceil(n * {percent} / 100) as bigint)")
    rows = lists.select("g", "rep", "n", "at", most.alias("most"), least.alias("least")).where("most >= least").join(around.select("rep", "p", "c"), "rep")
    bounds = [F.min("least").alias("least"), F.max("most").alias("most"), F.min("n").alias("low"), F.max("n").alias("high")]
    entries = scratch.cut(rows.groupBy("g", "p").agg(*bounds, F.first("c").alias("c")))
    mixed = entries.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("g")
    entries = scratch.cut(entries.join(mixed, "g"))
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    block = lambda x: F.floor(F.log(F.col(x).cast("double")) / step).cast("int")
    left = entries.withColumn("block", F.explode(F.sequence(block("least"), block("most"))))
    right = entries.withColumn("block", F.explode(F.sequence(block("low"), block("high"))))
    right = right.select("g", "block", *[F.col(x).alias(f"{x}_") for x in ("p", "c", "least", "most", "low", "high")])
    met = left.join(right, ["g", "block"]).where("p < p_ and c <> c_ and high_ >= least and low_ <= most and high >= least_ and low <= most_")
    return met.select(F.col("p").alias("a"), F.col("p_").alias("b")).distinct()


def _need(percent: int, a: str = "na", b: str = "nb"):
    """The overlap from which on two sets are linked."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def _with_sets(scratch: Scratch, pairs: DataFrame, known: DataFrame, around: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, o): of each pair of pivots, all classes around the one with fewer against the other pivot, as far as any link is possible.

    What a class around a pivot has besides it bounds its overlap with anything
    whose overlap with the pivot is known.
    """
    about = scratch.cut(around.groupBy("p").agg(F.count("*").alias("size"), F.max("more").alias("more"), F.min("n").alias("low")))
    side = lambda x: about.select(F.col("p").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "more", "low")])
    rows = pairs.join(known, ["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(F.col("o") + F.col("more_a") + F.col("more_b") >= _need(percent, "low_a", "low_b"))
    fewer = F.col("size_a") <= F.col("size_b")
    one = rows.select(
        F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("q"), "o",
        F.when(fewer, F.col("more_b")).otherwise(F.col("more_a")).alias("more_q"), F.when(fewer, F.col("low_b")).otherwise(F.col("low_a")).alias("low_q"),
        F.when(fewer, F.col("nb")).otherwise(F.col("na")).alias("nq"),
    )
    each = one.join(around.select("rep", "n", "p", "more"), "p").where(F.col("o") + F.col("more") + F.col("more_q") >= _need(percent, "n", "low_q"))
    each = scratch.cut(each.select("p", "rep", "n", "q", "nq", "o"))
    plain = each.where("rep = p").select(F.col("rep").alias("a"), F.col("q").alias("b"), F.col("n").alias("na"), F.col("nq").alias("nb"), "o")
    others = _overlaps(each.where("rep <> p").select(F.col("rep").alias("a"), F.col("q").alias("b")), full)
    return plain.union(others.select("a", "b", "na", "nb", "o"))


def _in_blocks(scratch: Scratch, met: DataFrame, around: DataFrame, now: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes a of ``met`` with classes b around its pivots, of groups not yet connected.

    The classes asked about one pivot and those around it are cut into blocks of
    about ``BLOCK_GRAMS`` n-grams; each block of the one meets each of the other in
    one task. Of a block, a class gets one link at most, as the classes around a
    pivot are connected already.
    """
    group = lambda x: now.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    rows = met.join(group("a"), "a", "left").join(group("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    rows = scratch.cut(rows.select("a", F.col("b").alias("q"), "na", "o"))
    inner = around.where("rep <> p").select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("p").alias("q"), "more")
    parts = lambda n: F.ceil(F.sum(n) / BLOCK_GRAMS)
    grid = rows.groupBy("q").agg(parts("na").alias("n_i")).join(inner.groupBy("q").agg(parts("nb").alias("n_j"), F.max("more").alias("most"), F.min("nb").alias("low")), "q")
    grid = scratch.cut(grid)
    asked = rows.join(grid, "q").where(F.col("o") + F.least(F.col("most"), F.col("na") - F.col("o")) >= _need(percent, "na", "low"))
    sets_of = lambda x, keys: _having(full.select(F.col("key").alias(x), F.col("grams").alias("grams")), keys.select(x), x)
    place = lambda x, n: F.pmod(F.xxhash64(x), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = scratch.cut(asked)
    left = asked.join(sets_of("a", asked), "a").select("q", place("a", "n_i").alias("i"), every("n_j").alias("j"), "a", "na", "o", "grams")
    wanted = scratch.cut(inner.join(asked.select("q", "n_i", "n_j").distinct(), "q"))
    right = wanted.join(sets_of("b", wanted), "b").select("q", every("n_i").alias("i"), place("b", "n_j").alias("j"), "b", "nb", "more", "grams")

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if a.num_rows and b.num_rows:
            b = b.combine_chunks()
            lists = b["grams"].combine_chunks()
            flat = pc.list_flatten(lists).to_numpy().view(np.uint64)
            sizes = b["nb"].to_numpy()
            starts = np.cumsum(sizes) - sizes
            more, keys = b["more"].to_numpy(), b["b"].to_numpy()
            for key, n, o, grams in zip(a["a"].to_pylist(), a["na"].to_pylist(), a["o"].to_pylist(), a["grams"]):
                need = -(-percent * (n + sizes) // (100 + percent))
                if (np.minimum(o, sizes - more) + np.minimum(more, n - o) < need).all():
                    continue
                own = grams.values.to_numpy().view(np.uint64)
                at = np.searchsorted(own, flat)
                at[at == len(own)] = 0
                common = np.add.reduceat(own[at] == flat, starts, dtype=np.int64)
                hit = np.flatnonzero(common >= need)
                if len(hit):
                    found_a.append(key)
                    found_b.append(keys[hit[0]])
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    key = ["q", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(one, "a long, b long")


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and o, the size of the intersection; two streams of sets are joined, none is gathered."""

    def rows(batches):
        for batch in batches:
            a, b = (_arrays(batch.column(k)) for k in (2, 3))
            o = [_common(x, y) for x, y in zip(a, b)]
            sizes = [pa.array([len(x) for x in s], pa.int64()) for s in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(o, pa.int64())], names=["a", "b", "na", "nb", "o"])

    pairs = pairs.select("a", "b")
    side = lambda x: _having(full.select(F.col("key").alias(x), F.col("grams").alias(f"g{x}")), pairs.select(x), x)
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb")
    return joined.mapInArrow(released(rows), "a long, b long, na long, nb long, o long")


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def query(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g
  FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""

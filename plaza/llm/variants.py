"""Spelling variants: words one edit apart, and the form that each goes back to.

A word's mask has a bit for each letter, set where the letter occurs an odd number
of times (accented letters share bits). One inserted or deleted letter flips one
bit, one replaced letter at most two, so of three bands that split the mask one
is equal in any two words that are one edit apart. Words are joined on (band,
its bits, length), a word standing under its own length and under the one below;
each pair is taken in its first equal band only, so none comes twice. In a block
of pairs, masks that differ in over two bits are dropped by popcount, and the
rest are verified letter by letter.

The words of a key are cut into blocks of ``BLOCK``, and each block meets each of
the key's other blocks in a task of its own, so no task gets all words of a key.
The number of pairs of masks still grows with the square of a key's words.

A word's form is its most frequent near word, if that is ``TIMES`` as frequent;
roots follow forms by doubling steps, as each step multiplies the count.

Defined results: a null text has no words; a null id is written as nothing before
the colon of what is hashed; repeated rows count each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.common import Scratch, cut, forget, released, table

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
#: One in so many runs of letters of a document loses a letter.
ODD = 199
BLOCK = 4096
#: Masks of so many pairs are compared at once.
PAIRS = 1 << 20
#: A task sends its counts of words on when it holds so many words.
MOST_WORDS = 200_000

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Letters by how often they occur in prose, dealt to the bands in turn so that each tells words apart about as well.
_BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
BANDS = 3


def _letter_bits() -> np.ndarray:
    """The mask of each Latin-1 code point alone; band k has the bits from 21 k on."""
    bits, used = np.zeros(256, np.uint64), [0] * BANDS
    for k, c in enumerate([*map(ord, _BY_FREQUENCY), *range(0xC0, 0x100)]):
        band = k % BANDS
        bits[c] = np.uint64(1) << np.uint64(21 * band + used[band] % 21)  # those beyond share a bit
        used[band] += 1
    return bits


_BITS = _letter_bits()
_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64())])


def letter_mask(word: bytes) -> int:
    """Parities of a word's letters; the word in Latin-1."""
    return int(np.bitwise_xor.reduce(_BITS[np.frombuffer(word, np.uint8)])) if word else 0


def thinned(run: str, crc_of_id: int) -> str:
    """A run, less one letter if its checksum with its document's says so."""
    h = zlib.crc32(run.encode(), crc_of_id)
    at = h % len(run)
    return run if h % ODD else run[:at] + run[at + 1 :]


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the words of enough letters and occurrences."""

    def rows(batches):
        forget()
        seen: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                crc = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(_RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                    seen[thinned(run, crc)] += n
                if len(seen) > MOST_WORDS:
                    yield sent()
        yield sent()

    parts = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(released(rows), "word string, n long")
    return parts.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def masked(words: DataFrame) -> DataFrame:
    """``words`` (word, ...) with letters (the word in Latin-1) and mask."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in words.dtypes) + ", letters binary, mask long"
    names = [*words.columns, "letters", "mask"]
    at = words.columns.index("word")

    def rows(batches):
        for batch in batches:
            coded = [w.encode("latin-1") for w in batch.column(at).to_pylist()]
            masks = np.array([letter_mask(w) for w in coded], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary()), pa.array(masks)], names=names)

    return words.mapInArrow(released(rows), schema)


def _first_equal(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether no band before ``band`` is equal in masks a (rows) and b (columns)."""
    part = np.uint64((1 << 21) - 1)
    out = np.ones((len(a), len(b)), bool)
    for k in range(band):
        by = np.uint64(21 * k)
        out &= (a >> by & part)[:, None] != (b >> by & part)[None, :]
    return out


def _matrix(letters: pa.Array) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer(b"".join(letters.to_pylist()), np.uint8).reshape(len(letters), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b (words as code points; b as long, or longer by one) differ by exactly one edit."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return front + back >= length


def near_in(a: pa.Table, b: pa.Table, band: int) -> tuple[list, list]:
    """Rows of a and b, of words with equal bits in ``band``, that are one edit apart; words of equal length only with the smaller one first."""
    found_a, found_b = [], []
    masks_a, masks_b = (t["mask"].to_numpy().view(np.uint64) for t in (a, b))
    rows_a, own = _matrix(a["letters"]), _matrix(b["letters"])
    same = rows_a.shape[1] == own.shape[1]
    step = max(1, PAIRS // max(1, len(masks_b)))
    for at in range(0, len(masks_a), step):
        some = masks_a[at : at + step]
        close = np.bitwise_count(some[:, None] ^ masks_b[None, :]) <= 2
        if band:
            close &= _first_equal(some, masks_b, band)
        i, j = np.nonzero(close)
        each = max(1, PAIRS // rows_a.shape[1])  # rows of letters are gathered some at a time
        for k in range(0, len(i), each):
            x, y = i[k : k + each] + at, j[k : k + each]
            hit = one_edit(rows_a[x], own[y])
            x, y = x[hit], y[hit]
            if same and len(x):
                ahead = np.array([rows_a[p].tobytes() < own[q].tobytes() for p, q in zip(x, y)], bool)
                x, y = x[ahead], y[ahead]
            found_a += x.tolist()
            found_b += y.tolist()
    return found_a, found_b


def near_pairs(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(a, b, na, nb): each two words of ``words`` (word, n) one edit apart, once."""
    rows = scratch.cut(masked(words))
    bits = lambda k: F.shiftright("mask", 21 * k).bitwiseAND((1 << 21) - 1)
    banded = rows.select("word", "n", "letters", "mask", F.inline(F.array(*[F.struct(F.lit(k).alias("band"), bits(k).alias("bits")) for k in range(BANDS)])))
    key = ["band", "bits", "length"]
    kept = [*key, "word", "n", "letters", "mask"]
    dealt = lambda *less: banded.select("band", "bits", F.explode(F.array(*[F.length("letters") - x for x in less])).alias("length"), "word", "n", "letters", "mask")
    own, other = dealt(0), dealt(0, 1)
    count = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    # written first, so that Spark can split a hot key among tasks
    blocks = scratch.cut(count(own, "rows").join(count(other, "columns"), key))
    place = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = own.join(blocks, key).select(*kept, place("rows").alias("i"), every("columns").alias("j"))
    right = other.join(blocks, key).select(*kept, every("rows").alias("i"), place("columns").alias("j"))
    right = right.select(*[F.col(c).alias(f"{c}_") for c in left.columns])

    def one(keys, a: pa.Table, b: pa.Table) -> pa.Table:
        band, pieces, b = keys[0].as_py(), [], b.rename_columns(a.column_names)
        if a.num_rows and b.num_rows:
            lengths = pc.binary_length(b["letters"])
            for longer in (0, 1):
                some = b.filter(pc.equal(lengths, keys[2].as_py() + longer))
                if some.num_rows:
                    x, y = near_in(a, some, band)
                    x, y = a.take(pa.array(x, pa.int64())), some.take(pa.array(y, pa.int64()))
                    pieces.append(pa.table([x["word"], y["word"], x["n"], y["n"]], schema=_PAIRS))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(pieces) if pieces else _PAIRS.empty_table()

    group = [*key, "i", "j"]
    return left.groupBy(*group).cogroup(right.groupBy(*[f"{c}_" for c in group])).applyInArrow(one, "a string, b string, na long, nb long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), by doubling steps."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = cut(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n)."""
    words = cut(words)
    with Scratch(words.sparkSession) as scratch:
        pairs = scratch.cut(near_pairs(scratch, words))
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("na").alias("n"), F.col("nb").alias("form_n")).union(pairs.select("b", "a", "nb", "na"))
        # of words that occur as often, the smallest
        best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best")
        near = cut(both.groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")))
    rows = words.join(near, "word", "left").withColumn("chosen", F.col("form_n") >= TIMES * F.col("n"))
    rows = cut(rows.select("word", F.expr("if(chosen, form, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(chosen, form_n, null)").alias("form_n")))
    found = roots(rows.where("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return group_variants(words_of(table(spark, sf_dir, "documents")))

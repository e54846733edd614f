"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is bound from its
letters' vectors, each rotated by its place; a text is the bundle (sum) of its
n-grams' vectors; a language's prototype is the bundle of its texts' unit
vectors. A text gets the language whose prototype has the largest cosine.

The prototypes, and the floors of scores, are learned from all labelled rows;
bundling runs as a Spark aggregation and only languages x ``DIMENSIONS`` sums
reach the driver. Every text is read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is every text when nothing was learned; ties go to the language that
sorts first; a null id is not held out; repeated rows are judged each; an empty
table gives an empty table; other columns are ignored by the query and kept by
``predict``, which replaces those named like its outputs, and ``known``, which
replaces none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaza.llm.common import released, table, without, worker_memory

DIMENSIONS = 1024
NGRAM = 3
SEED = 7
MOST_NGRAMS = 40_000
UNKNOWN = "und"
FLOOR = 0.7
LEAST_FLOOR = 200


@functools.cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x40000):  # no letters are assigned beyond
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@functools.cache
def _letter_vector(letter: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, letter])).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


class _Bound:
    """Vectors of the n-grams met so far, one row each; forgotten beyond a bound."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.rows = np.zeros((1024, DIMENSIONS), np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(self.row) > MOST_NGRAMS:
            self.row.clear()
        keys = codes.tolist()
        for key in keys:
            if key not in self.row:
                at = self.row[key] = len(self.row)
                if at == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros((8192, DIMENSIONS), np.int8)])
                self.rows[at] = self._bind(key)
        return self.rows[np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))]

    @staticmethod
    def _bind(code: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for place in range(NGRAM):
            out = out * np.roll(_letter_vector(code >> 21 * place & 0x1FFFFF), place)
        return out


def _bound() -> _Bound:
    return worker_memory("bound n-grams", _Bound)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter n-grams; a border of a word counts as letter 0."""
    at = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    if not at.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], at, [0]])
    at = at[np.append(True, (at[1:] != 0) | (at[:-1] != 0))]  # one border between words
    code = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
    return np.unique(code[at[1:-1] != 0], return_counts=True)


def profile(text: str | None) -> np.ndarray | None:
    """The unit vector of a text; None if it has no letter."""
    return _profile(text)[0]


def _profile(text: str | None) -> tuple[np.ndarray | None, int]:
    """The unit vector of a text and the number of its n-grams."""
    codes, counts = ngrams(text or "")
    if not len(codes):
        return None, 0
    vector = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(codes), 1024):
        vector += counts[at : at + 1024].astype(np.float32) @ _bound()(codes[at : at + 1024]).astype(np.float32)
    norm = float(np.linalg.norm(vector))
    return (vector / norm if norm else None), int(counts.sum())


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and prototypes from all rows (id, lang, text) that have a language."""
    rows = rows.where("lang is not null")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = profile(text.as_py())
                if own is not None:
                    sums[lang] = sums.get(lang, 0) + own.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.select("lang", "text").mapInArrow(released(bundle), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in sums})
    out = np.zeros((len(langs), DIMENSIONS), np.float32)
    for r in sums:
        out[langs.index(r.lang), r.k] = r.x
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, np.divide(out, norms, out=out, where=norms > 0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", names=("lang_pred", "score", "n_ngrams")) -> DataFrame:
    """``docs`` with the language, the score and the number of n-grams under ``names``; columns of those names are replaced."""
    langs, prototypes = model
    docs = without(docs, *names)
    schema = StructType([*docs.schema.fields]).add(names[0], "string").add(names[1], "double").add(names[2], "long")

    def rows(batches):
        for batch in batches:
            said, scores, sizes = [], [], []
            for value in batch.column(batch.schema.names.index(text)):
                own, n = _profile(value.as_py()) if langs else (None, 0)
                sizes.append(n)
                if own is None:
                    said.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = prototypes @ own
                    best = int(cosines.argmax())
                    said.append(langs[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=schema.names)

    return docs.mapInArrow(released(rows), schema)


def size_class(n_ngrams: str):
    """Scores grow with the length of a text, so floors are learned by the binary logarithm of its n-grams."""
    return F.floor(F.log2(F.col(n_ngrams))).cast("int")


def floors(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> dict[int, float]:
    """For each class of sizes the score under which a text is in none of the languages.

    ``FLOOR`` times the score that all but one in a thousand of the labelled rows
    (id, lang, text) of the class reach; classes of fewer than ``LEAST_FLOOR`` rows have none.
    """
    own = predict(rows.where("lang is not null"), model).where("n_ngrams > 0")
    found = own.groupBy(size_class("n_ngrams").alias("k")).agg(F.percentile_approx("score", 0.001, 10_000).alias("low"), F.count("*").alias("n"))
    return {r.k: FLOOR * r.low for r in found.where(F.col("n") >= LEAST_FLOOR).collect()}


def known(docs: DataFrame, model: tuple[list[str], np.ndarray], floors: dict[int, float]) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages, with the columns of ``docs``."""
    names = ("_id_lang", "_id_score", "_id_ngrams")
    least = F.lit(0.0)
    for k, low in sorted(floors.items()):
        least = F.when(size_class(names[2]) == k, low).otherwise(least)
    judged = predict(docs, model, names=names)
    return judged.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """(id, lang, text) of the rows of ``docs`` that aren't held out."""
    return docs.where(~held_out()).select(F.col("doc_id").alias("id"), "lang", "text")


def learn_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes from the rows of ``docs`` that aren't held out."""
    return learn(labelled(docs))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, learn_documents(docs)).select("doc_id", "held_out", "lang_pred", "score")

"""Best-fit packing of documents into token sequences, with vector capacities.

A bin (sequence) has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces are placed in descending order of length
into the open bin that fits under every capacity and is best by the weighted
residual norm (or by the largest weighted dot product of demand and residual);
if none fits, a bin is opened.

Only documents longer than a sequence are cut. Piece lengths alone take part
in packing: pieces are dealt by hash into shards of about ``SHARD_PIECES``, each
packed by itself. A shard leaves about one bin not filled, so shards cost about
one sequence in a few thousand.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; a document of exactly one sequence is one piece; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaza.llm.common import cut, released, table
from plaza.llm.tokens import tokenizer, vocabulary_path

CAPACITY = 4096
MOST_DOCS = 4096
MOST_COST = CAPACITY * CAPACITY
WEIGHTS = (1.0, 1e-3, 1e-3)
SHARD_PIECES = 16_384
#: Words whose ids a worker keeps.
WORD_MEMORY = 250_000


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) of every document's pieces."""
    path = path or vocabulary_path()

    def cut_up(batches):
        model = tokenizer(path, WORD_MEMORY, 8 * WORD_MEMORY)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for doc, ids in zip(part.column(0).to_pylist(), model.ids(part.column(1).cast(pa.binary()).to_pylist())):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for name, value in zip(out, (doc, k, start, len(own), own.astype("<u4").tobytes())):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=ARROW)
                model.pieces.clear()  # few are met again in other words, and they take as much as the words
        model.forget()  # a worker that waits holds the model alone

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(cut_up), "doc_id long, piece int, start long, length long, ids binary")


ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def best_fit(lengths: np.ndarray, capacity=CAPACITY, most_docs=MOST_DOCS, most_cost=MOST_COST, weights=WEIGHTS, rule="norm"):
    """Bin and offset of each piece. Ties: the longer piece first, then the earlier; of equal bins the first opened."""
    limits = np.array([capacity, most_docs, most_cost], np.float64)
    scale = np.array(weights) / limits
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, 1024))
    ids = np.zeros(1024, np.int64)
    used = opened = 0
    least = float(lengths.min()) if n else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        rest = left[:, :used] - need[:, None]
        fits = (rest >= 0).all(0)
        if fits.any():
            if rule == "norm":
                score = np.where(fits, ((rest * scale[:, None]) ** 2).sum(0), np.inf)
                b = int(score.argmin())
            else:
                score = np.where(fits, (left[:, :used] * (need * scale * scale)[:, None]).sum(0), -np.inf)
                b = int(score.argmax())
        else:
            if used == len(ids):
                left, ids = np.concatenate([left, np.zeros_like(left)], 1), np.concatenate([ids, np.zeros_like(ids)])
            b, used = used, used + 1
            left[:, b], ids[b] = limits, opened
            opened += 1
        where[i], offset[i] = ids[b], capacity - left[0, b]
        left[:, b] -= need
        if left[0, b] < least or left[1, b] < 1:  # full: its place goes to the last open one
            used -= 1
            left[:, b], ids[b] = left[:, used], ids[used]
    return where, offset


def pack(rows: DataFrame, capacity=CAPACITY, most_docs=MOST_DOCS, most_cost=MOST_COST, weights=WEIGHTS, rule="norm", shard_pieces=SHARD_PIECES) -> DataFrame:
    """``rows`` (doc_id, piece, length, ...) with sequence_id and offset."""
    shards = max(1, -(-rows.count() // shard_pieces))
    schema = StructType([*rows.schema.fields])
    for name in ("sequence_id", "offset"):
        schema = schema.add(name, "long")

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offset = best_fit(shard["length"].to_numpy(), capacity, most_docs, most_cost, weights, rule)
        at = shard["_pack_shard"][0].as_py()
        return shard.drop_columns("_pack_shard").append_column("sequence_id", pa.array(bins + (at << 32))).append_column("offset", pa.array(offset))

    # all columns take part, so a repeated or null id is dealt to many shards
    dealt = rows.withColumn("_pack_shard", F.pmod(F.xxhash64(*rows.columns), F.lit(shards)))
    return dealt.groupBy("_pack_shard").applyInArrow(one, schema)


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Where each piece of ``docs`` goes; the ids themselves enter as a checksum only."""
    rows = pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(rows))


def query(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))

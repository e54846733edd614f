"""Token files compressed by a grammar of pairs (Re-Pair), shard by shard.

Documents are range-partitioned and sorted by ``doc_id``, encoded, and gathered
into shards of about ``SHARD_TOKENS`` ids. In each shard, frequent pairs of ids
are replaced by nonterminals, round after round until no pair is found
``LEAST_COUNT`` times; a rule never spans two documents. A shard is one row of a Parquet file:

    part, block     place in the order of shards
    doc_ids         its documents
    first_symbol    of each document, and one past the last
    rules           pairs, little-endian unsigned 32-bit; rule k is symbol base + k
    lengths         ids that each rule stands for, so a document or a place in it
                    is found without decoding what comes before
    symbols         little-endian, 16 or 32 bits wide (``width``)
    n_tokens        ids in the shard

Defined results: a null text is its end id alone; repeated rows are documents of
their own, in the order of doc_id (null first), then text; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.llm.common import released, shared_folder, table
from plaza.llm.tokens import tokenizer, vocabulary_path

SHARD_TOKENS = 1 << 21
BASE = 49_408
LEAST_COUNT = 16
#: Width of the hashed counts that only tell which pairs need no exact count.
BUCKET_BITS = 22
#: Places of shards are broadcast only up to this counted number (16 bytes each).
BROADCAST_SHARDS = 1_000_000


def compress(tokens: np.ndarray, starts: np.ndarray, base: int = BASE):
    """symbols, first symbol of each document (and the end), rules, ids under each rule.

    ``starts``: where documents begin; pairs across a border are never replaced.
    A round counts pairs exactly and replaces those found ``LEAST_COUNT`` times
    or more, the most frequent first where occurrences overlap; rounds go on
    until no pair is found so often.
    """
    seq = tokens.astype(np.int32)
    first = np.append(starts, len(seq)).astype(np.int64)
    rules = [np.zeros((0, 2), np.int32)]
    n_rules = 0
    begins = np.zeros(len(seq) + 1, bool)
    begins[first] = True
    alive = ~begins[1:]  # places whose pair may be frequent; the last of a document has none
    while True:
        hit, rank, pair = _frequent(seq, np.flatnonzero(alive))
        if not len(hit):
            break
        chosen, number, taken = _chosen(hit, rank, len(pair))
        alive = np.zeros(len(seq), bool)
        alive[hit] = True  # what is left of a frequent pair; any other old pair only gets rarer
        seq[chosen] = base + n_rules + number
        alive[chosen] = True
        alive[chosen[chosen > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq, alive = seq[keep], alive[keep]
        begins = np.append(begins[:-1][keep], True)
        alive &= ~begins[1:]
        first = first - np.searchsorted(chosen + 1, first)
        rules.append(pair[taken])
        n_rules += len(taken)
    rules = np.concatenate(rules)
    _, lengths = expansions(rules, base)
    return seq, first, rules, lengths


def _frequent(seq: np.ndarray, at: np.ndarray):
    """Places of the pairs found ``LEAST_COUNT`` times among ``at`` (all places of pairs that may be), the rank of each one's pair, and the pairs by rank."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int32)
    bits = min(BUCKET_BITS, max(10, len(at).bit_length() + 1))
    bucket = seq[at].view(np.uint32) * np.uint32(0x9E3779B1)
    bucket += seq[at + 1].view(np.uint32) * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - bits)
    at = at[(np.bincount(bucket, minlength=1 << bits) >= LEAST_COUNT)[bucket]]  # a pair is not more frequent than its bucket
    if not len(at):
        return none
    a, b = seq[at], seq[at + 1]
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    of = np.empty(len(at), np.int64)
    of[order] = np.cumsum(new) - 1
    key = key[new]
    # of x x x, one x x counts: every other one from the left
    same = np.flatnonzero(a == b)
    run = np.flatnonzero(np.diff(at[same], prepend=-2) > 1)
    odd = (np.arange(len(same)) - np.repeat(run, np.diff(np.append(run, len(same))))) % 2 == 1
    counts = np.bincount(of, minlength=len(key)) - np.bincount(of[same[odd]], minlength=len(key))
    # equal counts in hashed order, so that long passages found equally often shrink by halves
    best = np.lexsort((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), -counts))
    best = best[: int((counts >= LEAST_COUNT).sum())]
    rank_of = np.full(len(key), -1)
    rank_of[best] = np.arange(len(best))
    rank = rank_of[of]
    own = rank >= 0
    key = key[best]
    return at[own], rank[own], np.stack([key >> 32, key & 0xFFFFFFFF], 1).astype(np.int32)


def _chosen(hit: np.ndarray, rank: np.ndarray, n: int):
    """The places replaced, the number of each one's rule, and the ranks that become rules.

    A place is taken unless one of a better rank, or of the same rank to the left,
    that overlaps it is. Ranks left with fewer than ``LEAST_COUNT`` places give
    theirs up. The best rank never is, so there always is a rule.
    """
    while True:
        near = np.diff(hit) == 1
        left = np.append(False, near & (rank[:-1] <= rank[1:]))
        right = np.append(near & (rank[1:] < rank[:-1]), False)
        # how far the best place in reach is, going up on the left and on the right
        place = np.arange(len(hit), dtype=np.int32)
        up = place - np.maximum.accumulate(np.where(left, 0, place))
        down = np.minimum.accumulate(np.where(right, len(hit), place)[::-1])[::-1] - place
        taken = (up | down) % 2 == 0
        counts = np.bincount(rank[taken], minlength=n)
        enough = counts >= LEAST_COUNT
        stay = enough[rank]
        if stay.all():
            number = np.cumsum(enough) - 1
            return hit[taken], number[rank[taken]], np.flatnonzero(enough)
        hit, rank = hit[stay], rank[stay]


def expansions(rules: np.ndarray, base: int = BASE):
    """The ids under each rule in one array, and how many each has."""
    own: list[np.ndarray] = []
    side = lambda s: own[s - base] if s >= base else np.array([s], np.uint32)
    for left, right in rules.tolist():
        own.append(np.concatenate([side(left), side(right)]))
    lengths = np.array([len(x) for x in own], np.int64)
    return (np.concatenate(own) if own else np.zeros(0, np.uint32)), lengths


class Shard:
    """Random access to the documents of one stored shard."""

    def __init__(self, row: dict, base: int = BASE):
        self.base = base
        self.doc_ids = row["doc_ids"]
        self.first = np.frombuffer(row["first_symbol"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width'] // 8}").astype(np.int32)
        self.flat, _ = expansions(np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64), base)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int32)
        self.begin = np.cumsum(self.lengths, dtype=np.int32) - self.lengths

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int32)
        own = np.flatnonzero(symbols >= self.base)
        out[own] = self.lengths[symbols[own] - self.base]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document."""
        return self.decode(self.symbols[self.first[k] : self.first[k + 1]])

    def documents(self) -> list[np.ndarray]:
        """The ids of every document, decoded together."""
        ids = self.decode(self.symbols)
        at = np.append(0, np.cumsum(self._lengths(self.symbols), dtype=np.int64))[self.first]
        return [ids[s:e] for s, e in zip(at[:-1], at[1:])]

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        counts = self._lengths(symbols)
        out = np.repeat(symbols.astype(np.uint32), counts)
        own = np.flatnonzero(symbols >= self.base)
        ends = np.cumsum(counts, dtype=np.int32)[own]
        counts = counts[own]
        # places that rules fill, and where their ids lie in ``flat``
        inside = np.repeat(ends - np.cumsum(counts, dtype=np.int32), counts)
        inside += np.arange(len(inside), dtype=np.int32)
        source = np.repeat(self.begin[symbols[own] - self.base] - ends + counts, counts)
        source += inside
        out[inside] = self.flat[source]
        return out

    def token_at(self, k: int, place: int) -> int:
        """Id ``place`` of the k-th document, by expansion lengths, without decoding the rest."""
        symbols = self.symbols[self.first[k] : self.first[k + 1]]
        ends = np.cumsum(self._lengths(symbols))
        at = int(np.searchsorted(ends, place, side="right"))
        return int(self.decode(symbols[at : at + 1])[place - (int(ends[at - 1]) if at else 0)])


FILE = "part int, block int, doc_ids array<long>, first_symbol binary, rules binary, lengths binary, symbols binary, width int, n_tokens long"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("first_symbol", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` and write the shards to ``folder``, in ascending order of doc_id."""
    path = path or vocabulary_path()

    def shards(batches):
        model, part, block = tokenizer(path), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, own in zip(piece.column(0).to_pylist(), model.ids(piece.column(1).cast(pa.binary()).to_pylist())):
                    ids.append(doc)
                    held.append(own)
                    size += len(own)
                    if size >= shard_tokens:
                        yield _shard(part, block, ids, held)
                        ids, held, size, block = [], [], 0, block + 1
        if held:
            yield _shard(part, block, ids, held)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(released(shards), FILE).write.parquet(folder)


def _shard(part, block, doc_ids, held) -> pa.RecordBatch:
    counts = np.array([len(x) for x in held])
    symbols, first, rules, lengths = compress(np.concatenate(held), np.cumsum(counts) - counts)
    width = 16 if BASE + len(rules) <= 1 << 16 else 32
    row = {
        "part": part, "block": block, "doc_ids": doc_ids, "first_symbol": first.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width // 8}").tobytes(), "width": width, "n_tokens": int(counts.sum()),
    }
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def read_tokens(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document of the files in ``folder``.

    Not ``whole``: the decoded ids are left out, and ids_crc32 is their checksum.

    ``start`` is summed in two levels: over the shards of a part, and over the parts.
    """

    last = "ids" if whole else "ids_crc32"

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, at = Shard(row), 0
                texts = shard.documents()
                for low in range(0, len(texts), 256):
                    out = []
                    for k, ids in enumerate(texts[low : low + 256], low):
                        out.append((row["part"], row["block"], shard.doc_ids[k], at, len(ids), ids.astype("<u4").tobytes() if whole else zlib.crc32(ids.astype("<u4"))))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if whole else pa.int64()))], names=["part", "block", "doc_id", "inside", "n_tokens", last])

    files = spark.read.schema(FILE).parquet(folder)
    sizes = files.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    blocks = sizes.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("before_block"))
    few = sizes.count() <= BROADCAST_SHARDS
    base = blocks.join(before, "part").select("part", "block", (F.col("before_part") + F.col("before_block")).alias("before"))
    docs = files.mapInArrow(released(decode), "part int, block int, doc_id long, inside long, n_tokens long, " + ("ids binary" if whole else "ids_crc32 long"))
    return docs.join(F.broadcast(base) if few else base, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", last)


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_tokens, n_symbols and n_rules of the files in ``folder``, and ratio: their bytes to four a token."""
    held = [F.octet_length(c) for c in ("symbols", "rules", "lengths", "first_symbol")]
    rows = spark.read.schema(FILE).parquet(folder)
    own = rows.agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.expr("octet_length(symbols) * 8 div width")).alias("n_symbols"), F.sum(F.expr("octet_length(lengths) div 4")).alias("n_rules"), F.sum(sum(held[1:], held[0])).alias("bytes"))
    return own.select("n_tokens", "n_symbols", "n_rules", (F.col("bytes") / (4 * F.col("n_tokens"))).alias("ratio"))


def query(spark, sf_dir):
    folder = f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, whole=False)

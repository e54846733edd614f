"""Encoding and decoding with a SentencePiece vocabulary, as a relational lattice.

A text is cut into words where no piece of the vocabulary spans the border, so
a word's pieces don't depend on its neighbours. Texts are laid out in blocks: a
block's distinct words once, and for each text the numbers of its words. Then

1. the distinct words of all blocks explode into substrings of two characters
   and of those lengths that pieces with the same three first characters have,
2. an equi-join with the piece table (broadcast: its rows are the vocabulary's)
   keeps the substrings that are pieces, the edges of the lattice,
3. edges are grouped by word, and Spark's ``aggregate`` folds over them,
4. each block gets its words' ids and spells out its texts: the ids of the
   ``COMMON`` words found in most blocks are broadcast, those of the others joined
   to their blocks. The table of blocks is bucketed by block, so only ids move.

The tables of blocks and of spelt words stay in the shared folder, as a
checkpoint does, because the result is read from them.

The folds: a unigram vocabulary is folded as Viterbi (``unigram=True``). The
public vocabulary is a byte-pair one whose scores are ranks of merges; the path
with the best sum of scores is not what its library gives. Its edges are folded
in the order of their scores: an edge joins two neighbours if both its ends are
still borders and exactly one border stands inside. One pass gives what merging
step by step gives if every piece, spelt by itself, ends as itself through edges
of better scores only: a region that ends as a piece then does so before worse
edges are looked at. ``Vocabulary.odd`` holds the pieces for which this isn't so
(runs of spaces, all of one score); words that hold one of them, and words over
``LONG`` characters, whose borders don't fit a number of 64 bits, are merged with
a heap instead, or for a unigram vocabulary searched by a linear Viterbi.

Borders that stay around one character need no edge: its id is looked up, and
characters without a piece become byte pieces. Defined results: a null or empty
text has no ids; repeated rows are encoded each; an empty table gives an empty
table; other columns are ignored. A text that holds the mark of a space itself
is not given back as it was.
"""

from __future__ import annotations

import collections
import heapq
import itertools
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from plaza.llm.common import Scratch, forget, released, shared_folder, table, worker_memory

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Longest word of the relational lattice: its borders are the bits of one number.
LONG = 60
#: A block is closed after so many characters, or so many distinct words.
BLOCK_CHARS = 1 << 22
BLOCK_WORDS = 100_000
#: At most so many words, those in most blocks, reach every worker with their ids (about 30 bytes each); the others are joined.
COMMON = 200_000
#: Words of texts that are spelt out at once.
SLICE_WORDS = 100_000
#: Bits of an edge's number: rank, then start, length and id. A character without a piece has the greatest id.
ID_BITS, PLACE_BITS = 20, 6
NO_ID = (1 << ID_BITS) - 1


@dataclass
class Vocabulary:
    pieces: list[tuple[str, int, float]]  # ordinary pieces
    first_byte: int
    names: list[bytes | None]  # bytes of every id; None for control ids

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids]
        names = [None if odd[i] else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in ids if not odd[i] and not sp.is_byte(i)]
        return cls(plain, next(i for i in ids if sp.is_byte(i)), names)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    def frame(self, spark: SparkSession) -> DataFrame:
        """sub, id, score and rank (0 for the best score) of the ordinary pieces."""
        ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return spark.createDataFrame([(p, i, s, ranks[s]) for p, i, s in self.pieces], "sub string, id int, score double, rank int")

    def heads(self, spark: SparkSession, shortest: int) -> DataFrame:
        """head (three characters) and ks: ``shortest`` to two, and the lengths of the pieces that begin so."""
        found = collections.defaultdict(set)
        for p, _, _ in self.pieces:
            if len(p) > 2:
                found[p[:3]].add(len(p))
        return spark.createDataFrame([(h, [*range(shortest, 3), *sorted(ks)]) for h, ks in found.items()], "head string, ks array<int>")

    def odd(self) -> set[str]:
        """Pieces that one pass over better edges doesn't spell as themselves, or that share a score; of these, those that hold no other."""
        scores = {p: s for p, _, s in self.pieces}
        times = collections.Counter(s for p, s in scores.items() if len(p) > 1)
        own = {p for p, s in scores.items() if len(p) > 1 and (times[s] > 1 or one_pass(p, scores) != [p])}
        return {p for p in own if not any(p[a:b] in own for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p))}

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character of the vocabulary, and which pairs of them stand together in a piece."""
        chars = sorted({c for p, _, _ in self.pieces for c in p})
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = np.zeros((len(chars) + 1,) * 2, bool)
        for p, _, _ in self.pieces:
            codes = number[[ord(c) for c in p]]
            pairs[codes[:-1], codes[1:]] = True
        return number, pairs


def words_of(text: str, number: np.ndarray, pairs: np.ndarray) -> list[str]:
    """A text with its spaces marked, cut wherever no piece spans the border."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    codes = number[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
    borders = (np.flatnonzero(~pairs[codes[:-1], codes[1:]]) + 1).tolist()
    return [marked[a:b] for a, b in itertools.pairwise([0, *borders, len(marked)])]


def _numbered() -> collections.defaultdict:
    """A dictionary that numbers its keys as they are met."""
    seen = collections.defaultdict(int)
    seen.default_factory = seen.__len__
    return seen


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte by byte: their first bytes, their second ones and so on."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def merged(word: str, scores: dict[str, float]) -> list[str]:
    """The symbols of a word after all merges, best score first, with a heap."""
    text, after = list(word), list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < len(text) and (s := scores.get(text[i] + text[j])) is not None:
            heapq.heappush(heap, (-s, i, text[i] + text[j]))

    for i in range(len(text) - 1):
        offer(i)
    while heap:
        _, i, joint = heapq.heappop(heap)
        j = after[i] if text[i] else len(text)
        if j >= len(text) or text[i] + text[j] != joint:
            continue
        text[i], text[j], after[i] = joint, "", after[j]
        if after[j] < len(text):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in text if t]


def one_pass(word: str, scores: dict[str, float]) -> list[str]:
    """What ``fold_merges`` gives, of the edges no worse than the word itself."""
    least = scores.get(word, float("-inf"))
    own = sorted((-x, s, e) for s in range(len(word)) for e in range(s + 2, len(word) + 1) if (x := scores.get(word[s:e])) is not None and x >= least)
    borders = set(range(len(word) + 1))
    for _, s, e in own:
        inner = borders & set(range(s + 1, e))
        if s in borders and e in borders and len(inner) == 1:
            borders -= inner
    return [word[a:b] for a, b in itertools.pairwise(sorted(borders))]


def blocks_of(docs: DataFrame, vocabulary: Vocabulary, block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, doc_ids, crcs (of the texts), layout (compressed numbers of the words of each text), words."""
    number, pairs = vocabulary.spans()

    def lay_out(batches):
        forget()
        part, k = TaskContext.get().partitionId(), 0
        ids, crcs, sizes, numbers, seen, chars = [], [], [], [], _numbered(), 0

        def row():
            flat = np.concatenate([np.array(sizes, np.uint32), *numbers])
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([ids], pa.list_(pa.int64())), pa.array([crcs], pa.list_(pa.int64())), pa.array([_packed(flat)], pa.binary()), pa.array([list(seen)], pa.list_(pa.string()))], names=["block", "doc_ids", "crcs", "layout", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc)
                crcs.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                own = words_of(text, number, pairs)
                sizes.append(len(own))
                numbers.append(np.fromiter(map(seen.__getitem__, own), np.uint32, len(own)))
                chars += len(text) + bool(text)
                if chars >= block_chars or len(seen) >= block_words:
                    yield row()
                    ids, crcs, sizes, numbers, seen, chars, k = [], [], [], [], _numbered(), 0, k + 1
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(released(lay_out), "block long, doc_ids array<long>, crcs array<long>, layout binary, words array<string>")


def substrings(words: DataFrame, vocabulary: Vocabulary, shortest: int = 2) -> DataFrame:
    """``words`` with s, k, sub: the substrings of at least ``shortest`` characters that may be pieces by their heads, and each word's first character."""
    starts = words.select("*", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("s"))
    met = starts.join(F.broadcast(vocabulary.heads(words.sparkSession, shortest)), F.substr("word", F.col("s") + 1, F.lit(3)) == F.col("head"), "left")
    ks = F.coalesce("ks", F.array(*map(F.lit, range(shortest, 3))))
    ks = F.when(F.col("s") > 0, ks).otherwise(F.array_union(F.array(F.lit(1)), ks))
    found = met.select(*words.columns, "s", F.explode(ks).alias("k")).where(F.col("s") + F.col("k") <= F.char_length("word"))
    return found.withColumn("sub", F.substr("word", F.col("s") + 1, F.col("k")))


def edges(words: DataFrame, vocabulary: Vocabulary, shortest: int = 2) -> DataFrame:
    """``words`` with s, k, id, score, rank: those substrings that are pieces; each word's first character also if it is none (nulls), so that no word is lost."""
    found = substrings(words, vocabulary, shortest).join(F.broadcast(vocabulary.frame(words.sparkSession)), "sub", "left").where("id is not null or k = 1")
    return found.select(*words.columns, "s", "k", "id", "score", "rank")


def _edge(rank: Column, s: Column, length: Column, id_: Column) -> Column:
    """An edge as one number; numbers sort by rank, then start."""
    place = (rank.cast("long") * (1 << PLACE_BITS) + s) * (1 << PLACE_BITS) + length
    return place * (1 << ID_BITS) + id_


def _start(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS + PLACE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _length(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _ends(edge: Column) -> Column:
    return _bit(_start(edge)) + _bit(_start(edge) + _length(edge))


def _span(edge: Column) -> Column:
    """The bits of an edge's ends and all between."""
    return _bit(_start(edge) + _length(edge) + 1) - _bit(_start(edge))


def fold_merges(numbers: Column, length: Column) -> Column:
    """Borders of a word, as bits, after folding over its edges in order; an edge that joins two neighbours drops the border between them."""

    def step(borders, edge):
        met = borders.bitwiseAND(_span(edge))
        joins = (F.bit_count(met) == 3) & (met.bitwiseAND(_ends(edge)) == _ends(edge))
        return F.when(joins, borders - met + _ends(edge)).otherwise(borders)

    return F.aggregate(numbers, _bit(length + 1) - 1, step)


def _stand(numbers: Column, borders: Column, word: Column, singles: dict[str, int]) -> Column:
    """The edges and single characters between neighbouring borders, in order of their starts: start and id as one number."""
    own = F.filter(numbers, lambda x: borders.bitwiseAND(_span(x)) == _ends(x))
    own = F.transform(own, lambda x: _start(x) * (1 << ID_BITS) + x.bitwiseAND(F.lit(NO_ID)).cast("int"))
    at = F.filter(F.sequence(F.lit(0), F.char_length(word) - 1), lambda s: F.call_function("shiftright", borders, s).bitwiseAND(F.lit(3)) == 3)
    chars, ids = F.lit("".join(singles)), F.expr(f"array({', '.join(map(str, [NO_ID, *singles.values()]))})")
    alone = F.transform(at, lambda s: s * (1 << ID_BITS) + F.element_at(ids, F.call_function("locate", F.substr(word, s + 1, F.lit(1)), chars) + 1))
    return F.sort_array(F.concat(own, alone))


def viterbi(word: str, scores: dict[str, float], longest: int, unknown: float = -100.0) -> list[str]:
    """What ``fold_viterbi`` gives, in time linear in the word: of equal sums the path whose borders are greatest, from the left."""
    best, back = [0.0], [[]]
    for at in range(1, len(word) + 1):
        ways = [(best[s] + scores[word[s:at]], s) for s in range(max(0, at - longest), at) if word[s:at] in scores]
        ways.append((best[at - 1] + unknown, at - 1))
        best.append(max(ways)[0])
        back.append([s for sum_, s in ways if sum_ == best[-1]])
    # of the borders that lead to the end, the greatest that each leads on to
    after = {len(word): None}
    for at in range(len(word), 0, -1):
        if at in after:
            for s in back[at]:
                after.setdefault(s, at)
    out, at = [], 0
    while at < len(word):
        out.append(word[at : after[at]])
        at = after[at]
    return out


def fold_viterbi(steps: Column, lattice: Column, unknown: float = -100.0) -> Column:
    """Borders of the path with the best sum of scores over edges (s, e, score); a character that no piece holds costs ``unknown``."""
    start = F.array(F.struct(F.lit(0.0).alias("best"), F.array(F.lit(0)).alias("path")))

    def step(acc, at):
        back = lambda s, score: F.struct((F.element_at(acc, s + 1)["best"] + score).alias("best"), F.array_append(F.element_at(acc, s + 1)["path"], at).alias("path"))
        known = F.transform(F.filter(lattice, lambda x: x["e"] == at), lambda x: back(x["s"], x["score"]))
        return F.array_append(acc, F.array_max(F.array_append(known, back(at - 1, F.lit(unknown)))))

    ends = F.sequence(F.lit(1), F.size(steps) + 1)
    return F.element_at(F.aggregate(ends, start, step), -1)["path"]


def spell(words: DataFrame, vocabulary: Vocabulary, unigram: bool = False) -> DataFrame:
    """``words`` with ids: the lattice of each of the distinct words (of at most LONG characters), folded."""
    kept = words.columns
    found = edges(words, vocabulary, 1 if unigram else 2)
    number = _edge(F.col("rank"), F.col("s"), F.col("k"), F.col("id"))
    collect = [F.collect_list(F.when(F.col("k") > 1, number)).alias("edges")]
    if unigram:
        collect.append(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("s", (F.col("s") + F.col("k")).alias("e"), "score"))).alias("lattice"))
    # words start alike, so rows are sorted by a number before the word itself
    rows = found.groupBy(F.xxhash64("word").alias("h"), *kept).agg(*collect)
    rows = rows.withColumn("edges", F.sort_array("edges"))
    if unigram:
        steps = F.slice(F.sequence(F.lit(1), F.char_length("word")), F.lit(2), F.char_length("word"))
        path = fold_viterbi(steps, F.col("lattice"))
        rows = rows.withColumn("borders", F.aggregate(path, F.lit(0).cast("long"), lambda acc, at: acc + _bit(at)))
    else:
        rows = rows.withColumn("borders", fold_merges(F.col("edges"), F.char_length("word")))

    def bytes_at(s):
        raw = F.encode(F.substr(F.col("word"), s + 1, F.lit(1)), "UTF-8")
        return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda k: F.conv(F.hex(F.substr(raw, k, F.lit(1))), 16, 10).cast("int") + vocabulary.first_byte)

    stand = _stand(F.col("edges"), F.col("borders"), F.col("word"), {p: i for p, i, _ in sorted(vocabulary.pieces, key=lambda x: -x[2]) if len(p) == 1})
    ids = lambda x: x.bitwiseAND(F.lit(NO_ID))
    rows = rows.select(*kept, stand.alias("stand"))
    spelt = F.flatten(F.transform("stand", lambda x: F.when(ids(x) == NO_ID, bytes_at(F.shiftright(x, ID_BITS))).otherwise(F.array(ids(x)))))
    return rows.select(*kept, F.when(F.exists("stand", lambda x: ids(x) == NO_ID), spelt).otherwise(F.transform("stand", ids)).alias("ids"))


ENCODED = "doc_id long, ids binary, text_crc32 long"


def encode(docs: DataFrame, path: str | None = None, unigram: bool = False, then=None, schema: str = ENCODED) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and text_crc32 (of the source, in UTF-8) of every row of ``docs``.

    With ``then``, what this function over Arrow batches makes of them, of type
    ``schema``; it runs in the same worker processes.
    """
    vocabulary = Vocabulary.load(path or public_tokenizers.path(MODEL))
    spark = docs.sparkSession
    # with fewer buckets than a shuffle has partitions, Spark would deal out whole blocks anew for the join
    blocks = _bucketed(blocks_of(docs, vocabulary), max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    placed = blocks.select("block", F.posexplode("words").alias("k", "word"))
    words = placed.groupBy("word").agg(F.count("*").alias("times"))
    plain = F.char_length("word") <= LONG
    for piece in sorted(vocabulary.odd() if not unigram else ()):
        plain = plain & ~F.contains("word", F.lit(piece))
    long = words.where(~plain).select("times", "word")
    stay = Scratch(spark)
    spelt = stay.cut(spell(words.where(plain), vocabulary, unigram).unionByName(_long(long, vocabulary, unigram)))
    common = stay.cut(spelt.where(F.col("times") >= _least_times(spelt.groupBy("times").agg(F.count("*").alias("words")))))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, common.select("word", "ids").toArrow().combine_chunks()))
    common, spelt = common.select("word"), spelt.select("word", "ids")
    rare = placed.join(F.broadcast(common), "word", "left_anti").join(spelt, "word")
    known = rare.groupBy("block").agg(F.collect_list(F.struct("k", "ids")).alias("spelt"))
    rows = blocks.select("block", "doc_ids", "crcs", "layout", "words").join(known, "block", "left")
    rows = rows.select("doc_ids", "crcs", "layout", "words", F.col("spelt.k").alias("k"), F.col("spelt.ids").alias("ids"))
    return rows.mapInArrow(released(lambda batches: then(_assemble(batches, shared)) if then else _assemble(batches, shared)), schema)


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """``blocks`` written to the shared folder in buckets, so that a join by block doesn't move them."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _least_times(times: DataFrame, most: int = COMMON) -> int:
    """The least number of blocks from which on a word is common, so that at most ``most`` words are."""
    above = F.sum("words").over(Window.orderBy(F.desc("times")))  # one row for each number of blocks
    found = times.where("times > 1").withColumn("above", above).where(F.col("above") <= most).agg(F.min("times")).first()[0]
    return found or (1 << 40)


def _long(words: DataFrame, vocabulary: Vocabulary, unigram: bool = False) -> DataFrame:
    """``words`` (whose last column is word) with ids, each spelt by itself."""
    scores = {p: s for p, _, s in vocabulary.pieces}
    number = {p: i for p, i, _ in vocabulary.pieces}
    first, longest = vocabulary.first_byte, vocabulary.longest
    schema = StructType([*words.schema.fields]).add("ids", ArrayType(IntegerType()))

    def rows(batches):
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_pylist()
            ids = [[i for t in (viterbi(w, scores, longest) if unigram else merged(w, scores)) for i in ([number[t]] if t in number else [first + b for b in t.encode()])] for w in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return words.mapInArrow(released(rows), schema)


class _Common:
    """Ids of the common words, end to end, and where those of each word are."""

    def __init__(self, words: pa.Table):
        lists = words["ids"].combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
        self.flat = pc.list_flatten(lists).to_numpy()
        self.count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.at = np.cumsum(self.count) - self.count
        self.number = {w: k for k, w in enumerate(words["word"].to_pylist())}


def _assemble(batches, shared):
    key, words = shared.value
    common = worker_memory(("common words", key), lambda: _Common(words))
    for batch in batches:
        for doc_ids, crcs, layout, own_words, k, ids in zip(*batch.columns):
            flat = _unpacked(layout.as_py())
            n = len(doc_ids)
            ends = np.append(0, np.cumsum(flat[:n], dtype=np.int64))
            numbers = flat[n:]
            spelt = ids.values if ids.is_valid else pa.array([], pa.list_(pa.int32()))
            lists = np.concatenate([common.flat, pc.list_flatten(spelt).to_numpy()])
            rare = pc.list_value_length(spelt).to_numpy().astype(np.int64)
            which = np.fromiter((common.number.get(w, -1) for w in own_words.values.to_pylist()), np.int64, len(own_words.values))
            start, counts = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
            met = which >= 0
            start[met], counts[met] = common.at[which[met]], common.count[which[met]]
            if k.is_valid:
                places = k.values.to_numpy()
                start[places], counts[places] = len(common.flat) + np.cumsum(rare) - rare, rare
            low = 0
            while low < n:  # as many texts at once as have about SLICE_WORDS words
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_WORDS, side="right")) - 1)
                out = _gathered(lists, start, counts, numbers[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
                yield pa.RecordBatch.from_arrays([doc_ids.values.slice(low, high - low), pa.array(out, pa.binary()), crcs.values.slice(low, high - low)], names=["doc_id", "ids", "text_crc32"])
                low = high


def _gathered(lists: np.ndarray, start: np.ndarray, counts: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of the words ``numbers``, of each text whose words end at ``ends``."""
    own = counts[numbers]
    stops = np.cumsum(own)
    total = int(stops[-1]) if len(stops) else 0
    ids = lists[np.repeat(start[numbers] - stops + own, own) + np.arange(total)].astype("<u4")
    at = np.append(0, stops)[ends]
    return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def _decoder(path: str):
    """A function from a list of ids (binary) to their texts; bytes that aren't UTF-8 are replaced."""
    names = pa.array([n or b"" for n in Vocabulary.load(path).names], pa.large_binary())

    def spell_out(ids: list[bytes]) -> list[str]:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        taken = names.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(taken) else [0] * len(ends)
        data = memoryview(taken.buffers()[2] or b"")
        return [str(data[a:b], "utf-8", "replace").removeprefix(" ") for a, b in itertools.pairwise(at)]

    return spell_out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that aren't UTF-8 are replaced."""
    spell_out = _decoder(path or public_tokenizers.path(MODEL))

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spell_out(batch.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(rows), "doc_id long, text string")


def query(spark, sf_dir):
    """Ids of every document as a checksum, and whether the text decoded from them is the source."""
    spell_out = _decoder(public_tokenizers.path(MODEL))

    def digest(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in spell_out(raw)]
            intact = pa.array([a == b for a, b in zip(texts, batch.column(2).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(texts, pa.int64()), intact], names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "intact"])

    return encode(table(spark, sf_dir, "documents"), then=digest, schema="doc_id long, n_ids long, ids_crc32 long, text_crc32 long, intact boolean")

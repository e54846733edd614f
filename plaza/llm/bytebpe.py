"""Byte-level BPE encoding and decoding of whole texts, by the ranks of a vocabulary file.

A text is cut by the vocabulary's pattern. Ids of a word are found by a fold of
Spark's higher-order functions over its bytes: each step replaces the leftmost
pair of least rank, and ranks the two pairs that it touches anew. Ranks come
from a literal map of pairs, dealt to buckets of a literal array by hash. As a
rank is the id of the join, the parts and the ranks of a word are two strings of
one character an id, which Spark's string functions search and replace; the ranks
of neighbouring bytes come with the word. An entry of the vocabulary that merges
don't lead to is looked up as a whole.

Common words are folded once: those found most often in about ``COUNTED`` rows, at
most ``COMMON`` of them, are folded first and their ids sent to the tasks that cut
the texts (broadcast, so of bounded size); all other words are folded where they
stand, once for each text. No text, word or id of the second kind is shuffled.
A word of more than ``LONG`` bytes, whose fold would take time by the square, is
merged in Python by a heap, with the same ids.

Decoding looks each id's bytes up and joins them; an id that the vocabulary lacks
fails the job.

The pattern's letters and numbers are those of the installed library, whose
Unicode may be older than the splitter's: characters that it doesn't know are
found by asking it, and are then neither letter nor number here.

Defined results: a null text is empty, and an empty text has no ids; repeated rows
are encoded each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.chat import bind
from plaza.llm.common import cut, released, table, worker_memory

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids are broadcast: at most so many, of at most ``LONG`` bytes each.
COMMON = 250_000
LONG = 64
#: Rows whose words are counted to choose the common ones; ids don't depend on that choice.
COUNTED = 100_000
#: Buckets of the literal map.
BUCKETS = 1 << 14
#: A task sends its counts of words on when it holds so many words.
MOST_WORDS = 100_000
#: Texts are sent on when they have so many bytes together.
MOST_BYTES = 1 << 20


def ranks_path(name: str = RANKS) -> str:
    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


# --- cutting -------------------------------------------------------------------


def _ranges(chars: list[str]) -> str:
    """Characters in order, as the inside of a character class."""
    starts = [c for k, c in enumerate(chars) if not k or ord(chars[k - 1]) + 1 < ord(c)]
    ends = [c for k, c in enumerate(chars) if k + 1 == len(chars) or ord(c) + 1 < ord(chars[k + 1])]
    return "".join(f"{a}-{b}" for a, b in zip(starts, ends))


def _unknown(kind: str, pattern: str) -> str:
    """Characters (as ranges) of a class that the installed library doesn't count to it; among those that Python's own tables lack."""
    unassigned = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
    late = regex.findall(kind, unassigned)
    lead = "a" if kind == r"\p{L}" else "1"
    ranks = {bytes([b]): b for b in range(256)} | {(lead + c).encode(): 256 + k for k, c in enumerate(late)}
    ask = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ranges([c for c in late if len(ask.encode_ordinary(lead + c)) > 1])


#: The pattern of the vocabulary files in terms of Python's own classes, which are the library's but for some characters (``_odd``).
_QUICK = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def _odd() -> str:
    """A class of characters that Python may take for another kind than the library: numbers that are no digits, separators among the controls, unassigned ones, and to be quick all beyond the basic plane."""
    chars = map(chr, [*range(0xD800), *range(0xE000, 0x10000)])
    return "[" + _ranges([c for c in chars if "\x1c" <= c <= "\x1f" or unicodedata.category(c) in ("Nl", "No", "Cn")]) + "\U00010000-\U0010ffff]"


@functools.cache
def patterns(pattern: str = public_tokenizers.PATTERN) -> tuple[str, str, str]:
    """A quick pattern of Python's; a class of the characters for which it can't be used; the pattern for texts that have some."""
    exact = pattern
    for kind in (r"\p{L}", r"\p{N}"):
        if unknown := _unknown(kind, pattern):
            exact = exact.replace(kind, f"[{kind}--[{unknown}]]")
    return (_QUICK, _odd(), "(?V1)" + exact) if pattern == public_tokenizers.PATTERN else (pattern, r"[\s\S]", "(?V1)" + exact)


class Cutter:
    """Cuts texts as the installed library does."""

    def __init__(self, quick: str, odd: str, exact: str):
        self.quick, self.odd, self.exact = re.compile(quick).findall, re.compile(odd).search, exact

    def __call__(self, text: str) -> list[str]:
        return regex.findall(self.exact, text) if self.odd(text) else self.quick(text)


# --- ids of a word -------------------------------------------------------------

#: Ids and ranks as single characters, so that arrays of them are strings: those from 256 on, without surrogates. No rank is greater than ``NEVER``.
_FIRST, _SURROGATES = 256, range(0xD800, 0xE000)
NEVER = chr(0x10FFFF)
#: Stands before the first and after the last part of a word.
EDGE = " "


def id_letter(i: int) -> str:
    return chr(i + _FIRST if i + _FIRST < _SURROGATES.start else i + _FIRST + len(_SURROGATES))


def _id(letter: Column) -> Column:
    code = F.ascii(letter)
    return F.when(code < _SURROGATES.start, code - _FIRST).otherwise(code - _FIRST - len(_SURROGATES))


class Merges:
    """Columns made of a vocabulary's ranks: ``maps``, a literal array of maps from a pair of ids to that of their join."""

    def __init__(self, ranks: dict[bytes, int]):
        buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
        for word, rank in ranks.items():
            for at in range(1, len(word)):
                if word[:at] in ranks and word[at:] in ranks:
                    pair = id_letter(ranks[word[:at]]) + id_letter(ranks[word[at:]])
                    buckets[crc32(pair.encode()) % BUCKETS][pair] = id_letter(rank)
        # a constant expression: the optimizer evaluates it once and keeps the value
        self.maps = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,string>>")

    def ids(self, words: Column) -> Column:
        """The ids (array<int>) of each word of an array of words as ``Starts`` gives them."""
        return bind(self.maps, lambda maps: F.transform(words, lambda word: _folded(word["parts"], word["ranks"], maps)))


def _folded(parts: Column, ranks: Column, maps: Column) -> Column:
    def step(s):
        return F.when(s["least"] == NEVER, s).otherwise(bind(F.instr(s["ranks"], s["least"]), lambda at: merge(s["parts"], s["ranks"], s["least"], at)))

    def merge(parts, ranks, join, at):
        before = _joined(maps, F.concat(F.substr(parts, at - 1, F.lit(1)), join))
        after = _joined(maps, F.concat(join, F.substr(parts, at + 2, F.lit(1))))
        return bind(F.overlay(ranks, F.concat(before, after), at - 1, F.lit(3)), lambda ranks: _state(F.overlay(parts, join, at, F.lit(2)), ranks))

    most = F.sequence(F.lit(2), F.char_length(parts) - 2)  # a word of n bytes takes n - 1 merges at most
    merged = F.aggregate(most, _state(parts, ranks), lambda s, _: step(s), lambda s: F.transform(F.split(F.trim(s["parts"]), ""), _id))
    return F.when(F.char_length(parts) > 3, merged).when(F.char_length(parts) == 3, F.array(_id(F.trim(parts)))).otherwise(F.array().cast("array<int>"))


def _joined(maps: Column, pair: Column) -> Column:
    """The id of two parts' join, which is also its rank."""
    bucket = F.get(maps, (F.crc32(pair.cast("binary")) % BUCKETS).cast("int"))
    return F.coalesce(F.element_at(bucket, pair), F.lit(NEVER))


def _state(parts: Column, ranks: Column) -> Column:
    return F.struct(parts.alias("parts"), ranks.alias("ranks"), F.array_min(F.split(ranks, "")).alias("least"))


class Starts:
    """What the folds of words begin with: a word's bytes as parts between two edges, and the rank of each two neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        edge = 256
        self.of = np.array([*(ord(id_letter(ranks[bytes([b])])) for b in range(edge)), ord(EDGE)], "<u4")
        self.pairs = np.full((edge + 1, edge + 1), ord(NEVER), "<u4")
        for pair, rank in ranks.items():
            if len(pair) == 2:
                self.pairs[pair[0], pair[1]] = ord(id_letter(rank))

    def __call__(self, words: list[bytes]) -> pa.StructArray:
        """parts and ranks of each word, all words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        own, inside = np.full(int(sizes.sum()), 256, np.uint16), np.ones(int(sizes.sum()), bool)
        inside[ends - sizes] = inside[ends - 1] = False
        own[inside] = np.frombuffer(b"".join(words), np.uint8)
        within = np.ones(max(0, len(own) - 1), bool)
        within[ends[:-1] - 1] = False  # the last edge of a word and the first of the next
        ranks = self.pairs[own[:-1], own[1:]][within]
        return pa.StructArray.from_arrays([_strings(self.of[own], sizes), _strings(ranks, sizes - 1)], names=["parts", "ranks"])


def _strings(codes: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Strings of so many code points each, which lie end to end in ``codes``."""
    bytes_ = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)
    offsets = np.append(0, bytes_[np.cumsum(sizes) - 1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode()))


@functools.lru_cache(2)
def unreached(path: str) -> dict[bytes, int]:
    """Entries of a vocabulary that merges alone don't lead to; as a word, each is its own id."""
    ranks = read_ranks(path)
    return {word: rank for word, rank in ranks.items() if merged_by_heap(word, ranks, whole=False) != [rank]}


def merged_by_heap(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The ids of a long word: pairs wait in a heap by rank, then place; outdated ones are passed over."""
    if whole and word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, starts, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n  # of the part at a place: where it ends, where the one before begins
    waiting: list[tuple[int, int, int]] = []

    def propose(at: int) -> None:
        if at >= 0 and ends[at] < n:
            end = ends[ends[at]]
            if (rank := ranks.get(word[at:end])) is not None:
                heapq.heappush(waiting, (rank, at, end))

    for at in range(n - 1):
        propose(at)
    while waiting:
        _, at, end = heapq.heappop(waiting)
        middle = ends[at]
        if not alive[at] or middle >= n or ends[middle] != end:
            continue
        alive[middle], ends[at] = False, end
        if end < n:
            starts[end] = at
        propose(starts[at])
        propose(at)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


# --- whole texts ---------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of at most ``LONG`` bytes occurs in ``docs``."""
    own = patterns()

    def rows(batches):
        cutter = worker_memory("cutter", lambda: Cutter(*own))
        seen: Counter = Counter()

        def sent():
            words = {w: n for w, n in seen.items() if len(w.encode()) <= LONG}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(cutter(text.as_py() or ""))
                if len(seen) > MOST_WORDS:
                    yield sent()
        yield sent()

    parts = docs.select(F.col("text").cast("string")).mapInArrow(released(rows), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def common(counts: DataFrame, most: int) -> DataFrame:
    """The words of ``counts`` (word, n) found most often, at most ``most``: those above a count that no more words reach."""
    grade = F.floor(F.log2("n") * 64).cast("int")  # a few thousand at most, as counts are 64-bit numbers
    graded = counts.where("n > 1").groupBy(grade.alias("grade")).agg(F.count("*").alias("words")).toPandas()
    graded = graded.sort_values("grade", ascending=False)
    inside = graded.grade[graded.words.cumsum() <= most]
    return counts.where("n > 1").where(grade >= int(inside.min())) if len(inside) else counts.limit(0)


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of ``docs``, or all if they are not more."""
    n = docs.count()
    return docs if n <= most else docs.sample(most / n, seed=1)


def looked_up(docs: DataFrame, path: str | None = None, most: int = COMMON, counted: int = COUNTED) -> DataFrame:
    """doc_id, ids and folded of every row of ``docs``: ids of the common words and, for each other word, -1 - its place in folded (array<array<int>>)."""
    spark, path, own = docs.sparkSession, path or ranks_path(), patterns()
    ranks = read_ranks(path)
    merges, alone = Merges(ranks), unreached(path)
    del ranks  # what the driver holds counts there; tasks read the file themselves

    def started(batches):
        starts = Starts(read_ranks(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), starts(batch.column(0).cast(pa.binary()).to_pylist())], names=["word", "start"])

    frequent = common(cut(word_counts(sampled(docs, counted))), most) if most else spark.createDataFrame([], "word string")
    begun = frequent.select("word").repartition(spark.sparkContext.defaultParallelism).mapInArrow(released(started), "word string, start struct<parts:string,ranks:string>")
    known = begun.select("word", merges.ids(F.array("start"))[0].alias("ids")).toArrow()
    # no Python object for each word in the driver
    sent, key = spark.sparkContext.broadcast((known["word"].combine_chunks(), known["ids"].combine_chunks())), uuid.uuid4().hex
    del known

    class Ids(dict):
        """Ids of the common words; a word that is missing is one of the present text's own, which are let go after it."""

        def __missing__(self, word: str):
            coded = word.encode()
            if len(coded) > LONG:
                ids = tuple(merged_by_heap(coded, self.ranks))
            else:
                ids = (-1 - len(self.folds),)
                self.folds.append(coded)
            self[word] = ids
            self.own.append(word)
            return ids

        def of(self, words: list[str]) -> tuple[np.ndarray, list[bytes]]:
            self.own, self.folds = [], []
            ids = np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int32)
            for word in self.own:
                del self[word]
            return ids, self.folds

    def load():
        words, ids = sent.value
        ranks = read_ranks(path)
        one_each = list(range(max(ranks.values()) + 1))  # one number object for each id
        at = Ids(zip(words.to_pylist(), (tuple(map(one_each.__getitem__, x)) for x in ids.to_pylist())))
        at.update({word.decode(): (rank,) for word, rank in alone.items() if _is_text(word)})
        at.starts, at.ranks = Starts(ranks), ranks
        return Cutter(*own), at

    def rows(batches):
        cutter, at = worker_memory(key, load)

        def sent_on(docs_, found):
            ends = np.cumsum([0, *(len(ids) for ids, _ in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids for ids, _ in found])))
            places = np.cumsum([0, *(len(folds) for _, folds in found)], dtype=np.int32)
            folds = pa.ListArray.from_arrays(pa.array(places), at.starts([word for _, folds in found for word in folds]))
            return pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), ids, folds], names=["doc_id", "ids", "words"])

        for batch in batches:
            docs_, found, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                docs_.append(doc)
                found.append(at.of(cutter(text)))
                size += len(text)
                if size > MOST_BYTES:
                    yield sent_on(docs_, found)
                    docs_, found, size = [], [], 0
            if docs_:
                yield sent_on(docs_, found)

    rows_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(rows), "doc_id long, ids array<int>, words array<struct<parts:string,ranks:string>>")
    return rows_.select("doc_id", "ids", merges.ids(F.col("words")).alias("folded"))


def encode(docs: DataFrame, path: str | None = None, most: int = COMMON, counted: int = COUNTED) -> DataFrame:
    """doc_id, ids (array<int>) of every row of ``docs``."""
    whole = lambda folded: F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get(folded, -1 - i))))
    found = looked_up(docs, path, most, counted)
    return found.select("doc_id", F.when(F.size("folded") == 0, F.col("ids")).otherwise(bind(F.col("folded"), whole)).alias("ids"))


def _whole(ids: np.ndarray, folded: pa.ListArray) -> np.ndarray:
    """``ids`` with those of the words ``folded`` in their places."""
    places = np.flatnonzero(ids < 0)
    if not len(places):
        return ids
    flat, sizes = folded.flatten().to_numpy(zero_copy_only=False), np.diff(folded.offsets.to_numpy())
    which = -1 - ids[places]
    counts, starts = np.ones(len(ids), np.int64), np.arange(len(flat), len(flat) + len(ids))
    counts[places], starts[places] = sizes[which], (np.cumsum(sizes) - sizes)[which]
    stops = np.cumsum(counts)
    return np.concatenate([flat, ids])[np.repeat(starts - stops + counts, counts) + np.arange(stops[-1])]


def _is_text(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def _decoded(encoded: DataFrame, path: str | None, schema: str, columns) -> DataFrame:
    """doc_id and ``columns(ids, decoded)`` of every row of ``encoded``, as ``encode`` or ``looked_up`` gives it; decoded: the bytes of its ids in order."""
    path = path or ranks_path()
    names = [c.split(" ")[0] for c in schema.split(", ")]
    has_folds = "folded" in encoded.columns

    def load():
        ranks = read_ranks(path)
        words: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            words[i] = word
        return pa.array(words, pa.binary())

    def rows(batches):
        words = worker_memory(("words of ids", path), load)
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                ids = batch.column(1)[at].values.to_numpy(zero_copy_only=False)
                if has_folds:
                    ids = _whole(ids, batch.column(2)[at].values)
                pieces = words.take(pa.array(ids))
                if pieces.null_count:
                    raise KeyError("an id that the vocabulary lacks")
                found.append(columns(ids, pieces.buffers()[2].slice(0, pc.sum(pc.binary_length(pieces)).as_py()) if len(ids) else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*found))] if found else [[] for _ in names], names=names)

    return encoded.select("doc_id", "ids", *["folded"] * has_folds).mapInArrow(released(rows), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (the bytes that the ids stand for) of every row of ``encoded`` (doc_id, ids)."""
    return _decoded(encoded, path, "doc_id long, decoded binary", lambda ids, decoded: (bytes(decoded),))


def digested(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of what ``decode`` gives) of every row of ``encoded``."""
    said = lambda ids, decoded: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return _decoded(encoded, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", said)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(looked_up(table(spark, sf_dir, "documents")))

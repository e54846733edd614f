"""Quality rules: counts over words and lines, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks; its ratio
(compressed to plain bytes) must lie in the band of its length. A low ratio is
repetitive, a high one is noise. Short texts have no band: a frame's fixed bytes
outweigh them. Each full chunk must lie in ``CHUNK_BAND``; what is left at the end
is a chunk of its own with the band of its own length. A text fails when its
whole ratio is out of band or more than ``MOST_BAD`` of its bytes are in chunks
out of band.

The bands are documented constants: ``calibrated`` gives the shares of a table's
texts by length and ratio from which they were read off.

Defined results: a null text has no words; lines are split at ``\\n`` and a line
equals an earlier one only as a whole; repeated rows are judged each; an empty
table gives an empty table; input columns named like an output are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.common import released, table

#: From so many bytes: least and most ratio of a whole text.
BANDS = [(0, 0.0, 99.0), (64, 0.40, 1.30), (128, 0.40, 1.10), (256, 0.36, 0.95), (512, 0.33, 0.85), (1024, 0.30, 0.78), (2048, 0.28, 0.72), (4096, 0.25, 0.68)]
CHUNK_BYTES = 4096
CHUNK_BAND = (0.22, 0.72)
MOST_BAD = 0.25
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_WHITE = b" \t\n\x0b\x0c\r"
_TAIL = bytes(range(0x80, 0xC0))


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _WHITE + _TAIL))  # one byte of each code point is not a continuation
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return n, chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) < 2_000_000:
        window = (at[:-2] * len(number) + at[1:-1]) * len(number) + at[2:]
        _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
    else:
        _, inverse, times = np.unique(np.stack([at[:-2], at[1:-1], at[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = times[inverse.ravel()] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def ratios(text: bytes) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its bytes that are in chunks out of band."""
    if not text:
        return 0.0, 0.0
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    whole = len(pack(text)) / len(text)
    if len(text) < CHUNK_BYTES:
        return whole, 0.0  # one chunk, judged as the whole text
    bad = 0
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        least, most = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band(len(chunk))
        bad += len(chunk) * (not least <= len(pack(chunk)) / len(chunk) <= most)
    return whole, bad / len(text)


def band(size: int) -> tuple[float, float]:
    return next((a, b) for n, a, b in reversed(BANDS) if size >= n)


def in_band(size: int, whole: float, bad: float) -> bool:
    least, most = band(size)
    return least <= whole <= most and bad <= MOST_BAD


def calibrated(docs: DataFrame, parts: tuple[float, ...] = (0.001, 0.01, 0.5, 0.99, 0.999)) -> DataFrame:
    """least (bytes, as in BANDS), n and the quantiles ``parts`` of the whole ratios of the texts of that length whose base rules pass."""
    starts = F.array(*[F.lit(n) for n, _, _ in BANDS])
    rows = judge(docs).where("not base_failed").join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    rows = rows.withColumn("least", F.array_max(F.filter(starts, lambda n: n <= F.col("size"))))
    return rows.groupBy("least").agg(F.count("*").alias("n"), F.percentile_approx("ratio", list(parts), 10_000).alias("quantiles")).orderBy("least")


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, its ratios and the verdict."""

    def rows(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                own = counts(text)
                failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
                whole, bad = ratios(text)
                out.append((doc, *own, failed, not failed and in_band(len(text), whole, bad), whole, bad))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(rows), OUT)


_NAMES = re.findall(r"(\w+) (?:long|boolean|double)", OUT)
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))

"""Filter audit, byte-level BPE and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

from plaza.llm import audit, bytebpe, variants
from plaza.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, part string, n long, word string, digest string"


def table(spark, rows):
    """Documents with columns that clash with working ones."""
    return spark.createDataFrame([(i, t, s, "p", 1, "w", "d") for i, t, s in rows], SCHEMA)


WORDY = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, WORDY, "a"), (2, WORDY, "a"), (3, WORDY + " A B C D E F G H I J K L M N O P Q R S T U", "b"), (4, "short #", None), (5, None, None), (6, "", ""), (7, "same " * 80, "b"),
    (8, "same " * 80, "b"), (8, "same " * 80, "b"), (None, WORDY, "a"), (9, "SHOUT $ " * 70, "ü"), (10, "é" * 30_000 + " x " * 60, "a"),
]


# --- audit ---------------------------------------------------------------------


def by_hand(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        said = [x for x in labels if x[0] == i and i is not None]
        rows.append((s or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, removed_in_all = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                earlier = [r for r in own if f in r[1] and r[1] & set(order[:k])]
                left = [r for r in left if f not in r[1]]
                removed_in_all[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(earlier), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
    return {k: (*v[:-1], removed_in_all[k[0], v[-1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_by_hand(spark):
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1), (9, None, 1)]
    got = audited(audit.audit(table(spark, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == by_hand(DOCS, labels) and len(got) == 600 * 4


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(audit.audit(table(spark, []), labels)) == {}
    assert audited(audit.audit(table(spark, DOCS[:1]), labels)) == by_hand(DOCS[:1], [])


def test_audit_whole_table(spark, small):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.sql(audit.ORACLE)
    got = audit.query(spark, small)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_bit_index_of_many_parts():
    draw = np.random.default_rng(3)
    part, fails = draw.integers(0, 150, 3000), draw.integers(0, 32, 3000)
    part[:1200] = 7  # a hot part
    good, toxic = draw.random(3000) < 0.5, draw.random(3000) < 0.1
    found = audit.indexed(part, 150, fails, good, toxic)
    for cell, (s, f) in enumerate(audit._prefix_sets(5)):
        gone = (fails >> f & 1 == 1) & (fails & s == 0)
        for kind, rows in enumerate((gone, gone & good, gone & toxic, fails & (s | 1 << f) == 0)):
            assert found[:, cell, kind].tolist() == np.bincount(part[rows], minlength=150).tolist()


# --- byte-level BPE ------------------------------------------------------------

TEXTS = [
    None, "", " ", "   \n\n ", "a", "Hello, world! It's 3.14 o'clock; they'll've", "naïve café ΣΑΣ é́ 日本語 😀👩‍👩‍👧", "x" * 5000, "日本語" * 700, "\x00\x1c\x1f\x85  tab\t\r\n", "don't DON'T 'S  's",
    "a՘b࢏c 1\U000323b5\U0001ccf0 �­", "<|endoftext|> ", "ab" * 31 + "é" * 33, "antidisestablishmentarianism " * 300, "word",
]


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.read_ranks(bytebpe.ranks_path())
    return tiktoken.Encoding("own", pat_str=bytebpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("most", [0, 3, bytebpe.COMMON])
def test_ids_are_the_librarys(spark, library, most):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s"), (None, "no id", "s")]
    encoded = bytebpe.encode(table(spark, rows), most=most, counted=10).cache()
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in bytebpe.decode(encoded).collect()), key=str) == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=str)


def test_bytes_of_nothing(spark):
    assert bytebpe.digested(bytebpe.encode(table(spark, []))).count() == 0


def test_bytes_whole_table(spark, small, library):
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bytebpe.query(spark, small)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_common_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{n}", n) for n in range(1, 2000)] + [(f"tie{n}", 5) for n in range(500)], "word string, n long")
    for most in (0, 10, 900, 10_000):
        chosen = [r.n for r in bytebpe.common(counts, most).collect()]
        assert len(chosen) <= most and (not chosen or min(chosen) > 1)
        assert len(chosen) == sum(n >= min(chosen, default=10**9) for n in [*range(2, 2000), *[5] * 500])  # no more frequent word is left out


def test_starts_of_many_words():
    """Parts and ranks of words laid out together are those of each word."""
    ranks = bytebpe.read_ranks(bytebpe.ranks_path())
    draw, letter = random.Random(6), bytebpe.id_letter
    words = [bytes(draw.choice(b"aeinrst\xc3\xa9\xff ") for _ in range(draw.randint(1, 64))) for _ in range(300)]
    pair = lambda p: letter(ranks[p]) if p in ranks else bytebpe.NEVER
    want = [{"parts": " " + "".join(letter(ranks[bytes([b])]) for b in w) + " ", "ranks": "".join([bytebpe.NEVER, *(pair(w[k : k + 2]) for k in range(len(w) - 1)), bytebpe.NEVER])} for w in words]
    assert bytebpe.Starts(ranks)(words).to_pylist() == want
    assert bytebpe.Starts(ranks)([]).to_pylist() == []


def test_heap_merges_as_the_library(library):
    ranks = bytebpe.read_ranks(bytebpe.ranks_path())
    draw = random.Random(5)
    for _ in range(300):
        word = bytes(draw.choice(b"aeinrst\xc3\xa9 ") for _ in range(draw.randint(1, 120)))
        assert bytebpe.merged_by_heap(word, ranks) == library._encode_single_piece(word)


def test_classes_of_every_character():
    """Cuts as the library does, told by a vocabulary in which a letter or digit before a character is one entry with it."""
    cutter = bytebpe.Cutter(*bytebpe.patterns())
    known = [c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)])]
    for at in range(0, len(known), 100_000):
        some = known[at : at + 100_000]
        ranks = {bytes([b]): b for b in range(256)} | {(lead + c).encode(): 256 + 3 * k + x for k, c in enumerate(some) for x, lead in enumerate("a1!")}
        ask = tiktoken.Encoding("classes", pat_str=bytebpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for lead in "a1!":
            assert [c for c in some if (len(ask.encode_ordinary(lead + c)) == 1) != (len(cutter(lead + c)) == 1)] == []


# --- spelling variants ---------------------------------------------------------


def counted(docs):
    n = Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def grouped(n):
    letters = {c for w in n for c in w}
    near = {w: {v for v in edits(w, letters) if v != w and v in n} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made_up():
    draw = random.Random(9)
    words = ["".join(draw.choice("aeinrstlÀéÿ×") for _ in range(draw.randint(5, 12))) for _ in range(60)]
    words += [draw.choice(list(edits(draw.choice(words), "aeé"))) for _ in range(400)] + ["z" * 300, "z" * 299, "z" * 300 + "y"]
    return [(i if i % 5 else None, " ".join(draw.choices(words, k=60)) + " SHOUTED Shouted", None) for i in range(120)] + [(500, None, None), (501, "", None), (502, "z" * 300 + " " + "z" * 299, None)] * 6


def test_variants_by_hand(spark):
    docs = made_up()
    words = variants.words_of(table(spark, docs))
    assert {r.word: r.n for r in words.collect()} == counted(docs)
    assert variant_rows(variants.group_variants(words)) == grouped(counted(docs))
    assert any(r[2] != r[1] and r[1] for r in grouped({"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25}))  # forms of forms


def test_variants_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 7)
    monkeypatch.setattr(variants, "PAIRS", 64)
    n = {w: k for w, k in counted(made_up()).items()} | {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabb": 625, "aaaabbc": 125}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variant_rows(variants.group_variants(words)) == grouped(n)


def test_variants_of_nothing(spark):
    assert variants.group_variants(variants.words_of(table(spark, []))).count() == 0
    assert variants.group_variants(variants.words_of(table(spark, [(1, None, None), (2, "abc", None)]))).count() == 0


def test_variants_whole_table(spark, small):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert variant_rows(variants.query(spark, small)) == grouped(counted(docs))


def test_bands_catch_every_edit():
    draw = random.Random(1)
    part = (1 << 21) - 1
    for _ in range(2000):
        word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzàéÿ×") for _ in range(draw.randint(5, 15)))
        edited = draw.choice(list(edits(word, "aqéÿ")))
        a, b = (variants.letter_mask(w.encode("latin-1")) for w in (word, edited))
        assert (a ^ b).bit_count() <= 2 and any(a >> 21 * k & part == b >> 21 * k & part for k in range(3))


def test_pairs_come_once(spark):
    words = spark.createDataFrame([(w, 5) for w in ("bananas", "banana", "bandana", "bananae", "cabana")], "word string, n long")
    with Scratch(spark) as scratch:
        pairs = sorted(tuple(sorted((r.a, r.b))) for r in variants.near_pairs(scratch, words).collect())
    assert pairs == [("banana", "bananae"), ("banana", "bananas"), ("banana", "bandana"), ("bananae", "bananas")]

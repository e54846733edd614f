"""The training-data operators against brute force, on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaza import llm
from plaza.llm import bands, chat, components, exact_dedup, jaccard, langid, lattice, packing, pii, repair, tokens, urls

LONG = "lorem ipsum dolor " * 4000 + "x" * 3000
TEXTS = [
    "the quick brown fox jumps over the lazy dog", "the quick  brown fox jumps over the\tlazy dog", "The Quick Brown Fox jumps over the lazy dog again and again", None, "", "   \n", "12345 !!!", "a", "a b c",
    LONG, "der schnelle braune Fuchs springt über den faulen Hund", "le renard brun saute par-dessus le chien paresseux", "<|endoftext|> It's 3.14 ΣΑΣ é́ 日本 😀", "the quick brown fox jumps over the lazy dog",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def table(spark, texts=TEXTS, ids=None):
    """Documents with extra columns whose names clash with outputs; the row of ``dog`` occurs twice with one id."""
    ids = ids or range(len(texts))
    rows = [(i, t, None if i % 4 == 3 else "en", None, len(t) if t else None, None, "k") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(0, TEXTS[0], None, None, None, None, None), (None, "no id here at all", None, None, None, None, None)], SCHEMA)
    return table(spark).unionByName(extra).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# --- language ------------------------------------------------------------------


def test_language(spark, docs, none):
    many = [(i, ("the and of with " if i % 2 else "der und die nicht ") * 5 + str(i), "en" if i % 2 else "de") for i in range(60)]
    model = langid.learn(spark.createDataFrame(many, "id long, text string, lang string"))
    assert model[0] == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert langid.predict(docs, model).count() == docs.count()
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[6].score == 0
    assert got[0].lang_pred == "en" and got[10].lang_pred == "de" and got[9].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    empty = langid.learn(none.select(F.col("doc_id").alias("id"), "lang", "text"))
    assert empty[0] == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_prediction_is_the_nearest_bundle(spark):
    said = {"en": "the and of with from that", "de": "der und die nicht von wird", "fr": "les une dans pour avec est"}
    many = [(i, lang, " ".join(said[lang].split()[k] for k in ((i >> 1) % 6, i % 5, i % 3))) for i in range(90) for lang in [sorted(said)[i % 3]]]
    rows_ = spark.createDataFrame(many, "id long, lang string, text string")
    model = langid.learn(rows_)

    def brute(text):  # n-gram vectors bound and bundled one by one
        total = np.zeros(langid.DIMENSIONS)
        for word in re.findall("[a-zäöüé]+", text.lower()):
            padded = [0, *map(ord, word), 0]
            for gram in zip(padded, padded[1:], padded[2:]):
                total += np.prod([np.roll(langid._letter_vector(c), 2 - k).astype(float) for k, c in enumerate(gram)], axis=0)
        return total / np.linalg.norm(total)

    prototypes = {lang: sum(brute(t) for _, x, t in many if x == lang) for lang in said}
    for r in langid.predict(rows_, model).collect():
        own = brute(r.text)
        cosines = {lang: float(p @ own / np.linalg.norm(p)) for lang, p in prototypes.items()}
        assert r.score == pytest.approx(max(cosines.values()), abs=1e-4) and cosines[r.lang_pred] == pytest.approx(r.score, abs=1e-4)


def test_floors_reject_noise_and_keep_columns(spark):
    random = np.random.default_rng(2)
    words = "the and of with from that this have been would could there their people other after first".split()
    many = [(i, "en", " ".join(random.choice(words, 20)), "s", 1.5) for i in range(600)]
    noise = [(1000 + i, None, "".join(map(chr, random.integers(97, 123, 120))), "n", None) for i in range(20)]
    df = spark.createDataFrame([*many, *noise, (2000, None, "x", "short", None), (2001, None, "77", "none", None)], "doc_id long, lang string, text string, lang_pred string, score double")
    model = langid.learn_documents(df)
    kept = langid.known(df, model, langid.floors(langid.labelled(df), model))
    assert rows(kept) == sorted([*many, (2000, None, "x", "short", None)], key=str)  # too few short ones are known for a floor


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    unlabelled = table(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = sorted(r.doc_id for r in corpus_pipeline.language(spark, unlabelled, "").collect())
    assert kept == [i for i, t in enumerate(TEXTS) if any(c.isalpha() for c in t or "")]


def test_profile_is_the_bundle_of_bound_vectors():
    codes, counts = langid.ngrams("Ab, ba")
    by_hand = collections.Counter()
    for word in ("ab", "ba"):
        padded = [0, *map(ord, word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            by_hand[(a << 42) | (b << 21) | c] += 1
    assert dict(zip(codes.tolist(), counts.tolist())) == by_hand
    total = np.zeros(langid.DIMENSIONS)
    for code, n in by_hand.items():
        v = np.ones(langid.DIMENSIONS)
        for place in range(3):
            v *= np.roll(langid._letter_vector(code >> 21 * place & 0x1FFFFF), place)
        total += n * v
    assert np.allclose(langid.profile("Ab, ba"), total / np.linalg.norm(total), atol=1e-6)


def test_held_out_accuracy(spark, small):
    got = langid.__dict__["query"](spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    seen = got.where("held_out").join(truth, "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in seen]) > 0.95


# --- tokens, packing, token files ------------------------------------------------


def reference_ids(text):
    own = Tokenizer.from_file(tokens.vocabulary_path())
    return [*own.encode(text or "", add_special_tokens=False).ids, tokens.END]


@pytest.mark.parametrize("bounds", [(1_000_000, 10**7), (3, 10)])
def test_word_memory_gives_the_library_ids(bounds):
    model = tokens.WordTokenizer(tokens.vocabulary_path(), *bounds)
    awkward = [*TEXTS, "x|y a'b 'tis we'll.", "<|ENDOFTEXT|>x", "a\x1cb \x85 ok", "İ ŉ ǅ ª.", "1.2.3,é, É."]
    for text in awkward:  # one by one, so that a small memory is emptied
        assert model.ids([text.encode() if text is not None else None])[0].tolist() == reference_ids(text)


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 500)
    for rule in ("norm", "dot"):
        bins, offset = packing.best_fit(sizes, 100, 7, 5000, rule=rule)
        for b in set(bins.tolist()):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offset[own])]
            assert sizes[own].sum() <= 100 and len(own) <= 7
            assert (sizes[own] ** 2).sum() <= 5000 or len(own) == 1
            assert offset[order].tolist() == np.append(0, np.cumsum(sizes[order])[:-1]).tolist()
    bins, _ = packing.best_fit(sizes, 100)
    assert len(set(bins.tolist())) <= 1.05 * sizes.sum() / 100  # half of the pieces are over half a bin


def test_workers_keep_no_words_after_packing(spark, docs):
    packing.pieces(docs).collect()

    def held(batches):
        import pyarrow as pa

        from plaza.llm import common

        for _ in batches:
            model = common._held[1]
            yield pa.RecordBatch.from_pydict({"n": [len(getattr(model, name, ())) for name in ("seen", "pieces")]})

    assert {r.n for r in spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect()} == {0}


def test_packing(docs, none):
    got = packing.packed_documents(docs).collect()
    want = []
    for r in docs.collect():
        ids = reference_ids(r.text)
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            want.append((r.doc_id, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str)
    for _, own in by(got, "sequence_id"):
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)
    assert packing.packed_documents(none).count() == 0


def by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out.items()


@pytest.mark.parametrize("ids", [[5] * 500, [1, 2] * 300, list(range(50)) * 20, [7], [1] * 3])
def test_pair_grammar_round_trip(ids):
    held = [np.array(ids, np.uint32), np.array([tokens.END], np.uint32), np.array(ids[::-1], np.uint32)]
    counts = np.array([len(x) for x in held])
    symbols, first, rules, lengths = repair.compress(np.concatenate(held), np.cumsum(counts) - counts)
    row = {"doc_ids": [0, 1, 2], "first_symbol": first.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(), "width": 32}
    shard = repair.Shard(row)
    for k, own in enumerate(held):
        assert shard.document(k).tolist() == shard.documents()[k].tolist() == own.tolist()
        assert [shard.token_at(k, i) for i in range(len(own))] == own.tolist()
    assert len(symbols) < 0.6 * counts.sum() or len(ids) < 40


def test_pair_grammar_leaves_no_frequent_pair():
    random = np.random.default_rng(5)
    passage = random.integers(0, 40_000, 150)
    held = [np.concatenate([random.integers(0, 300, 40), passage, random.integers(0, 300, 40)]).astype(np.uint32) for _ in range(400)]
    counts = np.array([len(x) for x in held])
    symbols, first, rules, lengths = repair.compress(np.concatenate(held), np.cumsum(counts) - counts)
    assert lengths.max() >= 150
    last = {}
    pairs = collections.Counter()
    for s, e in zip(first[:-1], first[1:]):
        for at in range(s, e - 1):
            pair = symbols[at], symbols[at + 1]
            if last.get(pair) != at - 1 or pair[0] != pair[1]:
                pairs[pair] += 1
                last[pair] = at
    assert max(pairs.values()) < repair.LEAST_COUNT
    assert len(np.unique(rules, axis=0)) == len(rules)


def test_token_files(spark, docs, none, tmp_path):
    repair.write_tokens(docs, str(tmp_path / "t"), shard_tokens=50)
    got = repair.read_tokens(spark, str(tmp_path / "t")).collect()
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = reference_ids(r.text)
        want.append((r.doc_id, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(want, key=lambda r: r[1]) == sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1])
    sums = repair.read_tokens(spark, str(tmp_path / "t"), whole=False).collect()
    assert sorted(r.ids_crc32 for r in sums) == sorted(zlib.crc32(w[3]) for w in want)
    size = repair.sizes(spark, str(tmp_path / "t")).first()
    assert size.n_tokens == at and size.n_symbols <= at and 0 < size.ratio
    repair.write_tokens(none, str(tmp_path / "e"))
    assert repair.read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- copies ----------------------------------------------------------------------


def test_exact_dedup_keeps_clashing_columns(spark):
    own = [(1, "a b", "mine", 7.5), (2, "a  b", "yours", 8.5), (3, "c", None, 9.5)]
    df = spark.createDataFrame(own, "doc_id long, text string, kept string, group_size double")
    assert rows(exact_dedup.dedup(df)) == own[1:]
    same = spark.createDataFrame([(4, "x y", "1"), (4, "x y", "1"), (None, "xy ", "2")], "doc_id long, text string, text_sha256 string")
    assert [r.doc_id for r in exact_dedup.dedup(same).collect()] == [None]
    assert rows(exact_dedup.mark(same), "doc_id", "keep_id", "kept", "group_size") == [(4, None, False, 3), (4, None, False, 3), (None, None, True, 3)]


def test_exact_dedup(docs, none):
    got = exact_dedup.mark(docs).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[plain(r.text)].append(r)
    assert len(got) == docs.count()
    for r in got:
        own = groups[plain(r.text)]
        keep = min(own, key=lambda x: (-len(x.text or ""), x.doc_id is not None, x.doc_id or 0))
        assert (r.keep_id, r.group_size) == (keep.doc_id, len(own)) and r.text_sha256 == hashlib.sha256(plain(r.text).encode()).hexdigest()
        assert r.kept == (r.doc_id == keep.doc_id and len(r.text or "") == len(keep.text or ""))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark(none).count() == exact_dedup.dedup(none).count() == 0


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(texts, n, percent):
    own = {i: shingle_set(t, n) for i, t in texts.items()}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in own:
        for j in own:
            both = len(own[i] & own[j])
            if i < j and both and 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(own[i]), find(i)) for i in own}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, percent):
    rng = np.random.default_rng(n)
    common = [f"w{k}" for k in range(60)]
    base = [[f"d{g}x{k}" for k in range(int(rng.integers(3, 120)))] for g in range(12)]
    texts = {}
    for g, words in enumerate(base):
        for c in range(int(rng.integers(1, 14))):
            own = list(words)
            for _ in range(int(rng.integers(0, max(2, len(own) // 18)))):
                own[int(rng.integers(0, len(own)))] = f"m{rng.integers(0, 5)}"
            texts[len(texts)] = " ".join(own + (common if g % 4 == 0 else []))
    for t in (None, "", "a b", "A  b", "a b c d", " "):
        texts[len(texts)] = t
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_jaccard_repeated_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [(1, base), (5, base + " end"), (5, "quite another text with words of its own"), (None, base + " stop"), (7, "quite another text with words of its own"), (7, ""), (8, None), (9, "alone with all of its words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, key string")
    got = rows(jaccard.jaccard_components(df).select("doc_id", "component_id"))
    assert got == sorted([(1, 1), (5, 1), (5, 5), (None, 1), (7, 5), (7, 7), (8, 8), (9, 9)], key=str)
    assert rows(jaccard.dedup(df, 4, 85)) == sorted([(1, base, "x"), (5, texts[2][1], "x"), (7, "", "x"), (8, None, "x"), (9, texts[7][1], "x")], key=str)
    plain = df.where("doc_id in (1, 8, 9)").union(df.where("doc_id = 5 and text like 'w0%'"))
    assert rows(jaccard.dedup(plain, 4, 85), "doc_id") == [(1,), (8,), (9,)]


def test_jaccard_awkward(docs, none):
    got = jaccard.jaccard_components(docs)
    assert got.count() == docs.count() and jaccard.jaccard_components(none).count() == 0
    own = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert own[3].n_shingles == 0 and own[3].component_id == 3 and own[13].component_id == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


# --- URLs, personal data, quality ----------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "said"),
    [("http://a.COM/x?y", "a.com", "/x", "com/", "allow"), ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"), ("x://www.example.com/en/#f", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"), ("http://notexample.com", "notexample.com", "", None, None), ("http://xcom/", "xcom", "/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None)],
)
def test_url_rules(spark, url, host, path, rule, said):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    r = urls.judge(df).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and (said is None or r.verdict == said) and r.verdict in ("allow", "block")


def test_markov_is_a_distribution():
    grams = collections.Counter(g for t in ("abab", "abc") for i in range(len(t)) for k in range(5) if i - k >= 0 for g in [t[i - k : i + 1]])
    model = urls.Markov(dict(grams))
    total = sum(np.exp(model.log("ab" + chr(c))) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) in "abc") + (0x110000 - 3) * np.exp(model.log("ab☃"))
    assert total == pytest.approx(1, abs=1e-6)


def test_url_model_tells_unseen_urls(spark):
    good = [(i, f"http://news{i}.com/story/{i}") for i in range(400)]
    bad = [(1000 + i, f"http://xx{i}.net/es/win-cash-{i}") for i in range(400)]
    asked = [(5000, "http://news7.org/story/9"), (5001, "http://yy3.org/es/win-cash-5"), (5002, None), (5003, "")]
    df = spark.createDataFrame(good + bad + asked, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).where("page_id >= 5000").collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block" and got[5002].score == 0
    assert urls.judge(df.limit(0)).count() == 0


def test_url_score_and_threshold_by_brute_force(spark):
    good = [(i, f"HTTP://News{i}.com/story?id={i * 7}") for i in range(60)]
    bad = [(1000 + i, f"http://xx{i}.net/es/win#cash-{i}") for i in range(60)]
    asked = [(5000, "http://a.org/x"), (5001, "http://a.org/x?win#cash-9"), (5002, "no scheme")]
    df = spark.createDataFrame(good + bad + asked, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert got[5000].score != got[5001].score and (got[5001].host, got[5001].path) == ("a.org", "/x") and got[5002].score == 0
    text = lambda u: u.split("://", 1)[1].replace("News", "news")
    part = {r.t: r.k for r in spark.createDataFrame([(text(u),) for _, u in good + bad], "t string").selectExpr("t", f"pmod(xxhash64(t, 1), {urls.CALIBRATE}) = 0 AS k").collect()}

    def likelihood(fit, t):
        grams = collections.Counter(u[i - k : i + 1] for u in fit for i in range(len(u)) for k in range(min(i, urls.ORDER) + 1))

        def p(context, c):
            shorter = p(context[1:], c) if context else 1 / 0x110000
            after = {g[-1]: n for g, n in grams.items() if len(g) == len(context) + 1 and g[:-1] == context}
            return (after.get(c, 0) + len(after) * shorter) / (sum(after.values()) + len(after)) if after else shorter

        return sum(np.log(p(t[max(0, i - urls.ORDER) : i], t[i])) for i in range(len(t)))

    allow, block = ([text(u) for _, u in own if not part[text(u)]] for own in (good, bad))
    for page, url in [good[3], bad[5], asked[0], asked[1]]:
        t = text(url)
        assert got[page].score == pytest.approx((likelihood(allow, t) - likelihood(block, t)) / len(t))
    kept = [(got[i].score, own is good) for own in (good, bad) for i, u in own if part[text(u)]]
    threshold = urls._threshold(kept)
    best = max((np.mean([s >= t for s, y in kept if y]) + np.mean([s < t for s, y in kept if not y])) for t in [s for s, _ in kept])
    assert np.mean([s >= threshold for s, y in kept if y]) + np.mean([s < threshold for s, y in kept if not y]) == pytest.approx(best)
    assert all(got[i].verdict == ("block" if got[i].score < threshold else "allow") for i in (5000, 5001, 5002))


PII = [
    "mail a.b@c.d.e. and x@y, z@w-1.co", "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 001.02.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (599) 555-3756, +12 3", "@@ a@b@c.de +", "5555" * 5, "9" * 3000 + ".1.1.1", "x" * 5000 + "@" + "y" * 3000 + ".z", None, "é a@b.cd",
]


def brute_base(t):
    t = t or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("text", PII)
def test_base_spans(text):
    assert pii.base_spans(text or "") == brute_base(text)


def test_personal_data(spark, docs, none):
    right = [(i, f'write to u{i}@mail.example now, ip 10.0.{i % 200}.7 or call +1 (599) 555-{1000 + i} key = "{hashlib.sha1(str(i).encode()).hexdigest()}" v{i}.1 {i:05d} ordinarylongwordwithoutanydigits{i}') for i in range(400)]
    many = spark.createDataFrame(right, "doc_id long, text string")
    model = pii.learn(many)
    assert {"email", "ip", "phone", "secret"} <= set(model.thresholds)
    found = {r.doc_id: r for r in pii.find(many, model).collect()}
    for i, t in right[:40]:
        assert [tuple(s) for s in found[i].base] == brute_base(t) and {tuple(s) for s in found[i].base} <= {tuple(s) for s in found[i].spans}
        assert any(s.kind == "secret" for s in found[i].spans)
    clean = pii.redact(many.withColumn("n_chars", F.length("text")), model).first()
    assert "[EMAIL]" in clean.text and "555-" not in clean.text and clean.n_chars == len(clean.text)
    assert pii.find(docs, model).count() == docs.count() and pii.redact(docs, model).columns == docs.columns
    assert pii.find(none, model).count() == 0 and pii.learn(none).trees is None
    assert pii.redacted("abcdef", [("a", 1, 4), ("b", 3, 5)]) == "a[A]f"


def test_added_spans_never_meet_base_spans():
    text = " " + "a@b.cd" * 14 + "@host.example 1.2.3.4"
    base = pii.base_spans(text)
    places = pii._merged(base)
    assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
    inside = {(s, e) for s in range(len(text)) for e in (s + 1, s + 7)}
    for s, e in inside:
        assert pii._meets(places, s, e) == any(s < f and b < e for _, b, f in base)
    nested = [("email", 2, 122), *[("ip", k, k + 3) for k in range(4, 60, 4)]]
    assert pii._meets(pii._merged(nested), 113, 118)


def test_recall_and_precision_of_planted_spans(spark):
    name = lambda i: hashlib.sha1(str(i).encode()).hexdigest()[: i % 9 + 4].translate(str.maketrans("0123456789", "ghijklmnop"))
    said = lambda i: f"mail {name(i)}@{name(i + 2)}.example, ip 10.0.{i % 200}.7 or call +1 ({200 + i % 700}) 555-{1000 + i} key = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" on 2024-01-{i % 28 + 1:02d} order {i:07d}"
    model = pii.learn(spark.createDataFrame([(i, said(i)) for i in range(600)], "doc_id long, text string"))
    found = right = wanted = 0
    for i in range(1000, 1100):
        planted = [("email", f"{name(i)} (at) {name(i + 5)} (dot) example"), ("phone", f"({200 + i % 700}) 555-{1000 + i}"), ("ip", f"2001:db8::{i:x}:{i * 7 % 4096:x}"), ("secret", hashlib.sha256(str(i).encode()).hexdigest())]
        text = f"mail {planted[0][1]} now, call {planted[1][1]} or ip {planted[2][1]} with token = '{planted[3][1]}' since 2023-11-{i % 28 + 1:02d} at 12:30:45 order {i:07d}"
        truth = {(k, text.index(x), text.index(x) + len(x)) for k, x in planted}
        got = set(model.added(text, pii.base_spans(text)))
        found, right, wanted = found + len(got), right + len(got & truth), wanted + len(truth)
    assert right >= 0.95 * wanted and right >= 0.95 * found


FORMS = [
    ("email", "write to {} now", "jo.smith (at) site (dot) example"), ("email", "mail {} please", "kim[at]post[dot]example"), ("ip", "ip {} or call", "2001:db8::1f:22"),
    ("ip", "the host {} is up", "fe80:0:12ab:9:77:1:c0de:5"), ("phone", "or call {} now", "(974) 555-3436"), ("phone", "phone {} please", "974-555-3436"), ("card", "paid by card {} today", "4111.1111.1111.1111"),
]


def test_forms_beyond_base(spark):
    name = lambda i: f"u{i}" if i % 2 else hashlib.sha1(str(i).encode()).hexdigest()[: i % 9 + 3].translate(str.maketrans("0123456789", "ghijklmnop"))
    said = lambda i: f"{'mail' if i % 3 else 'write to'} {name(i)}@{name(i + 2)}.example now, ip 10.0.{i % 200}.7 or call +1 ({200 + i}) 555-{1000 + i} paid by card 4111 1111 1111 1111 on 2024-01-{i % 28 + 1:02d} v{i}.1.2 order {i:07d}"
    model = pii.learn(spark.createDataFrame([(i, said(i)) for i in range(400)], "doc_id long, text string"))
    for kind, context, form in FORMS:
        text = context.format(form)
        at = text.index(form)
        assert pii.base_spans(text) == [] and (kind, at, at + len(form)) in model.added(text, []), form
    assert [p for p in model.added("seen at 12:30:45:10 from 00:1a:2b:3c:4d:5e on 2024-01-07", []) if p[0] != "card"] == []


def test_long_and_letter_only_secrets(spark):
    letters = [hashlib.sha1(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(400)]
    model = pii.learn(spark.createDataFrame([(i, f'set key = "{x}" with {x[:5]} and {x}{x}') for i, x in enumerate(letters)], "doc_id long, text string"))
    for n in (40, 300, 5000):
        key = (letters[0] + letters[1]) * 70
        text = f'set key = "{key[:n]}" with it'
        assert ("secret", 11, 11 + n) in model.added(text, [])


def brute_counts(text):
    text = text or ""
    spans = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m[0] for m in spans]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [*TEXTS, "a b a b a b", "x\n\nx\n x\nx", "#*$ é\x1c\xa0ü | <>", "a a a a"])
def test_quality_counts(text):
    assert bands.counts((text or "").encode()) == brute_counts(text)


def test_quality(docs, none):
    got = {r.doc_id: r for r in bands.judge(docs).collect()}
    assert bands.judge(docs).count() == docs.count() and bands.judge(none).count() == 0
    assert got[9].base_failed and not got[9].kept and not got[3].kept
    prose = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:3] + "the"[: i % 4] for i in range(300))
    whole, bad = bands.ratios(prose.encode())
    assert bands.in_band(len(prose), whole, bad)
    noise = np.random.default_rng(0).integers(33, 127, 9000, np.uint8).tobytes()
    assert not bands.in_band(9000, *bands.ratios(noise)) and not bands.in_band(9000, *bands.ratios(b"word " * 1800))


def brute_verdict(text):
    raw = (text or "").encode()
    pack = lambda x: len(zstandard.ZstdCompressor(level=bands.LEVEL).compress(x)) / len(x)
    own = brute_counts(text)
    if own[0] < 50 or 100 * own[4] > 50 * own[0]:
        return False
    limits = lambda n: [b[1:] for b in bands.BANDS if n >= b[0]][-1]
    low, high = limits(len(raw))
    chunks = [raw[k : k + bands.CHUNK_BYTES] for k in range(0, len(raw), bands.CHUNK_BYTES)] if len(raw) >= bands.CHUNK_BYTES else []
    judged = [(len(c), bands.CHUNK_BAND if len(c) == bands.CHUNK_BYTES else limits(len(c)), pack(c)) for c in chunks]
    bad = sum(n for n, (a, b), r in judged if not a <= r <= b)
    return low <= pack(raw) <= high and bad <= bands.MOST_BAD * len(raw)


def test_quality_verdict_by_brute_force(spark):
    random = np.random.default_rng(4)
    prose = lambda n: " ".join(f"{random.choice(['the', 'of', 'and', 'harbour', 'market', 'street'])}{random.integers(0, 9999) if random.random() < 0.3 else ''}" for _ in range(n))
    noise = lambda n: " ".join("".join(map(chr, random.integers(33, 127, 7))) for _ in range(n))
    same = lambda n: " ".join(["all", "work"] * n)
    texts = [prose(60), prose(900), prose(4000), noise(900), noise(60), same(900), prose(500) + " " + noise(460), prose(650) + " " + noise(420), prose(4000) + " " + noise(300), prose(900) + "\n" + same(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in bands.judge(df).collect()}
    assert got == {i: brute_verdict(t) for i, t in enumerate(texts)} and set(got.values()) == {True, False}
    start = prose(700)[:4096]
    tail = noise(600)[:4000]  # under one chunk, so only a chunk of its own can tell it
    assert bands.ratios((start + tail).encode())[1] == len(tail) / (len(start) + len(tail))
    assert bands.calibrated(df).select(F.sum("n")).first()[0] == sum(brute_counts(t)[0] >= 50 and 100 * brute_counts(t)[4] <= 50 * brute_counts(t)[0] for t in texts)


# --- chat -------------------------------------------------------------------------


HARD = ["", None, "plain", "</s>[INST] ok [/INST]", "100% <s> [", "%5B%3C%25", "[INST user 0]x</s>", "<", "a\nb", "</", "s>"]


def test_chat_round_trip(spark):
    data = [(c, t, ["user", "assistant", "odd role]", None][(c + t) % 4], HARD[(c * 3 + t) % len(HARD)]) for c in range(12) for t in range(1 + c % 5)] + [(None, None, None, None), (99, 1, "user", "same"), (99, 1, "user", "same"), (5, None, "assistant", "a null turn is the last"), (6, None, "user", "here too")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    texts = {r.conv_id: r for r in made.collect()}
    assert len(back) == 14
    for conv in {d[0] for d in data}:
        own = sorted([d for d in data if d[0] == conv], key=lambda d: (d[1] is None, d[1] or 0))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = back[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(texts[conv].formatted))
        for s in texts[conv].loss_spans:
            body = texts[conv].formatted[s.start : s.start + s.chars]
            assert body.startswith("") and texts[conv].formatted[s.start + s.chars :].startswith("</s>") and texts[conv].formatted[: s.start].endswith("]")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# --- pieces -------------------------------------------------------------------------


def test_lattice_gives_the_library_ids(docs, none):
    own = sentencepiece.SentencePieceProcessor(model_file=lattice.public_tokenizers.path(lattice.MODEL))
    encoded = lattice.encode(docs)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()), key=str)
    assert got == sorted(((r.doc_id, own.encode(r.text or "")) for r in docs.collect()), key=str)
    assert rows(lattice.decode(encoded)) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert lattice.encode(none).count() == 0


@pytest.mark.parametrize("word", ["▁the", "abcabc", "▁▁▁▁▁", "xé", "internationalisation"])
def test_heap_and_fold_agree(spark, word):
    vocabulary = lattice.Vocabulary.load(lattice.public_tokenizers.path(lattice.MODEL))
    df = spark.createDataFrame([(word,)], "word string")
    assert lattice.spell(df, vocabulary).first().ids == lattice._long(df, vocabulary).first().ids


def test_blocks_of_a_lattice_stay_in_place(spark, docs):
    """However many partitions a shuffle has, ids move to the blocks and no block moves."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        plan = lattice.encode(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "FileScan" in plan and not re.search(r"Exchange hashpartitioning\(block[^\n]*\n[^\n]*FileScan", plan)


def test_substrings_are_those_that_may_be_pieces(spark):
    """A word's pieces are all there, and fewer than half of its substrings are looked up."""
    vocabulary = lattice.Vocabulary.load(lattice.public_tokenizers.path(lattice.MODEL))
    pieces, longest = {p for p, _, _ in vocabulary.pieces}, vocabulary.longest
    words = ["▁internationalisation", "▁ofontisthe", "ab", "▁", "日本"]
    got = collections.defaultdict(set)
    for r in lattice.substrings(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect():
        assert r.sub == r.word[r.s : r.s + r.k] and (r.s, r.k) not in got[r.word]
        got[r.word].add((r.s, r.k))
    assert set(got) == set(words)
    for w in words:
        every = {(s, k) for s in range(len(w)) for k in range(1, min(longest, len(w) - s) + 1)}
        assert {(s, k) for s, k in every if k > 1 and w[s : s + k] in pieces} <= got[w] <= every
        assert len(w) < 10 or 2 * len(got[w]) < len(every)


def test_ids_and_digests_come_from_one_worker(spark, small):
    plan = lattice.query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_layout_is_packed_and_read_back():
    numbers = np.random.default_rng(1).zipf(1.3, 100_000).astype(np.uint32)
    raw = lattice._packed(numbers)
    assert np.array_equal(lattice._unpacked(raw), numbers) and len(lattice._unpacked(lattice._packed(numbers[:0]))) == 0
    assert len(raw) < len(zstandard.ZstdCompressor(level=1).compress(numbers.tobytes()))


def test_viterbi_fold(spark):
    pieces = [("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -2.0), ("ba", 3, -0.5), ("aba", 4, -9.0)]
    vocabulary = lattice.Vocabulary(pieces, 100, [])
    best = {}

    def brute(w):
        if w not in best:
            best[w] = (0.0, []) if not w else max((brute(w[k:])[0] + s, [i, *brute(w[k:])[1]]) for p, i, s in pieces if w.startswith(p) for k in [len(p)])
        return best[w]

    for word in ("abab", "bbaa", "ababa", "a"):
        got = lattice.spell(spark.createDataFrame([(word,)], "word string"), vocabulary, unigram=True).first().ids
        score = {i: s for _, i, s in pieces}
        assert sum(score[i] for i in got) == pytest.approx(brute(word)[0])


def test_one_pass_merges_as_the_heap_does(spark):
    vocabulary = lattice.Vocabulary.load(lattice.public_tokenizers.path(lattice.MODEL))
    assert vocabulary.odd() == {lattice.SPACE * 2}
    scores, number = {p: s for p, _, s in vocabulary.pieces}, {p: i for p, i, _ in vocabulary.pieces}
    random = np.random.default_rng(5)
    parts = [p for p, _, _ in vocabulary.pieces if lattice.SPACE * 2 not in p and len(p) > 1]
    words = {("".join(random.choice(parts, int(random.integers(1, 9))))[: lattice.LONG]) for _ in range(3000)} | {"日本😀é" * 15}
    words = {w for w in words if lattice.SPACE * 2 not in w}
    got = {r.word: r.ids for r in lattice.spell(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    assert got == {w: [i for t in lattice.merged(w, scores) for i in ([number[t]] if t in number else [vocabulary.first_byte + b for b in t.encode()])] for w in words}


def test_runs_of_spaces_and_long_words(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=lattice.public_tokenizers.path(lattice.MODEL))
    texts = [" " * k + "a" + " " * (2 * k) + "b" for k in range(0, 40, 3)] + ["ab" * 200, "a▁b ▁", "x" * 61, "é" * 59]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in lattice.encode(df).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate(texts)}


def test_long_words_take_the_viterbi_path(spark):
    pieces = [("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -2.0), ("ba", 3, -0.5), ("aba", 4, -1.5)]
    vocabulary = lattice.Vocabulary(pieces, 100, [])
    random = np.random.default_rng(3)
    long = ["".join(random.choice(list("aabbé"), lattice.LONG - k)) for k in range(3)]
    words = spark.createDataFrame([(w,) for w in long], "word string").cache()
    got = {r.word: r.ids for r in lattice._long(words, vocabulary, unigram=True).collect()}
    assert got == {r.word: r.ids for r in lattice.spell(words, vocabulary, unigram=True).collect()}


# --- queries and pipeline -------------------------------------------------------------


@pytest.mark.parametrize("key", sorted(llm.queries()))
def test_query(spark, small, key):
    import duckdb

    got = llm.queries()[key](spark, small)
    columns = sorted(got.columns)
    own = sorted(str([r[c] for c in columns]) for r in got.collect())
    assert own
    if key in llm.oracle_sql():
        con = duckdb.connect()
        for name in ("documents", "pages", "conversations"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
        want = con.sql(llm.oracle_sql()[key])
        at = [want.columns.index(c) for c in columns]
        assert own == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_pipeline(spark, docs, none):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept, ids = docs.select("doc_id", "text", "lang", "source", "n_chars"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "").cache()
        ids[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "packing":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    learned = langid.learn_documents(docs)[0]
    assert learned == ["en"]
    assert {3, 4, 5, 6}.isdisjoint(ids["language"]) and {0, 1, 2, 9, 10, 11, 13} <= ids["language"]
    assert 1 in ids["exact_dedup"] and {0, 13}.isdisjoint(ids["exact_dedup"]) and ids["packing"] == ids["pii"] == ids["near_dedup"]
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_urls_learn_from_every_labelled_row(spark):
    said = lambda i: (f"news{i % 9}.com/p{i}", "allow") if i % 3 else (f"spam{i % 7}.net/es/{'x' * (600 if i == 3 else 3)}{i}", "block")
    data = [said(i) for i in range(25_000)]
    rows = spark.createDataFrame(data, "t string, label string")
    model = urls.learn(rows)
    kept = {r.t for r in rows.where(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(urls.CALIBRATE)) == 0).select("t").collect()}
    for label, own in zip(("allow", "block"), model.models):
        fit = [t for t, x in data if x == label and t not in kept]
        assert own.total[""] == sum(map(len, fit)) and own.counts["s"] == sum(t.count("s") for t in fit)
    scored = sorted((model.score(t), x == "allow") for t, x in data if t in kept)
    assert model.threshold == pytest.approx(best_threshold(scored))


def best_threshold(scored):
    scores, good, bad = sorted({s for s, _ in scored}), sum(y for _, y in scored), sum(not y for _, y in scored)
    balanced = lambda t: sum(s >= t for s, y in scored if y) / good + sum(s < t for s, y in scored if not y) / bad
    return max((round(balanced(t), 12), -abs(t), t) for t in [scores[0], *[(a + b) / 2 for a, b in zip(scores, scores[1:])]])[2]


def test_threshold_of_urls_over_several_tasks(spark):
    rng = random.Random(5)
    scored = [(round(rng.gauss(0.4 if y else -0.3, 0.5), 2), y) for y in (True, True, False) for _ in range(150)]
    got = urls.threshold(spark.createDataFrame(scored, "score double, good boolean").repartition(5))
    assert got == pytest.approx(best_threshold(scored))
    assert urls.threshold(spark.createDataFrame([(0.5, True)], "score double, good boolean")) == 0.0


def test_language_learns_from_every_labelled_row(spark):
    data = [(i, "aa" if i % 2 else "bb", "lorem" if i % 2 else "ipsum") for i in range(25_000)] + [(i, f"l{i}", "zyx") for i in range(25_000, 25_040)]
    langs, prototypes = langid.learn(spark.createDataFrame(data, "id long, lang string, text string").repartition(4))
    assert langs == ["aa", "bb", *[f"l{i}" for i in range(25_000, 25_040)]] and np.allclose(prototypes[2], langid.profile("zyx"), atol=1e-6)
    model = langs, prototypes
    floors = langid.floors(spark.createDataFrame(data, "id long, lang string, text string"), model)
    assert floors and list(floors.values()) == pytest.approx([langid.FLOOR] * len(floors), abs=1e-5)


def test_personal_data_is_learned_from_every_proposal(spark, monkeypatch):
    said = lambda i: f"mail u{i}@mail.example, ip 10.0.{i % 200}.7 or call +1 ({200 + i}) 555-{1000 + i} " + " ".join(f"{k % 9}.{k}.1" for k in range(90))
    data = [(i, said(i)) for i in range(60)]
    seen = {}
    fit = pii.Boosted.fit
    monkeypatch.setattr(pii.Boosted, "fit", lambda self, codes, y, n, edges: seen.update(n=n.sum(), right=(n * y).sum()) or fit(self, codes, y, n, edges))
    model = pii.learn(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    labels = []
    for i, t in data:
        if hashlib.md5(str(i).encode()).digest()[0] % 4:
            base, own = pii.base_spans(t), pii.proposals(t)
            labels += [pii.right(t, p, set(base)) for p in own] + [good for _, _, good in pii.planted(t, base, own)]
    labels = [x for x in labels if x is not None]
    assert seen == {"n": len(labels), "right": sum(labels)} and len(labels) > 90 * 40 and model.trees


def test_counted_rows_give_the_same_trees():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (3000, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 2, 3000) > 9).astype(float)
    edges = [np.unique(np.quantile(x[:, j], pii.Boosted().quantiles())) for j in range(4)]
    codes = pii.binned(x, edges)
    one = pii.Boosted().fit(codes, y, np.ones(3000), edges)
    rows, n = np.unique(np.column_stack([codes, y]), axis=0, return_counts=True)
    many = pii.Boosted().fit(rows[:, :4].astype(int), rows[:, 4], n.astype(float), edges)
    assert len(rows) < 2600 and np.allclose(one.probability(x), many.probability(x))

"""Personal data: fixed base patterns, and spans chosen by candidate boosting.

Base spans are found by pattern and check alone and always stay. Beside them,
high-recall generators propose overlapping spans of e-mail addresses, network
addresses, card and phone numbers, and secrets. Boosted trees give each proposal
a probability from its format and context; a threshold for each kind, the lowest
that reaches ``PRECISION`` on rows kept out of fitting, selects the rest. Of
overlapping choices the most probable stays, and none may overlap a base span.

Labels need no annotation: a proposal is right if it is exactly a base span, or
for a secret, a quoted value after a word that names one; shifted and other
proposals are wrong. Forms that only the generators know (national phone
numbers, IPv6, ``a (at) b (dot) c``, card numbers with dots or slashes) are
learned from planted ones: base spans are rewritten so where they stand, beside
look-alikes that are wrong, and secrets get other lengths. What the texts themselves hold of such forms, and
what lies inside a base span, has no label and is left out. Thresholds count
only proposals that could be added, so none that meets a base span. All proposals of all
rows are used for fitting: borders of bins are their exact quantiles, equal binned proposals are counted
in Spark, and the trees are fitted on the different ones with their counts. Every text is searched whole.

Defined results: a null text is empty and has no span; repeated rows are
searched each; an empty table gives an empty table; without any right proposal
only base spans are returned; other columns are ignored by ``find`` and kept by
``redact``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.boosting import Boosted, binned
from plaza.llm.common import Scratch, forget, released, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PRECISION = 0.95
LEAST_RIGHT = 20  # of a kind, in the rows that set its threshold

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match inside a run of digits can only follow a failed one from the run's start, so only starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind, in the order of BASE_KINDS; failed checks drop a match."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


# --- proposals -------------------------------------------------------------

_GENERATORS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,6}(?:\.[0-9]{1,6}){2,5}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?[0-9(][0-9().\x20/-]{5,24}[0-9](?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}\x20)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")),
]
_NAMED = re.compile(r"(?:token|secret|password|passwd|api_?key|key)\s{0,3}[=:]\s{0,3}[\"']$", re.I)
_CUES = (("mail", "@"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "iban"), ("tel", "phone", "call", "fax", "mobile"), ("token", "secret", "key", "password"))


def proposals(text: str) -> list[Span]:
    # a text without a sign that each match of a kind holds isn't searched for the kind
    signs = {"email": "@" in text or "at)" in text or "at]" in text, "secret": True, "ip": "." in text or ":" in text}
    signs["card"] = signs["phone"] = bool(_DIGIT.search(text))
    return sorted({(kind, *m.span()) for kind, pattern in _GENERATORS if signs[kind] for m in pattern.finditer(text)}, key=lambda s: s[1:])


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context; no check digit and no range is among them."""
    kind, s, e = span
    own = text[s:e]
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", own) if g]
    digits = sum(map(own.count, "0123456789"))
    letters = sum(map(str.isalpha, own))
    before, after = text[max(0, s - 24) : s], text[e : e + 2]
    low = before.lower()
    return [
        KINDS.index(kind), e - s, digits, letters, digits / (e - s), len(set(own)) / (e - s), len(groups), max(groups, default=0), min(groups, default=0),
        own.count("."), own.count("-"), own.count(" "), own.count("(") + own.count(")"), own.count("@"), own[:1] == "+", own.count(":"),
        sum(map(own.count, "abcdefABCDEF")), sum(map(str.isupper, own)), bool(before) and before[-1].isalnum(), bool(before) and before[-1] in "+-.(\"'=:",
        bool(after) and after[0].isalnum(), bool(after) and after[0] in "\"')", after[:1] in (".", "-", "@") and after[1:2].isalnum(), any(c in low for c in _CUES[KINDS.index(kind)]), bool(_NAMED.search(before)),
    ]


def right(text: str, span: Span, base: set[Span]) -> bool | None:
    """Whether a proposal is right; None if that can't be told."""
    kind, s, e = span
    if kind == "secret":
        return bool(_NAMED.search(text[max(0, s - 24) : s])) and text[e : e + 1] in ("'", '"')
    if span in base:
        return True
    if any(k == kind and b <= s and e <= f for k, b, f in base) or own_form(kind, text[s:e]):
        return None
    return False


_NATIONAL = re.compile(r"(?:\+[0-9]{1,3}\x20)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
_OBFUSCATED = re.compile(r"[(\[](?:at|dot)[)\]]")


def own_form(kind: str, own: str) -> bool:
    """Whether ``own`` has a form of its kind that base patterns don't know."""
    if kind == "email":
        return bool(_OBFUSCATED.search(own))
    if kind == "phone":
        return bool(_NATIONAL.fullmatch(own))
    if kind == "ip":
        return ":" in own and _is_ipv6(own)
    digits = re.sub("[^0-9]", "", own)
    return kind == "card" and ("." in own or "/" in own) and 16 <= len(digits) <= 19 and luhn(digits)


def _is_ipv6(own: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(own))
    except ValueError:
        return False


def variants(kind: str, own: str, pick: int) -> list[tuple[str, bool]]:
    """Forms of the base span ``own`` that only the generators know, and look-alikes that are wrong; ``pick`` is a hash."""
    digits = re.sub("[^0-9]", "", own)
    if kind == "email":
        name, _, domain = own.rpartition("@")
        signs = (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", ".")
        return [(name + at + domain.replace(".", dot), True) for at, dot in signs]
    if kind == "phone":
        area, mid, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        if len(area) < 3:
            return []
        day = f"{1990 + pick % 40}-{pick % 12 + 1:02d}-{pick % 28 + 1:02d}"
        wrong = day, f"{day} {pick % 24:02d}", f"{digits[:4]}-{last}", f"{pick % 9 + 1} {mid} {digits[:3]}"
        return [(x, True) for x in (f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}")] + [(x, False) for x in wrong]
    if kind == "ip":
        groups = [f"{(pick >> 3 * k) & (0xFFFF if k % 2 else 0xFFF):x}" for k in range(8)]
        forms = ":".join(groups), ":".join(["2001", "db8", *groups[2:]]), f"2001:db8::{groups[0]}:{groups[1]}", f"fe80::{groups[0]}:{groups[1]}:{groups[2]}"
        pairs = [f"{(pick >> 5 * k) & 0xFF:02x}" for k in range(6)]
        wrong = ":".join(pairs), ":".join(f"{int(x, 16) % 60:02d}" for x in pairs[:4])
        return [(x, True) for x in forms] + [(x, False) for x in wrong]
    return [(mark.join(digits[k : k + 4] for k in range(0, 16, 4)), True) for mark in "./"] if len(digits) == 16 else []


def planted(text: str, base: list[Span], own: list[Span]) -> list[tuple[str, Span, bool]]:
    """Proposals that meet a rewritten span, with the part of the text that they are in.

    Of each kind the span first by hash is rewritten in every form: of ``base``,
    and of the secrets among the proposals ``own``, which also get other lengths
    and letters, and, as look-alikes, lose the name and quotes around them.
    """
    out = []
    for kind in KINDS:
        found = base if kind != "secret" else [p for p in own if p[0] == kind and right(text, p, set())]
        code, s, e = min(((hashlib.md5(repr((s, text[s:e])).encode()).digest(), s, e) for k, s, e in found if k == kind), default=(b"", 0, 0))
        if not e:
            continue
        before, after = text[max(0, s - 100) : s], text[e : e + 100]
        if kind == "secret":
            letters = text[s:e].translate(_TO_LETTERS)
            forms = letters, text[s:e] * 3, letters * 8, text[s:e] * 40, letters * 200
            places = [(before, x, after, True) for x in forms] + [(_NAMED.sub("", before), x, after[1:], False) for x in forms]
        else:
            places = [(before, x, after, good) for x, good in variants(kind, text[s:e], int.from_bytes(code[:8], "big"))]
        for before, form, after, good in places:
            near, at = before + form + after, (len(before), len(before) + len(form))
            out += [(near, p, good and p == (kind, *at)) for p in proposals(near) if p[1] < at[1] and at[0] < p[2]]
    return out


_TO_LETTERS = str.maketrans("0123456789", "ghijklmnop")


class Model:
    def __init__(self, trees: Boosted | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The spans that the method adds to ``base``."""
        wanted = [p for p in proposals(text) if p[0] in self.thresholds] if self.trees else []
        taken = _merged(base)
        wanted = [p for p in wanted if not _meets(taken, p[1], p[2])]
        if not wanted:
            return []
        chance = self.trees.probability(np.array([features(text, p) for p in wanted], float))
        out = []
        for k in np.argsort(-chance, kind="stable"):
            kind, s, e = wanted[k]
            if chance[k] >= self.thresholds[kind] and not _meets(taken, s, e):
                out.append(wanted[k])
                taken.insert(bisect_left(taken, (s, e)), (s, e))
        return out


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places covered by ``spans``, as sorted spans that don't overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _meets(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether [s, e) overlaps one of the sorted spans, which don't overlap each other."""
    at = bisect_left(taken, (e, -1))
    return at > 0 and taken[at - 1][1] > s


def _slices(batches, rows: int = 1024):
    """Batches in parts, so that a worker holds what it makes of few rows, and nothing of operators before."""
    forget()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def learn(docs: DataFrame) -> Model:
    def examples(batches):
        for batch in _slices(batches, 128):
            out, right_, kept = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                taken = _merged(base)
                one_in_four = hashlib.md5(str(doc).encode()).digest()[0] % 4 == 0
                own = proposals(text)
                known = set(base)
                labels = [(text, p, right(text, p, known), not _meets(taken, p[1], p[2])) for p in own]
                labels += [(near, p, good, True) for near, p, good in planted(text, base, own)]
                for where, span, good, free in labels:
                    if good is not None:
                        out.append([float(v) for v in features(where, span)])
                        right_.append(good)
                        kept.append((1 if free else 2) if one_in_four else 0)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())), pa.array(right_, pa.bool_()), pa.array(kept, pa.int32())], names=["x", "y", "kept"])

    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.cut(docs.select("doc_id", "text").mapInArrow(released(examples), "x array<float>, y boolean, kept int"))
        width, trees = len(features("0", ("ip", 0, 1))), Boosted()
        shares = F.array(*map(F.lit, trees.quantiles()))
        borders = rows.where("kept = 0").agg(*[F.percentile(F.col("x")[j].cast("double"), shares).alias(f"x{j}") for j in range(width)]).first()
        if borders.x0 is None:
            return Model(None, {})
        edges = [np.unique(np.array(e, float)) for e in borders]

        def coded(batches):
            for batch in batches:
                x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(float)
                codes = binned(x, edges).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2)], names=["kind", "codes", "y", "kept"])

        got = rows.mapInArrow(coded, "kind int, codes binary, y boolean, kept int").groupBy("kind", "codes", "y", "kept").count().toArrow().combine_chunks()
    y, kept, kind, n = (np.array(got[c].to_pylist(), t) for c, t in (("y", float), ("kept", int), ("kind", int), ("count", float)))
    codes = np.frombuffer(b"".join(got["codes"].to_pylist()), np.uint8).reshape(len(y), width).astype(np.int64)
    order = np.lexsort([kept, y, kind, *codes.T])  # the same model whatever order tasks end in
    codes, y, kept, kind, n = codes[order], y[order], kept[order], kind[order], n[order]
    fit, free = kept == 0, kept == 1  # 2: kept out of fitting, but meets a base span and is never added
    if not y[fit].any() or not y[free].any():
        return Model(None, {})
    trees.fit(codes[fit], y[fit], n[fit], edges)
    return Model(trees, thresholds(trees.probability_of(codes[free]), y[free], kind[free], n[free]))


def thresholds(chance: np.ndarray, y: np.ndarray, kind: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """For each kind the lowest probability from which on ``PRECISION`` of the proposals are right; each stands for ``n`` equal ones."""
    out = {}
    for k, name in enumerate(KINDS):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-chance[own], kind="stable")]
        p, hit, met = chance[own], np.cumsum(n[own] * y[own]), np.cumsum(n[own])
        last = np.append(p[1:] < p[:-1], True)[: len(p)]  # equal probabilities stand or fall together
        good = np.flatnonzero(last & (hit >= PRECISION * met) & (hit >= LEAST_RIGHT))
        if len(good):
            out[name] = float(max(p[good[-1]], 0.5))
    return out


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans, and arrays of the base spans and of all spans (kind, start, end)."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    def rows(batches):
        for batch in _slices(batches):
            out = {"doc_id": batch.column(0).to_pylist(), "base": [], "spans": []}
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                every = sorted([*base, *model.added(text, base)], key=lambda s: (KINDS.index(s[0]), *s[1:]))
                for name, spans in (("base", base), ("spans", every)):
                    out[name].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(rows), f"doc_id long, base {kind}, spans {kind}")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", _SPANS), ("spans", _SPANS)])


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    out, at, done = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda p: (p[1], -p[2])):
        if s >= done:
            out += [text[at:s], f"[{kind.upper()}]"]
        done = at = max(done, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_chars``, if there, made to fit; a null text stays null."""

    def rows(batches):
        for batch in _slices(batches):
            names = batch.schema.names
            old = batch.column(names.index("text")).to_pylist()
            new = []
            for text in old:
                base = base_spans(text) if text else []
                spans = [*base, *(model.added(text, base) if text else [])]
                new.append(redacted(text, spans) if spans else text)
            out = [*batch.columns]
            out[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                n = out[names.index("n_chars")]
                out[names.index("n_chars")] = pa.array([len(b) if b != a else c for a, b, c in zip(old, new, n.to_pylist())], n.type)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.mapInArrow(released(rows), docs.schema)


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

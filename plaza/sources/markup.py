"""Feeds, calendars, JSON-LD and HTML as rows. Parsers are small Arrow-batched functions; everything around them is Spark."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from plaza.functions.text import borders, either


def rows_of(*names: str, **others: DataType) -> ArrayType:
    """An array of structs: text fields, and those of other types."""
    return ArrayType(StructType([*[StructField(n, StringType()) for n in names], *[StructField(n, t) for n, t in others.items()]]))


MOST_BYTES = 1 << 20
MOST_ITEMS = 100

ENTRY = rows_of("title", "link", "guid", "published", "summary")


def entries_of(xml: str | None, most: int | None = MOST_ITEMS) -> list[dict] | None:
    """Items of an RSS, RDF or Atom text; None if it is malformed, declares entities, is too long or holds more than ``most``."""
    if not xml or len(xml.encode("utf-8", "surrogatepass")) > MOST_BYTES or re.search(r"<!(DOCTYPE|ENTITY)", xml, re.I):
        return None
    try:
        root = ElementTree.fromstring(xml.encode())
    except ElementTree.ParseError:
        return None
    local = lambda e: e.tag.rpartition("}")[2].lower()
    if local(root) not in ("rss", "rdf", "feed"):
        return None
    items = [e for e in root.iter() if local(e) in ("item", "entry")]
    if most is not None and len(items) > most or any(local(x) in ("item", "entry") for e in items for x in e.iter() if x is not e):
        return None
    out = []
    for e in items:
        got: dict[str, str] = {}
        for x in e:
            name, text = local(x), (x.text or x.get("href") or "").strip()
            got.setdefault({"pubdate": "published", "date": "published", "updated": "published", "id": "guid", "description": "summary"}.get(name, name), text)
        out.append({k: got.get(k) for k in ("title", "link", "guid", "published", "summary")})
    return out


@F.pandas_udf(ENTRY)
def feed_entries(xml: pd.Series) -> pd.Series:
    """Entries of each feed; null where the feed isn't valid as a whole."""
    return xml.map(entries_of)


def owned_entries(xml: str | None) -> list[dict] | None:
    """At most 80 entries of a first-party feed, none of an empty one; null where it isn't valid, or an entry of those lacks its title or link."""
    found = entries_of(xml, None)
    some = (found or [])[:80]
    return None if found is None or not all(e["title"] and e["link"] for e in some) else some


@F.pandas_udf(ENTRY)
def owned_feed_entries(xml: pd.Series) -> pd.Series:
    """At most 80 entries of a first-party feed; null where it isn't valid."""
    return xml.map(owned_entries)


EVENT = rows_of("uid", "summary", "starts", "ends", "location", all_day=BooleanType())


def calendar_events(text: str | None) -> list[dict]:
    """Events of an iCalendar text: folded lines joined, escapes undone, dates, local and UTC instants told apart."""
    lines = re.sub(r"\r?\n[ \t]", "", text or "").splitlines()
    out, now = [], None
    for line in lines:
        if line == "BEGIN:VEVENT":
            now = {}
        elif line == "END:VEVENT" and now is not None:
            out.append({k: now.get(k) for k in ("uid", "summary", "starts", "ends", "all_day", "location")})
            now = None
        elif now is not None and ":" in line:
            head, _, value = line.partition(":")
            name = head.split(";")[0].upper()
            if name in ("DTSTART", "DTEND"):
                m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)(Z?))?", value)
                if m:
                    day = "-".join(m.groups()[:3])
                    now["starts" if name == "DTSTART" else "ends"] = day if m[4] is None else f"{day}T{m[4]}:{m[5]}:{m[6]}{m[7]}"
                    if name == "DTSTART":
                        now["all_day"] = m[4] is None
            elif name in ("UID", "SUMMARY", "LOCATION"):
                now[name.lower()] = re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value)
    return out


@F.pandas_udf(EVENT)
def ics_events(text: pd.Series) -> pd.Series:
    return text.map(calendar_events)


def walk(value, depth: int = 0, most: int = 14):
    """Every object of a JSON tree, to a bounded depth, in order."""
    if depth > most:
        return
    if isinstance(value, dict):
        yield value
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(child, depth + 1, most)


def json_blocks(html: str | None, kind: str) -> list:
    out = []
    for block in re.findall(rf'(?is)<script[^>]*type="{re.escape(kind)}"[^>]*>(.*?)</script>', html or ""):
        try:
            out.append(json.loads(re.sub(r"[\x00-\x1f]+", " ", block)))
        except ValueError:
            continue
    return out


LD = rows_of("type", "name", "start", "end", "url")


@F.pandas_udf(LD)
def jsonld_events(html: pd.Series) -> pd.Series:
    """Events of a page's linked data, ``@graph`` included; malformed blocks are skipped."""

    def one(page):
        found = []
        for block in json_blocks(page, "application/ld+json"):
            for node in walk(block):
                kinds = node.get("@type") if isinstance(node.get("@type"), list) else [node.get("@type")]
                kind = next((k for k in kinds if isinstance(k, str) and k.endswith("Event")), None)
                if kind:
                    found.append({"type": kind, **{k: str(node[s]) if node.get(s) is not None else None for k, s in (("name", "name"), ("start", "startDate"), ("end", "endDate"), ("url", "url"))}})
        return found

    return html.map(one)


@F.pandas_udf(rows_of("name", "start", "home"))
def embedded_games(html: pd.Series) -> pd.Series:
    """Objects of embedded JSON that have a start and a home team."""

    def one(page):
        nodes = [n for block in json_blocks(page, "application/json") for n in walk(block)]
        return [{"name": n.get("name"), "start": str(n["start"]), "home": str(n["home"])} for n in nodes if n.get("start") and n.get("home")]

    return html.map(one)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


LINK = rows_of("url", "label", ordinal=IntegerType())


@F.pandas_udf(LINK)
def html_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Anchors of a page as absolute http links, in order."""

    def one(page, root):
        parser = _Links()
        parser.feed(page or "")
        urls = [(urljoin(root or "", h), t) for h, t in parser.links]
        return [{"ordinal": k, "url": u, "label": t} for k, (u, t) in enumerate(urls) if u.startswith(("http://", "https://"))]

    return pd.Series([one(p, b) for p, b in zip(html, base)])


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Cards(HTMLParser):
    """Elements of one tag that are closed, with the texts of given tags inside them."""

    def __init__(self, card: str, fields: tuple[str, ...]):
        super().__init__()
        self.card, self.fields = card, fields
        self.stack: list[str] = []
        self.open: list[dict] = []
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.stack.append(tag)
        if tag == self.card:
            self.open.append({f: [] for f in self.fields})
        if self.open and tag in self.fields:
            self.open[-1][tag].append("")

    def handle_data(self, data):
        if self.open and self.stack:
            inner = next((t for t in reversed(self.stack) if t in self.fields), None)
            if inner and self.open[-1][inner]:
                self.open[-1][inner][-1] += data

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack and self.stack.pop() != tag:
            pass
        if tag == self.card and self.open:
            self.cards.append(self.open.pop())


def html_cards(card: str, heading: str, *fields: str):
    """A function of a page's HTML: its closed cards with exactly one heading, and how many were not closed or had another number."""
    cards = rows_of("heading", fields=ArrayType(StringType()))
    kind = StructType([StructField("cards", cards), StructField("unclosed", IntegerType()), StructField("rejected", IntegerType())])

    @F.pandas_udf(kind)
    def read(html: pd.Series) -> pd.DataFrame:
        rows = []
        for page in html:
            parser = _Cards(card, (heading, *fields))
            parser.feed(page or "")
            parser.close()
            good = [c for c in parser.cards if len(c[heading]) == 1]
            clean = lambda x: " ".join(x.split())
            rows.append(([{"heading": clean(c[heading][0]), "fields": [clean(x) for f in fields for x in c[f]]} for c in good], len(parser.open), len(parser.cards) - len(good)))
        return pd.DataFrame(rows, columns=["cards", "unclosed", "rejected"])

    return read


def table_rows(html) -> Column:
    """Cells of each row of a page's tables, as text."""
    rows = F.regexp_extract_all(either(html), F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), text))


def heading_blocks(html, level: str = "h[1-3]") -> Column:
    """A page cut at its headings: from each to the next."""
    return F.filter(F.split(F.regexp_replace(either(html), f"(?i)(<{level}[ >])", "\x00$1"), "\x00"), lambda x: x.rlike(f"(?i)^<{level}[ >]"))


# --- robots ------------------------------------------------------------------

# The characters that stand for themselves in a URL's path and query, and of them those whose escapes mean the same.
_UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_PLAIN = _UNRESERVED + ":/?#[]@!$&'()*+,;=%"
_OCTET = re.compile(r"%[0-9A-Fa-f]{2}|[^" + re.escape(_PLAIN) + "]")


def _octet(match: re.Match) -> str:
    found = match[0]
    if len(found) == 3:
        meant = chr(int(found[1:], 16))
        return meant if meant in _UNRESERVED else found.upper()
    return "".join(f"%{byte:02X}" for byte in found.encode("utf-8", "surrogatepass"))


def octets(path: str) -> str:
    """A path as the octets it stands for: escapes of unreserved characters undone, other escapes in upper case, whatever may not stand in a URL escaped."""
    return _OCTET.sub(_octet, path)


@F.pandas_udf(StringType())
def normal_octets(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else octets(p))


MOST_ROBOTS_BYTES = 512 * 1024
_UNREADABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")
_RECORD = re.compile(r"([A-Za-z][\w-]*)\s*:\s*([^<>]*)", re.ASCII)
#: What the value of a record must look like; a record that no robots text has fits nothing.
_VALUES = {
    "user-agent": r"\*|[A-Za-z_-]+", "allow": r"(/.*)?", "disallow": r"(/.*)?", "sitemap": r"(?i:https?://[^/\s]).*",
    "error": r"(?!)", "status": r"(?!)", "message": r"(?!)",
}
_RULES = ("user-agent", "allow", "disallow")


def robots_records(text: str) -> list[tuple[str, str]] | None:
    """Names (lower case) and values of a robots text; empty for an empty one, null for what is none.

    A robots text has records alone, at least one of them naming an agent or a
    sitemap, agents before rules, and absolute paths in rules.
    """
    if len(text.encode("utf-8", "surrogatepass")) > MOST_ROBOTS_BYTES or _UNREADABLE.search(text):
        return None
    lines = filter(None, (line.partition("#")[0].strip() for line in re.split(r"\r\n?|\n", text)))
    found = [_RECORD.fullmatch(line) for line in lines]
    if not all(found):
        return None
    records = [(name.lower(), value.strip()) for name, value in (match.groups() for match in found)]
    fit = all(re.fullmatch(_VALUES.get(name, ".*"), value, re.S) for name, value in records)
    rules = [name for name, _ in records if name in _RULES]
    said = not records or any(name in ("user-agent", "sitemap") for name, _ in records)
    return records if fit and said and rules[:1] in ([], ["user-agent"]) else None


def _blocks(records: list[tuple[str, str]]) -> list[tuple[list[str], list[str]]]:
    """Agents (lower case) and denied paths of each run of agents with the run of other records after it."""
    runs = [(is_agent, list(run)) for is_agent, run in groupby(records, lambda r: r[0] == "user-agent")]
    out = []
    for (is_agent, run), (_, after) in zip(runs, [*runs[1:], (False, [])]):
        if is_agent:
            out.append(([agent.lower() for _, agent in run], [path for name, path in after if name == "disallow" and path]))
    return out


def _pattern(path: str) -> str:
    """A denied path as a regular expression: a star for any characters, a dollar sign at the end for the end.

    Each star takes the nearest place and is not tried again, so that patterns of
    strangers cost no more than their length times the target's.
    """
    first, *rest = map(re.escape, octets(path.removesuffix("$")).split("*"))
    end = path.endswith("$")
    last = [f".*{rest.pop()}"] if rest and end else []
    return first + "".join(f"(?>.*?{part})" for part in rest) + "".join(last) + (r"\Z" if end else "")


class Robots:
    """What the records of a robots text deny an agent; rules only ever deny, an Allow line opens nothing.

    The groups that name the agent count together, else those for all agents.
    ``cautious`` denies more, for who must not reopen what a simpler reader kept
    closed: there every record but a rule ends a group as well, the first group
    with the agent's name inside one of its own counts, and its paths are plain
    prefixes. ``skip`` names records that this reader doesn't see.
    """

    def __init__(self, records: list[tuple[str, str]], agent: str, cautious: bool = True, skip: tuple[str, ...] = ()):
        agent = agent.lower()
        groups = _blocks([r for r in records if r[0] in _RULES])
        meant = agent if any(agent in agents for agents, _ in groups) else "*"
        self.denied = [re.compile(_pattern(path), re.S) for agents, paths in groups if meant in agents for path in paths]
        simple = _blocks([r for r in records if r[0] not in skip]) if cautious else []
        chosen = [paths for agents, paths in simple if any(agent in a for a in agents)] or [paths for agents, paths in simple if "*" in agents]
        self.prefixes = tuple(chosen[0]) if chosen else ()

    def allow(self, target: str) -> bool:
        """``target``: path and query."""
        normal = octets(target)
        return not target.partition("?")[0].startswith(self.prefixes) and not any(pattern.match(normal) for pattern in self.denied)


def _readings(text: str | None, agent: str, discovery: bool) -> list[Robots] | None:
    records = robots_records(text or "")
    return None if records is None else [Robots(records, agent)] + [Robots(records, agent, skip=("sitemap",))] * discovery


def robots_allow(text: str | None, agent: str, target: str, discovery: bool = False) -> bool:
    """Whether all readings of a robots text allow ``target``; with ``discovery`` one that sees no sitemaps is among them.

    A body that is no robots text allows nothing, an empty or missing one all.
    """
    found = _readings(text, agent, discovery)
    return found is not None and all(r.allow(target) for r in found)


def robots_allowed(agent: str, discovery: bool = False):
    """A function of (robots text, path and query): whether the agent may read it. Each text is read once a batch."""

    @F.pandas_udf(BooleanType())
    def allowed(text: pd.Series, target: pd.Series) -> pd.Series:
        read = {t: _readings(t, agent, discovery) for t in text.fillna("").unique()}
        return pd.Series([found is not None and all(r.allow(p or "") for r in found) for found, p in zip(map(read.get, text.fillna("")), target)])

    return allowed


# --- language of closing and moving ---------------------------------------------------

# Phrases that tell of a closure or a move, and what around them makes it another matter.
LIFECYCLE = {
    "closures": ("permanently closed", "final service", "last day of service", "closing our doors", "will close", "has closed", "is now closed", "decision to close", "decided to close", "end of lockside canteen", "temporarily closed", "will be closed", "closed for the season"),
    "moves": ("we moved", "has moved", "moving to", "relocated", "relocating", "new location"),
}
PERSONAL = ("relocating", "relocated", "moving to")
BIOGRAPHY = r"\b(chef|career|worked|born)\b"
WISH = r"\b(i|i'd|i would)\b[^.!?]*\bconsider\s*$"
EXPANSION = r"\b(soft opening|opening|opened|expanding)\b[^.!?]*$"
ELSEWHERE = r"^[^.!?]{0,70}\b(mississauga|toronto|ottawa|brampton|london ontario)\b"


def lifecycle_text(html) -> Column:
    """Prose in lower case: what stands inside scripts and styles (to the end, if they don't end) and tags is gone, white space is single."""
    opened = F.split(F.lower(either(html)), r"(?=<(?:script|style)[\s>/])")
    # each piece but the first begins with a script or style; what follows its closing tag is prose again
    closed = F.transform(opened, lambda piece: F.when(piece.rlike(r"^<(?:script|style)[\s>/]"), F.concat_ws(" ", F.slice(F.split(piece, r"</(?:script|style)[^>]*>", 2), 2, 1))).otherwise(piece))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(closed, " "), "<[^>]*>", " "), r"\s+", " "))


def _around(text: Column, phrase: str, before: int = 300, after: int = 100) -> Column:
    """before and after of each place where ``phrase`` stands as words."""
    pieces = F.split(text, borders(rf"\b{phrase}\b"), -1)

    def place(k):
        left = F.array_join(F.slice(pieces, F.lit(1), k), phrase)
        at = F.char_length(left)
        return F.struct(F.right(left, F.lit(before)).alias("before"), F.substr(text, at + 1 + len(phrase), F.lit(after)).alias("after"))

    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), place)).otherwise(F.array().cast("array<struct<before:string,after:string>>"))


def _told(text: Column, phrase: str) -> Column:
    if phrase in PERSONAL:
        return F.exists(_around(text, phrase), lambda c: ~((c["before"].rlike(borders(r"\bbefore\s*$")) & c["before"].rlike(borders(BIOGRAPHY))) | c["before"].rlike(borders(WISH))))
    if phrase == "new location":
        return F.exists(_around(text, phrase), lambda c: ~(c["before"].rlike(borders(EXPANSION)) & c["after"].rlike(borders(ELSEWHERE))))
    return text.rlike(borders(rf"\b{phrase}\b"))


def lifecycle_language(html) -> Column:
    """closures and moves: the phrases of each kind that a page tells, in the order of LIFECYCLE; null text has none.

    Biographies and wishes of guests are no moves, nor is a new location opening in another city.
    """
    text = lifecycle_text(F.coalesce(either(html), F.lit("")))
    return F.struct(*[F.array_compact(F.array(*[F.when(_told(text, p), p) for p in phrases])).alias(kind) for kind, phrases in LIFECYCLE.items()])

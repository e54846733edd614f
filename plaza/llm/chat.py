"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as

    <s>[INST role level]body</s>

and reparsed by a deterministic parser: the text is cut at every control string
(``<s>``, ``</s>``, ``[INST``, ``[/INST``); a valid conversation of n turns
gives 3 n + 1 pieces, of which each third holds role, level and body. The turns
recovered are compared with the source. Where they differ, the turns that hold
control strings are rendered again with level 1, whose body has ``%``, ``<`` and
``[`` percent-escaped, and if need be all turns are. Each rendering is compared;
should the last differ too, the job fails.

Defined results: null roles and texts count as empty; turns sort by ``turn``
(null last), then role, then text; repeated rows are turns of their own; a null
``conv_id`` is a conversation; an empty table gives an empty table; other
columns are ignored. One conversation must fit a row, as its formatted text is
one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.llm.common import or_empty, table

CONTROL = r"</?s>|\[/?INST"
HEAD = r"^ ([^ \]]*) ([01])\]"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


BODY = [("%", "%25"), ("<", "%3C"), ("[", "%5B")]
ROLE = [*BODY, (" ", "%20"), ("]", "%5D")]


def escape(text: Column, pairs=BODY) -> Column:
    return _swap(text, pairs)


def unescape(text: Column, pairs=BODY) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(pairs)])


def render(turns: Column, level) -> Column:
    """The text of ``turns``; ``level(turn)`` is 0 or 1."""

    def one(t):
        up = level(t) == 1
        return F.concat(F.lit("<s>[INST "), escape(t["role"], ROLE), F.lit(" "), level(t).cast("string"), F.lit("]"), F.when(up, escape(t["text"])).otherwise(t["text"]), F.lit("</s>"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text, level, body_chars, head_chars) of a formatted conversation; null if it is not valid."""

    def turn(payload):
        return bind(F.regexp_extract(payload, HEAD, 0), lambda head: whole(payload, head))

    def whole(payload, head):
        level = F.substr(head, F.char_length(head) - 1, F.lit(1))
        return F.struct(
            unescape(F.regexp_extract(head, HEAD, 1), ROLE).alias("role"),
            bind(F.substr(payload, F.char_length(head) + 1), lambda body: F.when(level == "1", unescape(body)).otherwise(body)).alias("text"),
            level.alias("level"),
            F.char_length(head).alias("head_chars"),
            (F.char_length(payload) - F.char_length(head)).alias("body_chars"),
        )

    def checked(pieces):
        n = F.size(pieces)
        payloads = F.filter(pieces, lambda p, i: i % 3 == 2)
        empties = ~F.exists(F.transform(pieces, lambda p, i: (i % 3 != 2) & (p != "")), lambda x: x)
        return F.when((n > 1) & (n % 3 == 1) & empties & F.forall(payloads, lambda p: p.rlike(HEAD)), F.transform(payloads, turn))

    return bind(F.split(formatted, CONTROL, -1), checked)


def bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` loops over it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _same(parsed: Column, turns: Column) -> Column:
    return F.coalesce(F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns, F.lit(False))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").isNull().alias("none"), F.col("turn"), or_empty(F.col("role")).alias("role"), or_empty(F.col("text")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (turn, start, chars, level): the assistant bodies under the loss mask, in code points."""
    plain = conversations_of(rows).withColumn("formatted", render(F.col("turns"), lambda t: F.lit(0)))
    some = lambda t: F.when(t["text"].rlike(CONTROL), 1).otherwise(0)
    once = plain.withColumn("formatted", F.when(_same(parse(F.col("formatted")), F.col("turns")), F.col("formatted")).otherwise(render(F.col("turns"), some)))
    sure = lambda f: F.when(_same(parse(f), F.col("turns")), f).otherwise(F.raise_error(F.lit("a conversation can't be read back")))
    done = once.withColumn("formatted", F.when(_same(parse(F.col("formatted")), F.col("turns")), F.col("formatted")).otherwise(bind(render(F.col("turns"), lambda t: F.lit(1)), sure)))
    return done.select("conv_id", "formatted").withColumn("loss_spans", loss_spans(F.col("formatted")))


def loss_spans(formatted: Column) -> Column:
    """Where the bodies of assistant turns stand in ``formatted``."""
    opening, closing = len("<s>[INST"), len("</s>")
    empty = F.array().cast("array<struct<turn:int,start:int,chars:int,level:string>>")

    def step(acc, t):
        start = acc["at"] + opening + t["head_chars"]
        number = acc["turn"] + 1
        span = F.array(F.struct(number.alias("turn"), start.alias("start"), t["body_chars"].alias("chars"), t["level"].alias("level")))
        return F.struct(number.alias("turn"), (start + t["body_chars"] + closing).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parse(formatted), F.struct(F.lit(0).alias("turn"), F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of a formatted table, taken from its text and loss mask alone."""
    rows = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def masked(turns):
        return F.array_join(F.transform("loss_spans", lambda s: F.element_at(turns, s["turn"])["text"]), "")

    rows = rows.withColumn("loss", bind(F.col("turns"), masked))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = "</s>[INST] ok [/INST]"


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(HARD).alias("text")) for k, r in enumerate(("user", "assistant"))])))
    return read_back(format_chats(rows.unionByName(hard)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), b AS (
  SELECT *, CASE WHEN regexp_matches(text, '</?s>|\[/?INST')
                 THEN replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B') ELSE text END AS body
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST ') + length(role) + length(' 0]') + length(body) + length('</s>')) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""

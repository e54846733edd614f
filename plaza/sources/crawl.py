"""Rules of a crawl, judged over pages and receipts that were landed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaza.functions import text as S
from plaza.operators import metrics as M
from plaza.operators import predicates as P

#: A crawl's pages, unless a source says otherwise.
MOST_PAGES = 25
#: Requests of one attempt, the first included.
MOST_HOPS = 4
# Statuses that send a request on, and those after which it may be made once more.
REDIRECTS = (301, 302, 303, 307, 308)
GONE = (404, 410)
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


def crawl_stops(pages: DataFrame, most: int = MOST_PAGES, empty: int = 1) -> DataFrame:
    """For each row of ``pages`` (crawl, page: its number from 1, links: array<string>): n_links, new_links, verdict and whether a crawler would read it.

    new_links counts links that no page of a lesser number has. The verdict is the
    first that holds: ``no_links`` (with ``empty=2``: ``two_empty``, the page before is
    empty as well), ``repeated`` (a page of a lesser number has the same links in the
    same order), ``no_new_links`` (not for page 1), ``page_limit``, or ``go_on``. A
    page is read if no page of a lesser number ends the crawl. With ``empty=2`` an
    empty page that isn't the second goes on. Null links are none; rows without crawl
    or page are ``unnumbered`` and not read; repeated rows are judged alike.

    Which page has a link first is an aggregate by link, so no crawl, however long, is
    sorted or held in one task.
    """
    key = ["crawl", "page"]
    links = F.coalesce("links", F.array().cast("array<string>"))
    rows = pages.select(*key, links.alias("links"), F.size(links).alias("n_links"), F.sha2(F.to_json(links), 256).alias("print"))
    first = rows.select(*key, F.explode("links").alias("link")).groupBy("crawl", "link").agg(F.min("page").alias("page"))
    new = first.groupBy(*key).agg(F.count("*").alias("new_links"))
    prints = rows.where("n_links > 0").groupBy("crawl", "print").agg(F.min("page").alias("page")).select(*key).distinct().withColumn("own", F.lit(True))
    empties = rows.where("n_links = 0").select("crawl", (F.col("page") + 1).alias("page")).distinct().withColumn("after_empty", F.lit(True))
    facts = rows.drop("links", "print").join(new, key, "left").join(prints, key, "left").join(empties, key, "left").fillna({"new_links": 0})
    nothing = F.col("n_links") == 0
    if empty == 2:
        verdict = F.when(nothing & F.col("after_empty"), "two_empty").when(nothing & (F.col("page") < most), "go_on")
    else:
        verdict = F.when(nothing, "no_links")
    verdict = F.when(F.col("crawl").isNull() | F.col("page").isNull(), "unnumbered").otherwise(
        verdict.when(~nothing & F.col("own").isNull(), "repeated").when(~nothing & (F.col("page") > 1) & (F.col("new_links") == 0), "no_new_links").when(F.col("page") >= most, "page_limit").otherwise("go_on")
    )
    judged = facts.select(*key, "n_links", "new_links", verdict.alias("verdict"))
    last = judged.where(~F.col("verdict").isin("go_on", "unnumbered")).groupBy("crawl").agg(F.min("page").alias("last"))
    read = (F.col("verdict") != "unnumbered") & F.coalesce(F.col("page") <= F.col("last"), F.lit(True))
    return judged.join(last, "crawl", "left").select(*key, "n_links", "new_links", "verdict", read.alias("read"))


def answer_state(status: Column) -> Column:
    """What a final answer says of a link; null where there was none."""
    states = F.when(status.between(200, 299), "ok").when(status.isin(*GONE), "broken").when(status.isin(401, 403), "restricted").when(status.isin(*TRANSIENT), "transient")
    return F.when(status.isNotNull(), F.coalesce(states, F.lit("http_error")))


def receipt_flags(receipts: DataFrame) -> list[tuple[str, Column]]:
    """What can be wrong with a receipt, given the one before it (columns before_*) and its result (row_*)."""
    c = F.col
    opens = c("before_attempt").isNull() | (c("attempt") != c("before_attempt"))
    turn = F.when(c("before_attempt").isNull(), c("attempt") == 1).otherwise((c("attempt") == 2) & c("before_status").isin(*GONE))
    chained = F.when(opens, (c("request_url") == c("url")) & turn).otherwise(c("before_status").isin(*REDIRECTS) & c("request_url").eqNullSafe(c("before_redirect")))
    within = (c("attempted_at") <= c("observed_at")) & (c("observed_at") >= c("row_attempted_at")) & (c("observed_at") <= c("row_assessed_at"))
    return [
        ("no_request_id", ~F.coalesce(c("request_id").rlike("^[0-9]+$"), F.lit(False))),
        ("bad_status", ~F.coalesce(c("status").between(100, 599) & c("attempt").isin(1, 2), F.lit(False))),
        ("other_host", ~S.host_key("request_url").eqNullSafe(S.host_key("url"))),
        ("broken_chain", ~F.coalesce(chained, F.lit(False))),
        ("clock", ~F.coalesce(within, F.lit(False))),
        ("out_of_order", c("observed_at") < c("before_observed")),
        ("beyond_attempts", c("attempt") > c("row_attempt")),
    ]


def report_problems(results: DataFrame, receipts: DataFrame, urls: DataFrame, holds: DataFrame) -> DataFrame:
    """url and problems (array<string>, empty if none) for each of ``urls`` (url) and each url of ``results``.

    ``results``: url, state, attempted, attempt, attempted_at, assessed_at, observed_at,
    status, final_url, confirmed_broken. ``receipts``: url (of the result), seq,
    attempt, request_id, request_url, status, redirect_url, attempted_at, observed_at.
    ``holds``: scope (host or url) and value, as ``predicates.held`` takes them.

    Coverage: ``not_covered``, ``unexpected``, ``repeated_result``. Requests: those of
    ``receipt_flags``, ``repeated_request`` (a request id stands twice in the report),
    ``too_many_hops``, ``held_requested``. Decisions: ``invented_request`` (receipts or an
    attempt where none was made, or no attempt where one was), ``unfounded_retry`` (the first attempt didn't find the page gone), ``no_basis`` (not attempted,
    yet neither held nor quarantined), ``hold_ignored``, ``not_last_response`` (status, address or
    time aren't the last receipt's, or that is a redirect), ``wrong_state``,
    ``unconfirmed_broken`` (a page is gone only if both attempts say so), ``invented_result``.
    Null urls are ignored; of repeated results the least row is judged. A url's receipts
    are put in order by a window, so they pass one task, which can spill.
    """
    own = [c for c in results.columns if c != "url"]
    single = results.where("url is not null").groupBy("url").agg(F.min(F.struct(*own)).alias("r"), F.count("*").alias("times")).select("url", "r.*", "times")
    hand = single.select("url", *[F.col(c).alias(f"row_{c}") for c in ("attempt", "attempted_at", "assessed_at")])
    chain = Window.partitionBy("url").orderBy("seq")
    rows = receipts.join(hand, "url")
    before = {"before_attempt": "attempt", "before_status": "status", "before_redirect": "redirect_url", "before_observed": "observed_at"}
    rows = rows.withColumns({name: F.lag(of).over(chain) for name, of in before.items()})
    twice = receipts.where("request_id is not null").groupBy("request_id").agg((F.count("*") > 1).alias("twice")).where("twice")
    rows = P.held(rows, holds, "request_url").join(twice, "request_id", "left")
    rows = rows.withColumn("flags", M.problems([*receipt_flags(rows), ("repeated_request", F.coalesce("twice", F.lit(False))), ("held_requested", F.col("held"))]))
    last = F.max_by(F.struct("status", "request_url", "observed_at"), "seq")
    told = rows.groupBy("url").agg(
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("flags"),
        F.count("*").alias("n"),
        last.alias("last"),
        *[F.count_if(F.col("attempt") == k).alias(f"hops{k}") for k in (1, 2)],
        F.max_by(F.when(F.col("attempt") == 1, F.col("status")), F.when(F.col("attempt") == 1, F.col("seq"))).alias("first_answer"),
    )
    c = F.col
    judged = P.held(single, holds, "url").withColumnRenamed("held", "on_hold").join(told, "url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    made = F.when(c("attempted"), c("attempt").isin(1, 2) & c("attempted_at").isNotNull()).otherwise((c("attempt") == 0) & (c("n") == 0) & c("attempted_at").isNull())
    seen, gone = c("status").isNotNull(), (c("attempt") == 2) & c("first_answer").isin(*GONE) & c("status").isin(*GONE)
    same = c("status").eqNullSafe(c("last.status")) & c("final_url").eqNullSafe(c("last.request_url")) & c("observed_at").eqNullSafe(c("last.observed_at")) & ~c("status").isin(*REDIRECTS)
    gone = F.coalesce(gone, F.lit(False))
    wrong = M.problems([
        ("repeated_result", c("times") > 1),
        ("invented_request", ~F.coalesce(made, F.lit(False))),
        ("unfounded_retry", (c("attempt") == 2) & ~F.coalesce(c("first_answer").isin(*GONE), F.lit(False))),
        ("no_basis", ~c("attempted") & ~F.coalesce(c("state").isin("held", "quarantined"), F.lit(False))),
        ("hold_ignored", c("on_hold") & (c("attempted") | ~c("state").eqNullSafe(F.lit("held")))),
        ("too_many_hops", F.greatest("hops1", "hops2") > MOST_HOPS),
        ("not_last_response", seen & ~same),
        ("wrong_state", seen & ~c("state").eqNullSafe(answer_state(c("status")))),
        ("unconfirmed_broken", (c("confirmed_broken") | c("state").eqNullSafe(F.lit("broken"))) & ~gone),
        ("invented_result", ~seen & (c("observed_at").isNotNull() | c("final_url").isNotNull() | ~F.coalesce(c("state").isin("held", "transient", "quarantined"), F.lit(False)))),
    ])
    none = F.array().cast("array<string>")
    found = judged.select("url", F.concat(wrong, F.coalesce("flags", none)).alias("problems"))
    wanted = urls.where("url is not null").select("url").distinct().withColumn("wanted", F.lit(True))
    both = found.join(wanted, "url", "full")
    cover = F.when(F.col("problems").isNull(), F.array(F.lit("not_covered"))).when(F.col("wanted").isNull(), F.array(F.lit("unexpected"))).otherwise(none)
    return both.select("url", F.array_sort(F.array_distinct(F.concat(cover, F.coalesce("problems", none)))).alias("problems"))

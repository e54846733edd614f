"""Search pages and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.operators.metrics import count_by
from plaza.plans.facets import EventQuery, NewsQuery, PlaceQuery
from plaza.sources.files import shared_folder
from plaza.probes.base import AS_OF, Tables, probe


def places(t):
    """Parts as places."""
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("search"), F.split(F.lower("p_type"), " ").alias("cuisines"),
        F.col("p_brand").alias("area"), F.array(F.when(F.col("p_size") > 25, "patio").otherwise("takeout")).alias("features"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("fresh"),
    )


def entry(spark, folder):
    return PlaceQuery.from_hash("#explore?q=ring&page=1").run(places(Tables(spark, folder)))


@probe("explore-page", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS score FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') OR contains(regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]+', '', 'g'), 'ring') ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 12")
def _(t):
    return PlaceQuery.from_hash("#explore?q=ring").run(places(t)).select("id", "name", "score")


@probe("explore-facets", "SELECT p_brand AS area, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return count_by(places(t), "area")


@probe("events-page", f"""
WITH e AS (SELECT event_id, ts, ts + INTERVAL 1 DAY AS e, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Halifax' AS DATE) AS d FROM events WHERE event_type = 'purchase')
SELECT event_id AS id FROM e WHERE e >= TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE AND d + 1 >= DATE '2024-01-16' AND d <= DATE '2024-01-23' ORDER BY greatest(ts, TIMESTAMP '{AS_OF}'), event_id LIMIT 24""")
def _(t):
    rows = t.events.select(
        F.col("event_id").alias("id"), F.concat("event_type", F.lit(" "), "event_id").alias("title"), F.array("event_type").alias("categories"), F.lit("here").alias("city"), F.lit("free").alias("cost"),
        D.time_kind("ts").alias("time"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 day")).alias("end"),
    )
    return EventQuery(category="purchase", window="7").run(rows, AS_OF).select("id")


@probe("news-page", "SELECT doc_id AS id FROM documents WHERE lang = 'fr' AND contains(source, '1') ORDER BY doc_id LIMIT 12 OFFSET 12")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("2024-01").alias("month"), F.col("lang").alias("region"), F.array("source").alias("topics"))
    return NewsQuery(q="1", region="fr", page=2).run(rows).select("id")


@probe("cdc-10", """
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY moment, status, etag) AS nth FROM (SELECT 's' || (user_id % 20) AS source, date_trunc('millisecond', ts) AS moment, [200, 304, 429, 200, 500][event_id % 5 + 1] AS status, 't' || (event_id % 3) AS etag FROM events)),
r(source, nth, etag, hold, state) AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), '' FROM a
  UNION ALL
  SELECT source, nth, CASE WHEN said = 'accepted' THEN new_etag ELSE etag END, CASE WHEN said = 'held' THEN moment + INTERVAL 1 DAY WHEN said IN ('backoff', 'failed') THEN hold END, said
  FROM (SELECT a.source, a.nth, r.etag, r.hold, a.etag AS new_etag, a.moment, CASE WHEN a.moment < r.hold THEN 'backoff' WHEN a.status = 429 THEN 'held' WHEN a.status = 304 OR (a.status = 200 AND a.etag = r.etag) THEN 'unchanged' WHEN a.status = 200 THEN 'accepted' ELSE 'failed' END AS said
        FROM r JOIN a ON a.source = r.source AND a.nth = r.nth + 1))
SELECT source, state, count(*) AS n FROM r WHERE nth > 0 GROUP BY ALL
UNION ALL SELECT source, 'released', count(*) FROM r WHERE state = 'held' AND hold <= (SELECT max(moment) FROM a) GROUP BY source""")
def _(t):
    """The events as attempts of a stream; run to its end here, as a query must return a table."""
    from plaza.streaming.runs import collection_states, rocksdb_states

    spark = t.spark
    stream = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    status = F.element_at(F.array(*map(F.lit, (200, 304, 429, 200, 500))), (F.col("event_id") % 5 + 1).cast("int"))
    attempts = stream.select(F.concat(F.lit("s"), F.col("user_id") % 20).alias("source"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("etag"))
    out = shared_folder(spark)
    with rocksdb_states(spark):
        run = collection_states(attempts).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("source", "state").agg(F.count("*").alias("n"))

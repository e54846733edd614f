"""Lists that come in pages: a source that pulls them, and whether all of a list came.

A list is taken as a whole or not at all. Its pages state how many members there
are; the members' own pages (details) are read apart from it. Both counts must be
the stated one.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Pages of a list that are read at most; a longer one is not taken.
MOST_PAGES = 5
PAGE = "page int, total int, body string"
MEMBER = "array<struct<id:long,link:string,name:string>>"


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options["fetch"].partition(":")
        self.fetch, self.of = getattr(importlib.import_module(module), name), options.get("of", "")
        self.most = int(options.get("most_pages", MOST_PAGES))

    def partitions(self) -> list[InputPartition]:
        """One for each page, the last one first: what is added meanwhile then comes twice rather than never."""
        pages = int(json.loads(self.fetch(self.of, 1))["pages"])
        if not 1 <= pages <= self.most:
            raise ValueError(f"{pages} pages, at most {self.most} are read")
        return [_Page(page) for page in range(pages, 0, -1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        got = json.loads(self.fetch(self.of, partition.page))
        yield partition.page, int(got["total"]), json.dumps(got["members"])


class PagedSource(DataSource):
    """``spark.read.format("plaza_pages").option("fetch", "module:function").option("of", list)``: one row, and one task, a page.

    ``fetch(of, page)`` gives a page as JSON text: total, pages, members. It is
    called on executors (for page 1 also on the driver), so politeness, time limits
    and retries are its own.
    """

    @classmethod
    def name(cls) -> str:
        return "plaza_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def completeness(pages: DataFrame, details: DataFrame, key: str, most: int = MOST_PAGES) -> DataFrame:
    """key, expected, links, details and problems (array, empty for a list that came whole) of each list of ``pages``.

    ``pages``: key, page, total, body (members as JSON); ``details``: key and id of
    each member whose own page was read. Problems, in this order: total_invalid
    (none, below one, or not the same on all pages), too_many_pages, page_missing
    (of 1 to the last), page_repeated, page_unreadable, count_mismatch (distinct
    members with an id and a link are not as many as stated), detail_incomplete
    (not each of them has its detail). Details of other members don't count.
    """
    read = F.from_json("body", MEMBER)
    rows = pages.select(key, "page", "total", read.alias("members"))
    lists = rows.groupBy(key).agg(
        F.min("total").alias("expected"), F.max("total").alias("_most"), F.count("total").alias("_totals"), F.count("*").alias("_rows"),
        F.count_distinct("page").alias("_pages"), F.max("page").alias("_last"), F.min("page").alias("_first"), F.count_if(F.col("members").isNull()).alias("_bad"),
    )
    members = rows.select(key, F.inline("members")).where("id > 0 and link is not null").select(key, "id").distinct()
    seen = details.select(key, "id").distinct().withColumn("_seen", F.lit(True))
    found = members.join(seen, [key, "id"], "left").groupBy(key).agg(F.count("*").alias("links"), F.count("_seen").alias("details"))
    zero = F.lit(0).cast("long")
    out = lists.join(found, key, "left").withColumns({"links": F.coalesce("links", zero), "details": F.coalesce("details", zero)})
    wrong = [
        ("total_invalid", ~F.coalesce((F.col("expected") >= 1) & (F.col("expected") == F.col("_most")) & (F.col("_totals") == F.col("_rows")), F.lit(False))),
        ("too_many_pages", F.greatest("_pages", "_last") > most), ("page_missing", ~F.coalesce((F.col("_first") == 1) & (F.col("_last") == F.col("_pages")), F.lit(False))), ("page_repeated", F.col("_rows") > F.col("_pages")),
        ("page_unreadable", F.col("_bad") > 0), ("count_mismatch", ~F.coalesce(F.col("links") == F.col("expected"), F.lit(False))), ("detail_incomplete", F.col("details") != F.col("links")),
    ]
    return out.select(key, "expected", "links", "details", F.array_compact(F.array(*[F.when(test, name) for name, test in wrong])).alias("problems"))


def whole_members(pages: DataFrame, details: DataFrame, key: str, most: int = MOST_PAGES) -> DataFrame:
    """key, id, link, name of the members of the lists that came whole, each once (of several links or names the smallest); none of any other list."""
    whole = completeness(pages, details, key, most).where(F.size("problems") == 0).select(key)
    rows = pages.select(key, F.inline(F.from_json("body", MEMBER))).where("id > 0 and link is not null")
    return rows.join(whole, key, "left_semi").groupBy(key, "id").agg(F.min(F.struct("link", "name")).alias("m")).select(key, "id", "m.link", "m.name")

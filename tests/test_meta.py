"""Images and dates that pages state."""

import datetime as dt

from plaza.sources import meta

NOW = "2024-01-16 12:00:00"


def told(spark, pages, column):
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_images(spark):
    pages = [
        """<meta content="a.jpg" property="og:image"><META NAME='twitter:image' content='b.jpg'><meta property="og:title" content="x.jpg"><img class="c" src="a.jpg"><img data-src='c.jpg'>""",
        """<img srcset=" , d.jpg 1x, e.jpg 2x"><img alt="none"><img src="" data-srcset="f.jpg"><meta property="og:image" content="">""", None, "", "<p>no pictures",
    ]
    assert told(spark, pages, meta.stated_images("html")) == [["a.jpg", "b.jpg", "c.jpg"], ["d.jpg", "f.jpg"], [], [], []]


def test_dates(spark):
    at = lambda *a: dt.datetime(2024, 1, *a)
    ld = lambda text: f'<script type="application/ld+json">{text}</script>'
    pages = {
        '<meta content="2024-01-05" property="article:published_time"><time itemprop="datePublished" datetime="2024-01-07T10:00:00-04:00">': [at(7, 14), at(5)],
        '<meta name="pubdate" content="2024-01-05"><meta name="pubdate" content="2024-01-05T00:00:00Z"><time datetime="2024-01-06">': [at(5)],
        '<meta name="pubdate" content="2024-01-17"><meta name="pubdate" content="2024-02-31"><meta name="pubdate" content="soon">': [],
        ld('{"@graph":[{"@type":["NewsArticle"],"datePublished":"2024-01-03"},{"@type":"Event","datePublished":"2024-01-04"}]}') + ld("{bad") + ld('{"a":{"b":[{"@type":"BlogPosting","datePublished":"2024-01-02T08:00Z"},7]}}'): [at(3), at(2, 8)],
        ld('{"@type":"Article","datePublished":20240101}') + ld("null"): [], None: [], "": [],
    }
    assert told(spark, list(pages), meta.published_dates("html", NOW)) == list(pages.values())

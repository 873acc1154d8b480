"""References against the standard library's resolution, and links of made-up pages, by the query and its SQL."""

from urllib.parse import urljoin

import duckdb

import __spark_entry__
from textlattice.operators import clean

BASES = ["http://a.org/b/c/d.html?q=1", "https://A.org", "http://a.org/", "http://a.org/x/y/"]
REFS = ["g", "./g", "g/", "/g", "//h.net/p/../q", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://h.net/a/./b/../c?d=../e", "mailto:me@a.org", "  g  ", "a/b/../../c"]


def test_resolved_like_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "base string, ref string")
    got = {(x["base"], x["ref"]): x["url"] for x in df.select("base", "ref", clean.resolved("base", "ref").alias("url")).collect()}
    dotted = {"//h.net/p/../q": "//h.net/q", "http://h.net/a/./b/../c?d=../e": "http://h.net/a/c?d=../e"}  # which the library leaves as they are
    assert got == {(b, r): urljoin(b, dotted.get(r, r).strip()) for b, r in rows}


PAGES = [
    (1, "http://a.org/x/y?k=1#f", """<html><head><link rel="canonical" href="/x/"><META content='http://b.org/z#t' property='og:url'></head>
      <a href="one">1</a> <A class='k' HREF='../two?a=1#b'>2</A> <a href = "//c.org/./d">3</a> <a href="mailto:x">4</a> <a name="n">5</a> <a href="#top">6</a> <a href="http://a.org/x/y">own</a>"""),
    (2, "https://d.org", """<link href="/c" rel=\'stylesheet\'><a href='p/q'>1</a><a data-x="1" href="?s">2</a>"""),
    (3, None, "<a href='/x'>no base</a>"),
    (4, "http://e.org/", None),
]


def test_links_and_urls_of_pages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {(r["page_id"], r["href"]) for r in clean.page_links(pages.filter("page_id < 3")).collect()}
    assert got == {
        (1, "http://a.org/x/one"), (1, "http://a.org/two?a=1#b"), (1, "http://c.org/d"), (1, "mailto:x"), (1, "http://a.org/x/y?k=1#top"), (1, "http://a.org/x/y"),
        (2, "https://d.org/p/q"), (2, "https://d.org?s"),
    }
    urls = {(r["page_id"], r["url"]) for r in clean.page_urls(pages.filter("page_id < 3")).collect()}
    assert urls == {(1, "http://a.org/x/y?k=1"), (1, "http://a.org/x/"), (1, "http://b.org/z"), (2, "https://d.org")}
    pages.filter("page_id < 3").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("link_extract_filtered", "page_urls", "batch_union_distinct", "frontier_anti_insert"):
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.execute(__spark_entry__.oracle_sql()[name])
        names = [x[0] for x in want.description]
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall()), name

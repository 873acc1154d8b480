"""Queries over pages and documents: filters, sentences, links and the URL frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import clean, frontier
from textlattice.sources.pages import read_documents, read_pages

BANNED, SUPPRESSED = ["idiot", "scum", "moron"], ["clown", "loser", "trash", " the "]
SITES = ["example.org"]


def page_lang_filter(spark, d):
    return clean.filter_lang(read_pages(spark, d), "fr").select("page_id", "url")


def page_text_ratio(spark, d):
    nodes = clean.filter_script_ratio(clean.page_text_nodes(read_pages(spark, d)))
    return clean.gate_pages(nodes, "[aeiouy]").select("page_id", "pos", "node")


def sentence_split_distinct(spark, d):
    return clean.distinct_per_batch(clean.split_sentences(read_documents(spark, d).select("source", "text"), "text"), "source")


def blocklist_verdict(spark, d):
    return read_documents(spark, d).select("doc_id", T.verdict("text", BANNED, SUPPRESSED).alias("verdict"))


def page_gating(spark, d):
    return clean.gate_verdict(clean.page_text_nodes(read_pages(spark, d)), BANNED, SUPPRESSED)


def url_left_part(spark, d):
    return read_pages(spark, d).select("page_id", T.url_left_part("url").alias("path_part"), T.url_left_part("url", "query").alias("query_part"))


def url_host_reduce(spark, d):
    return read_pages(spark, d).select("page_id", T.reduce_host(T.url_host("url")).alias("hostname"))


def url_valid(spark, d):
    return read_pages(spark, d).select("page_id", T.is_valid_url("url").alias("valid"), T.is_valid_url(F.concat("url", F.repeat(F.lit("x"), F.lit(1650)))).alias("valid_long"))


def link_extract_filtered(spark, d):
    return clean.filter_links(clean.page_links(read_pages(spark, d)), ["casino", "pills"])


def page_urls(spark, d):
    return clean.page_urls(read_pages(spark, d))


def _urls(spark, d):
    return read_pages(spark, d).select("page_id", T.url_left_part("url").alias("url"))


def _linked(spark, d):
    """The URLs that pages link to."""
    return clean.page_links(read_pages(spark, d)).select(T.url_left_part("href").alias("url"))


def frontier_anti_insert(spark, d):
    return frontier.new_urls(_linked(spark, d), _urls(spark, d))


def frontier_upsert(spark, d):
    stored = _urls(spark, d).groupBy("url").agg(F.min("page_id").alias("p"))
    stored = stored.select("url", F.expr("date_add(date'2024-01-01', cast(p % 30 as int))").alias("last_access"))
    return frontier.mark_read(stored, _linked(spark, d), F.lit("2024-03-01").cast("date")).withColumn("last_access", F.col("last_access").cast("string"))


def host_insert(spark, d):
    """Hosts as links have them, against the reduced hosts of all pages."""
    linked = _linked(spark, d).select(T.url_host("url").alias("hostname"))
    return frontier.new_hosts(linked, _urls(spark, d).select(T.reduce_host(T.url_host("url")).alias("hostname")))


def host_round_robin(spark, d):
    hosts = read_pages(spark, d).select(T.url_host("url").alias("hostname")).distinct()
    return frontier.pick_hosts(hosts, "thz", 20)


def host_url_counts(spark, d):
    return frontier.host_quota(read_pages(spark, d).select(T.reduce_host(T.url_host("url")).alias("hostname")))


def oldest_per_host(spark, d):
    urls = read_pages(spark, d).select("url", T.reduce_host(T.url_host("url")).alias("hostname"), F.expr("date_add(date'2024-01-01', cast(page_id % 30 as int))").alias("last_access"))
    return frontier.oldest_urls(urls, 3, F.lit("2024-01-25").cast("date")).withColumn("last_access", F.col("last_access").cast("string"))


def batch_union_distinct(spark, d):
    pages = read_pages(spark, d)
    links = clean.page_links(pages).select(F.col("href").alias("url"))
    return frontier.union_distinct(pages.select("url"), links, _urls(spark, d).select("url"))


def host_except(spark, d):
    hosts = read_pages(spark, d).select(T.reduce_host(T.url_host("url")).alias("hostname")).distinct()
    return frontier.except_hosts(hosts, SITES)


QUERIES = {
    f.__name__: f
    for f in (page_lang_filter, page_text_ratio, sentence_split_distinct, blocklist_verdict, page_gating, url_left_part, url_host_reduce, url_valid, link_extract_filtered, page_urls, frontier_anti_insert, frontier_upsert, host_insert, host_round_robin, host_url_counts, oldest_per_host, batch_union_distinct, host_except)
}

_NODES = r"""nodes AS (
  SELECT page_id, pos, trim(regexp_replace(raw, '[\r\n\t |]+', ' ', 'g')) AS node
  FROM (SELECT page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos
        FROM (SELECT page_id, regexp_split_to_array(
                regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'),
                '<[^>]*>') AS parts FROM pages))
  WHERE trim(regexp_replace(raw, '[\r\n\t |]+', ' ', 'g')) <> '')"""


def _verdict(col: str, ng: list[str] = BANNED, sup: list[str] = SUPPRESSED) -> str:
    hit = lambda terms: " OR ".join(f"contains({col}, '{t}')" for t in terms) or "false"
    return f"CASE WHEN {hit(ng)} THEN 1 WHEN {hit(sup)} THEN 2 ELSE 0 END"


_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_replace(url, '[?#].*$', '')"
_REDUCED = f"CASE WHEN strpos({_HOST}, '.') - 1 <= 0 OR strpos({_HOST}, '.') - 1 >= length({_HOST}) - 6 THEN {_HOST} ELSE substr({_HOST}, strpos({_HOST}, '.') + 1) END"
_SITE = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
_QUOTED = """("[^"]*"|''[^'']*'')"""


def _no_dots(p: str) -> str:
    parts = f"string_split({p}, '/')"
    fold = f"list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform({parts}, lambda x: [x])), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END ELSE list_concat(acc, x) END)"
    return f"CASE WHEN regexp_matches({p}, '(^|/)\\.\\.?(/|$)') THEN array_to_string(CASE WHEN {parts}[-1] IN ('.', '..') THEN list_concat({fold}, ['']) ELSE {fold} END, '/') ELSE {p} END"


def _resolved(raws: str) -> str:
    """raws: page_id, url, raw. page_id, url, href."""
    return f"""(SELECT page_id, url, CASE kind WHEN 0 THEN raw WHEN 1 THEN home || {_no_dots("path")} || rest WHEN 2 THEN home || path || rest ELSE regexp_replace(url, '#.*$', '') || rest END AS href
      FROM (SELECT *, CASE WHEN regexp_matches(raw, '{_SITE}') THEN regexp_extract(raw, '{_SITE}', 1) WHEN starts_with(raw, '//') THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') || regexp_extract(raw, '^//[^/?#]*') ELSE site END AS home,
          CASE WHEN regexp_matches(raw, '{_SITE}') THEN regexp_extract(raw, '{_SITE}([^?#]*)', 2) WHEN starts_with(raw, '//') THEN regexp_extract(raw, '^//[^/?#]*([^?#]*)', 1)
            WHEN starts_with(own, '/') THEN own WHEN own <> '' THEN CASE WHEN folder = '' THEN '/' ELSE folder END || own ELSE base END AS path,
          CASE WHEN regexp_matches(raw, '{_SITE}') THEN 1 WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 0 WHEN own <> '' THEN 1 WHEN starts_with(rest, '?') THEN 2 ELSE 3 END AS kind
        FROM (SELECT page_id, url, trim(raw) AS raw, regexp_extract(trim(raw), '^([^?#]*)', 1) AS own, regexp_extract(trim(raw), '^[^?#]*(.*)$', 1) AS rest, regexp_extract(url, '{_SITE}', 1) AS site,
            regexp_extract(url, '{_SITE}([^?#]*)', 2) AS base, regexp_replace(regexp_extract(url, '{_SITE}([^?#]*)', 2), '[^/]*$', '') AS folder FROM {raws})))"""


_LINKS = f"""links AS (SELECT * FROM {_resolved(f"(SELECT page_id, url, substr(raw, 2, length(raw) - 2) AS raw FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*{_QUOTED}', 1)) AS raw FROM pages))")})"""


def _attribute(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, '(?i)\\s{name}\\s*=\\s*{_QUOTED}', 1)"


def _tags(name: str, key: str, value: str, wanted: str) -> str:
    unquoted = lambda x: f"substr({x}, 2, greatest(length({x}) - 2, 0))"
    return f"SELECT page_id, url, {unquoted(_attribute('tag', wanted))} AS raw FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<{name}\\s[^>]*>')) AS tag FROM pages) WHERE lower({unquoted(_attribute('tag', key))}) = '{value}'"


def _valid(u: str) -> str:
    a = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
    return f"(length({u}) <= 1700 AND {a} <> '' AND length({a}) <= 256 AND NOT regexp_matches({u}, '[^\\x00-\\x7F]'))"


ORACLE = {
    "page_lang_filter": "SELECT page_id, url FROM pages WHERE regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) = 'fr'",
    "page_text_ratio": f"""WITH {_NODES}, ok AS (
        SELECT * FROM nodes WHERE len(regexp_extract_all(node, '{T.LETTER}')) > 0
          AND len(regexp_extract_all(node, '{T.LETTER}')) >= length(node) * 2 // 3)
        SELECT page_id, CAST(pos AS INT) AS pos, node FROM ok WHERE page_id IN (SELECT page_id FROM ok WHERE regexp_matches(node, '[aeiouy]'))""",
    "sentence_split_distinct": rf"""SELECT DISTINCT source, sentence FROM (
        SELECT source, trim(regexp_replace(s, '[\r\n\t |]+', ' ', 'g')) AS sentence
        FROM (SELECT source, unnest(string_split(regexp_replace(text, '({T.TERMINATORS})', '\1' || chr(10), 'g'), chr(10))) AS s FROM documents))
        WHERE sentence <> ''""",
    "blocklist_verdict": f"SELECT doc_id, {_verdict('text')} AS verdict FROM documents",
    "page_gating": f"""WITH {_NODES}, v AS (SELECT page_id, {_verdict('node')} AS v FROM nodes)
        SELECT page_id, count(*) FILTER (v = 1) AS n_ng, count(*) FILTER (v = 2) AS n_suppress,
          count(*) FILTER (v = 1) = 0 AS keep_texts, count(*) FILTER (v = 1) = 0 AND count(*) FILTER (v = 2) <= 5 AS keep_links
        FROM v GROUP BY page_id""",
    "url_left_part": f"SELECT page_id, {_PATH} AS path_part, regexp_replace(url, '#.*$', '') AS query_part FROM pages",
    "url_host_reduce": f"SELECT page_id, {_REDUCED} AS hostname FROM pages",
    "url_valid": f"SELECT page_id, {_valid('url')} AS valid, {_valid('u2')} AS valid_long FROM (SELECT *, url || repeat('x', 1650) AS u2 FROM pages)",
    "link_extract_filtered": f"""WITH {_LINKS}, l AS (SELECT page_id, regexp_replace(href, '[?#].*$', '') AS href, {_PATH} AS own FROM links)
        SELECT DISTINCT page_id, href FROM l
        WHERE regexp_matches(href, '^https?://') AND href <> own AND NOT contains(href, 'casino') AND NOT contains(href, 'pills')""",
    "page_urls": f"""SELECT DISTINCT page_id, regexp_replace(href, '#.*$', '') AS url
        FROM {_resolved(f"(SELECT page_id, url, '' AS raw FROM pages UNION ALL {_tags('link', 'rel', 'canonical', 'href')} UNION ALL {_tags('meta', 'property', 'og:url', 'content')})")}""",
    "frontier_anti_insert": f"""WITH {_LINKS}, u AS (SELECT {_PATH} AS url FROM (SELECT href AS url FROM links))
        SELECT DISTINCT url, {_REDUCED} AS hostname FROM u WHERE {_valid('url')} AND url NOT IN (SELECT {_PATH} FROM pages)""",
    "frontier_upsert": f"""WITH {_LINKS}, s AS (SELECT {_PATH} AS url, DATE '2024-01-01' + CAST(min(page_id) % 30 AS INT) AS last_access FROM pages GROUP BY 1),
        r AS (SELECT DISTINCT regexp_replace(href, '[?#].*$', '') AS url FROM links)
        SELECT coalesce(s.url, r.url) AS url, CAST(CASE WHEN r.url IS NOT NULL THEN DATE '2024-03-01' ELSE last_access END AS VARCHAR) AS last_access
        FROM s FULL JOIN r ON s.url = r.url""",
    "host_insert": f"""WITH {_LINKS}, h AS (SELECT {_HOST} AS hostname FROM (SELECT regexp_replace(href, '[?#].*$', '') AS url FROM links))
        SELECT DISTINCT hostname FROM h WHERE hostname NOT IN (SELECT {_REDUCED} FROM (SELECT {_PATH} AS url FROM pages))""",
    "host_round_robin": f"""WITH h AS (SELECT DISTINCT {_HOST} AS hostname FROM pages)
        SELECT hostname, CAST(row_number() OVER (ORDER BY hostname < 'thz', hostname) AS INT) AS pick FROM h QUALIFY pick <= 20""",
    "host_url_counts": f"SELECT {_REDUCED} AS hostname, count(*) AS n_urls FROM pages GROUP BY 1",
    "oldest_per_host": f"""WITH u AS (SELECT url, {_REDUCED} AS hostname, DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS last_access FROM pages)
        SELECT hostname, url, CAST(last_access AS VARCHAR) AS last_access, CAST(row_number() OVER (PARTITION BY hostname ORDER BY last_access, url) AS INT) AS k
        FROM u WHERE DATE '2024-01-25' - last_access > 7 QUALIFY k <= 3""",
    "batch_union_distinct": f"WITH {_LINKS} SELECT url FROM pages UNION SELECT href FROM links UNION SELECT {_PATH} FROM pages",
    "host_except": f"SELECT DISTINCT {_REDUCED} AS hostname FROM pages WHERE {_REDUCED} <> 'example.org'",
}

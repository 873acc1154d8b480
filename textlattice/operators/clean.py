"""From pages and documents to sentences: language, script and block-list filters, splitting, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.functions import text as T


def page_lang(html: str | Column) -> Column:
    return F.regexp_extract(F.col(html) if isinstance(html, str) else html, '<html[^>]*lang="([^"]*)"', 1)


def filter_lang(pages: DataFrame, lang: str) -> DataFrame:
    """Pages whose declared language is the target."""
    return pages.filter(page_lang("html") == lang)


def strip_scripts(html: str | Column) -> Column:
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(F.regexp_replace(c, "(?s)<script[^>]*>.*?</script>", ""), "(?s)<style[^>]*>.*?</style>", "")


def page_text_nodes(pages: DataFrame) -> DataFrame:
    """One row per text between tags: page_id, pos, node."""
    parts = F.split(strip_scripts("html"), "<[^>]*>")
    nodes = pages.select("page_id", F.posexplode(parts).alias("pos", "raw"))
    return nodes.select("page_id", "pos", T.normalize_space("raw").alias("node")).filter("node <> ''")


def filter_script_ratio(nodes: DataFrame, cls: str = T.LETTER, num: int = 2, den: int = 3, col: str = "node") -> DataFrame:
    return nodes.filter(T.script_share_ok(col, cls, num, den))


def gate_pages(nodes: DataFrame, gate: str) -> DataFrame:
    """Nodes of pages that have at least one node with the gate's class. A semi-join, so that no page is one task's."""
    passed = nodes.filter(F.col("node").rlike(gate)).select("page_id").distinct()
    return nodes.join(passed, "page_id", "left_semi")


def split_sentences(df: DataFrame, col: str, terminators: str = T.TERMINATORS) -> DataFrame:
    """One row per sentence, other columns kept: a cut after each mark, and at line ends; empty ones dropped."""
    marked = F.regexp_replace(F.col(col), f"({terminators})", "$1\n")
    rest = [c for c in df.columns if c != col]
    out = df.select(*rest, F.explode(F.split(marked, "\n")).alias("s"))
    return out.select(*rest, T.normalize_space("s").alias("sentence")).filter("sentence <> ''")


def distinct_per_batch(sentences: DataFrame, batch: str) -> DataFrame:
    return sentences.select(batch, "sentence").distinct()


#: A URL's scheme and site; a reference that has a scheme; path parts that stand for this folder and the one above.
_SITE, _SCHEME, _DOTS = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", "^[a-zA-Z][a-zA-Z0-9+.-]*:", r"(^|/)\.\.?(/|$)"
_QUOTED = """("[^"]*"|'[^']*')"""


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` parts, by a stack of its parts; nothing is above the first one."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    stack = F.aggregate(parts, none, lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    folder = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(folder, F.concat(stack, F.array(F.lit("")))).otherwise(stack), "/")
    return F.when(path.rlike(_DOTS), joined).otherwise(path)


def resolved(base: str, ref: str) -> Column:
    """The URL that a reference in the page `base` means. One that has a scheme but no site stays as it is."""
    url, raw = F.col(base), F.trim(F.col(ref))
    site, path = F.regexp_extract(url, _SITE, 1), F.regexp_extract(url, _SITE + "([^?#]*)", 2)
    own, rest = F.regexp_extract(raw, "^([^?#]*)", 1), F.regexp_extract(raw, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    absolute = lambda x: F.concat(F.regexp_extract(x, _SITE, 1), _without_dots(F.regexp_extract(x, _SITE + "([^?#]*)", 2)), rest)
    return (
        F.when(raw.rlike(_SITE), absolute(raw))
        .when(raw.rlike(_SCHEME), raw)
        .when(raw.startswith("//"), absolute(F.concat(F.regexp_extract(url, _SCHEME, 0), raw)))
        .when(own.startswith("/"), F.concat(site, _without_dots(own), rest))
        .when(own != "", F.concat(site, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
        .when(rest.startswith("?"), F.concat(site, path, rest))
        .otherwise(F.concat(T.url_left_part(url, "query"), rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in either kind of quotes; empty where it has none."""
    quoted = F.regexp_extract(tag, f"(?i)\\s{name}\\s*=\\s*{_QUOTED}", 1)
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page: page_id, url (the page's own), href (resolved against it)."""
    tags = F.regexp_extract_all("html", F.lit(f"(?i)<a\\s[^>]*?href\\s*=\\s*{_QUOTED}"), 1)
    links = pages.select("page_id", "url", F.explode(tags).alias("raw"))
    links = links.withColumn("raw", F.substring("raw", F.lit(2), F.length("raw") - 2))
    return links.select("page_id", "url", resolved("url", "raw").alias("href"))


def page_urls(pages: DataFrame) -> DataFrame:
    """All URLs that a page says it has, up to their query: its own, its canonical link and its og:url. page_id, url."""
    tags = lambda name: F.regexp_extract_all("html", F.lit(f"(?i)<{name}\\s[^>]*>"), 0)
    canonical = F.transform(F.filter(tags("link"), lambda t: F.lower(attribute(t, "rel")) == "canonical"), lambda t: attribute(t, "href"))
    same = F.transform(F.filter(tags("meta"), lambda t: F.lower(attribute(t, "property")) == "og:url"), lambda t: attribute(t, "content"))
    said = pages.select("page_id", "url", F.explode(F.concat(F.array(F.lit("")), canonical, same)).alias("raw"))
    return said.select("page_id", T.url_left_part(resolved("url", "raw"), "query").alias("url")).distinct()


def filter_links(links: DataFrame, blocked: list[str]) -> DataFrame:
    """http and https links to other pages, without blocked terms; query and fragment cut off."""
    out = links.withColumn("href", T.url_left_part("href"))
    keep = out["href"].rlike("^https?://") & (out["href"] != T.url_left_part("url"))
    return out.filter(keep & (T.verdict("href", blocked, []) == 0)).select("page_id", "href").distinct()


def gate_verdict(nodes: DataFrame, ng: list[str], suppress: list[str], threshold: int = 5) -> DataFrame:
    """Per page: banned nodes, suppressed nodes, whether its texts and its links are kept."""
    seen = nodes.withColumn("v", T.verdict("node", ng, suppress)).groupBy("page_id")
    out = seen.agg(F.count_if(F.col("v") == 1).alias("n_ng"), F.count_if(F.col("v") == 2).alias("n_suppress"))
    return out.withColumn("keep_texts", F.col("n_ng") == 0).withColumn("keep_links", F.col("keep_texts") & (F.col("n_suppress") <= threshold))

"""The URL frontier as tables: inserts are anti-joins, marking read is an upsert, picking is ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textlattice.functions import text as T


def new_urls(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid URLs that aren't stored yet, once each, with their reduced hosts. Both sides: url."""
    clean = found.select(T.url_left_part("url").alias("url")).distinct().filter(T.is_valid_url("url"))
    return clean.join(stored.select("url"), "url", "left_anti").withColumn("hostname", T.reduce_host(T.url_host("url")))


def new_hosts(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.select("hostname").distinct().join(stored.select("hostname"), "hostname", "left_anti")


def mark_read(stored: DataFrame, read: DataFrame, now: Column) -> DataFrame:
    """stored: url, last_access; read: url. Read URLs get the time; ones not stored yet are added."""
    hit = read.select("url").distinct().withColumn("hit", F.lit(True))
    out = stored.join(hit, "url", "full_outer")
    return out.select("url", F.when(F.col("hit"), now).otherwise(F.col("last_access")).alias("last_access"))


def except_hosts(hosts: DataFrame, excluded: list[str]) -> DataFrame:
    return hosts.filter(~F.col("hostname").isin(excluded))


def host_quota(urls: DataFrame) -> DataFrame:
    return urls.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_urls"))


def pick_hosts(hosts: DataFrame, cursor: str, k: int) -> DataFrame:
    """The next k hosts in order from the cursor on, starting over at the end. Two short lists, no sort of all hosts."""
    after = hosts.filter(F.col("hostname") >= cursor).orderBy("hostname").limit(k).withColumn("lap", F.lit(0))
    again = hosts.filter(F.col("hostname") < cursor).orderBy("hostname").limit(k).withColumn("lap", F.lit(1))
    both = after.unionByName(again)  # at most 2k rows
    ranked = both.withColumn("pick", F.row_number().over(W.orderBy("lap", "hostname")))
    return ranked.filter(F.col("pick") <= k).select("hostname", "pick")


def oldest_urls(urls: DataFrame, quota: int, now: Column, age_days: int = 7) -> DataFrame:
    """Per host the URLs that were read longest ago, beyond an age."""
    old = urls.filter(F.datediff(now, F.col("last_access")) > age_days)
    w = W.partitionBy("hostname").orderBy("last_access", "url")
    return old.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= quota).select("hostname", "url", "last_access", "k")


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.unionByName(o)
    return first.distinct()

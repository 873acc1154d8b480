"""The language model: part-of-speech roll-ups, maximum likelihood, back-off weights.

Where a sum of probabilities has one denominator, whole numbers are summed first and divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KATZ = 10
SMALLEST, LARGEST = 1.1754943508222875e-38, 3.4028234663852886e38


def pos_unigrams(unigrams: DataFrame, lexicon: DataFrame) -> DataFrame:
    """unigrams (w1, cnt), lexicon (display, pos). Per pos: cnt, seen and all distinct words."""
    both = lexicon.select(F.col("display").alias("w1"), "pos").join(unigrams, "w1", "left")
    return both.groupBy("pos").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.count("cnt").alias("seen"), F.count(F.lit(1)).alias("all_words"))


def pos_ngrams(joined: DataFrame, n: int) -> DataFrame:
    """joined: p1..pn, cnt. Counts of sequences of parts of speech."""
    return joined.groupBy(*[f"p{k}" for k in range(1, n + 1)]).agg(F.sum("cnt").alias("cnt"))


def katz_filter(ngrams: DataFrame, k: int = KATZ) -> DataFrame:
    """Word bigrams are kept above the threshold, not at it."""
    return ngrams.filter(F.col("cnt") > k)


def inside_prob(lexicon: DataFrame, unigrams: DataFrame, pos: DataFrame) -> DataFrame:
    """P(word | pos); unseen words share the mass of one count."""
    pos = pos.select("pos", F.col("cnt").alias("pos_cnt"), "seen", "all_words")
    both = lexicon.join(unigrams.select(F.col("w1").alias("display"), "cnt"), "display", "left").join(pos, "pos")
    unseen = F.col("all_words") - F.col("seen")
    u = (F.col("pos_cnt") + F.when(unseen > 0, 1).otherwise(0)).cast("double")
    p = F.when(F.col("cnt").isNotNull(), F.col("cnt").cast("double") / u).otherwise(F.lit(1.0) / u / unseen)
    return both.select("display", "pos", p.alias("p_inside"))


def mle(pairs: DataFrame, totals: DataFrame, key: str, left: str) -> DataFrame:
    """pairs with p = cnt / total of their left part. totals: key, cnt."""
    t = totals.select(F.col(key).alias(left), F.col("cnt").alias("total"))
    return pairs.join(t, left).withColumn("p", F.col("cnt").cast("double") / F.greatest(F.col("total"), F.lit(1)))


def back_off(high: Column, low: Column) -> Column:
    """(1 - mass of stored longer ones) / (1 - their mass by the shorter model), 1 unless both are below 1."""
    ratio = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.try_divide(1 - high, 1 - low)))
    return F.when((high < 1) & (low < 1), ratio).otherwise(F.lit(1.0))


def trigram_backoff(tri: DataFrame, bi: DataFrame, prefix: str, least: int = 0) -> DataFrame:
    """Back-off weights of bigrams from trigrams, on words or parts of speech (columns <prefix>1..3).

    A trigram counts if its count is at least `least`, its first two parts are a stored bigram, and its last two are one.
    """
    a, b, c = (f"{prefix}{k}" for k in (1, 2, 3))
    head = bi.select(a, b, F.col("cnt").alias("head_cnt"))
    tail_total = bi.groupBy(F.col(a).alias(b)).agg(F.sum("cnt").alias("tail_total"))
    tail = bi.select(F.col(a).alias(b), F.col(b).alias(c), F.col("cnt").alias("tail_cnt")).join(tail_total, b)
    rows = tri.filter(F.col("cnt") >= least).join(head, [a, b]).join(tail, [b, c])
    per = rows.groupBy(a, b, "head_cnt").agg(F.sum("cnt").alias("stored"), F.sum("tail_cnt").alias("low"), F.first("tail_total").alias("total"))
    high, low = F.col("stored").cast("double") / F.col("head_cnt"), F.col("low").cast("double") / F.col("total")
    return per.select(a, b, "stored", back_off(high, low).alias("back_off"))


def pos_backoff(bigrams: DataFrame, unigrams: DataFrame, pos_bi: DataFrame, pos: DataFrame, inside: DataFrame) -> DataFrame:
    """Back-off weight of each head word to parts of speech. bigrams: w1, w2, p1, p2, cnt."""
    total = unigrams.select("w1", F.col("cnt").alias("total"))
    by_pos = mle(pos_bi, pos.select("pos", "cnt"), "pos", "p1").select("p1", "p2", F.col("p").alias("p_pos"))
    inner = inside.select(F.col("display").alias("w2"), F.col("pos").alias("p2"), "p_inside")
    rows = bigrams.join(total, "w1").join(by_pos, ["p1", "p2"]).join(inner, ["w2", "p2"])
    per = rows.groupBy("w1", "total").agg(F.sum("cnt").alias("stored"), F.sum(F.col("p_pos") * F.col("p_inside")).alias("low"))
    return per.select("w1", "stored", back_off(F.col("stored").cast("double") / F.col("total"), F.col("low")).alias("back_off"))


def phrase_score(phrases: DataFrame, pos: DataFrame) -> DataFrame:
    """phrases: gram, cnt, p1. Score = count over the count of the first word's part of speech."""
    return mle(phrases, pos.select("pos", "cnt"), "pos", "p1").select("gram", "cnt", F.col("p").alias("score"))


def next_words(bigrams: DataFrame, unigrams: DataFrame, k: int = 5) -> DataFrame:
    """The k likeliest next words of each head word. bigrams: w1, w2, cnt."""
    from pyspark.sql.window import Window as W

    rows = mle(bigrams, unigrams, "w1", "w1")
    w = W.partitionBy("w1").orderBy(F.desc("cnt"), "w2")
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("w1", "w2", "cnt", "p", "k")

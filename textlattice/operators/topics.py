"""Topic models in long form (word, topic, p): training of two models, merging, entropy-ranked summaries.

Training keeps a word's probabilities as one array `ps`, by topic in order, so that no step's rows grow with the topics.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textlattice.sources.files import written

#: Unique words at which a buffer of documents is learned, and the words that a model is expected to have at last.
FULL, EXPECTED = 30_000, 300_000
KEEP, BACK, NEAR, LEAST_WORDS = 0.5, 5, 0.1, 4
TINY = 1 / 3.4028234663852886e38


def term_counts(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, word, tf."""
    return docs.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))


def normalised(rows: DataFrame, value: str = "p") -> DataFrame:
    """word, topic, p with a sum of 1 for each topic."""
    total = rows.groupBy("topic").agg(F.sum(value).alias("_t"))
    return rows.join(F.broadcast(total), "topic").select("word", "topic", (F.col(value).cast("double") / F.col("_t")).alias("p"))  # a row per topic


def smoothed(counts: DataFrame, topics: list[str]) -> DataFrame:
    """counts: word, topic, tf. Per word an array of (tf + 1) / (total + words), by topic in order."""
    wide = counts.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("tf"))), F.lit(0)).alias(f"c{k}") for k, t in enumerate(topics)])
    sums = wide.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"c{k}").alias(f"s{k}") for k in range(len(topics))])
    p = [(F.col(f"c{k}") + 1).cast("double") / (F.col(f"s{k}") + F.col("v")) for k in range(len(topics))]
    return wide.crossJoin(F.broadcast(sums)).select("word", F.array(*p).alias("ps"))  # one row


def mixture_step(tf: DataFrame, model: DataFrame, topics: list[str], key: str) -> DataFrame:
    """Posterior topics of documents under a mixture of unigrams with equal priors: key, topic, posterior."""
    logs = tf.join(model, "word").groupBy(key).agg(*[F.sum(F.col("tf") * F.ln(F.col("ps")[k])).alias(f"l{k}") for k in range(len(topics))])
    every = [F.col(f"l{k}") for k in range(len(topics))]
    logs = logs.withColumn("m", F.greatest(*every))
    weights = [F.exp(x - F.col("m")) for x in every]
    whole = sum(weights[1:], weights[0])
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), (w / whole).alias("posterior")) for t, w in zip(topics, weights, strict=True)])
    return logs.select(key, F.explode(pairs).alias("x")).select(key, "x.topic", "x.posterior")


def plsa_step(tf: DataFrame, model: DataFrame, topics: list[str], key: str) -> DataFrame:
    """One step of the per-document model. A document's words share its topics: an aggregate per document joined back, so
    that the work is in proportion to the counts. word, topic, p."""
    n = range(len(topics))
    both = tf.join(model, "word")
    whole = F.aggregate("ps", F.lit(0.0), lambda a, x: a + x)
    docs = both.groupBy(key).agg(*[F.sum(F.col("tf") * F.col("ps")[k] / whole).alias(f"d{k}") for k in n])
    sums = tf.join(docs, key).groupBy("word").agg(*[F.sum(F.col("tf") * F.col(f"d{k}")).alias(f"w{k}") for k in n])
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"w{k}").alias("p")) for k, t in enumerate(topics)])
    return normalised(sums.select("word", F.explode(pairs).alias("x")).select("word", "x.topic", "x.p"))


def merged(old: DataFrame, new: DataFrame, rate: float) -> DataFrame:
    """old * rate + new * (1 - rate); a word that one side lacks counts in full; normalised again."""
    both = old.withColumnRenamed("p", "a").join(new.withColumnRenamed("p", "b"), ["word", "topic"], "full_outer")
    p = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.col("a") * rate + F.col("b") * (1 - rate))
    return normalised(both.select("word", "topic", p.alias("p")))


def entropies(model: DataFrame, n_topics: int) -> DataFrame:
    """model: word, topic, p. word, marginal, entropy over topics from 0 to 1; 0 where there is one topic."""
    total = model.groupBy("word").agg(F.sum("p").alias("whole"))
    q = F.col("p") / F.col("whole")
    part = model.join(total, "word").withColumn("h", F.when(q > 0, -q * F.log2(q)).otherwise(0.0))
    return part.groupBy("word").agg((F.first("whole") / max(n_topics, 1)).alias("marginal"), (F.sum("h") / math.log2(max(n_topics, 2))).alias("entropy"))


def entropy_lists(words: DataFrame, k: int = 100) -> DataFrame:
    """words: word, marginal, entropy. The k first words by four measures: measure, rank, word."""
    h, p = F.col("entropy"), F.col("marginal")
    out = None
    for name, value in (("sure", 1 - h), ("sure_frequent", (1 - h) * p), ("even", h), ("even_frequent", h * p)):
        top = words.select(F.lit(name).alias("measure"), F.round(value, 9).alias("v"), "word").orderBy(F.desc("v"), "word").limit(k)
        out = top if out is None else out.unionByName(top)
    return out.select("measure", F.row_number().over(W.partitionBy("measure").orderBy(F.desc("v"), "word")).alias("rank"), "word")  # 4 k rows


def topic_top_words(model: DataFrame, words: DataFrame, k: int = 100) -> DataFrame:
    """Per topic its k words with the largest p * (1 - entropy)."""
    rows = model.join(words.select("word", "entropy"), "word").withColumn("v", F.round(F.col("p") * (1 - F.col("entropy")), 9))
    w = W.partitionBy("topic").orderBy(F.desc("v"), "word")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("topic", "rank", "word")


def recent(series: DataFrame, key: str, order: list[str], value: str, size: int = 50, back: int = 5, share: float = 0.1) -> DataFrame:
    """Mean and least of the last `size` values, and whether all of the last `back` ones before are within `share`."""
    w, b = W.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0), W.partitionBy(key).orderBy(*order).rowsBetween(-back, -1)
    v = F.col(value)
    near = (F.min(value).over(b) >= v * (1 - share)) & (F.max(value).over(b) <= v * (1 + share))
    return series.select("*", F.avg(value).over(w).alias("mean"), F.min(value).over(w).alias("least"), F.coalesce(near, F.lit(False)).alias("converged"))


def target_words(words: Column, excluded: Callable[[Column], Column]) -> Column:
    """words without those that `excluded`, an expression of the element x, takes out."""
    return F.filter(words, lambda x: ~F.coalesce(excluded(x), F.lit(False)))


def learnable(docs: DataFrame, words: str = "words", least: int = LEAST_WORDS) -> DataFrame:
    """Documents with at least `least` target words."""
    return docs.filter(F.size(words) >= least)


def unique_words(docs: DataFrame, batch: str, words: str = "words", full: int = FULL) -> DataFrame:
    """batch, n_docs, n_words (unique ones), learn (enough for training), save (under a fifth of that, so little is lost)."""
    size = docs.groupBy(batch).agg(F.count(F.lit(1)).alias("n_docs"))
    one = docs.select(batch, F.explode(words).alias("w")).distinct().groupBy(batch).agg(F.count(F.lit(1)).alias("n_words"))
    rows = size.join(one, batch, "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    return rows.withColumn("learn", F.col("n_words") >= full).withColumn("save", F.col("n_words") * 5 < full)


def snapshot_due(last: int, hour: int, hourly: bool, every: int = 6) -> tuple[bool, bool]:
    """(save now, still hourly): at each new hour at first, until one comes that is `every` hours after the last save."""
    if (last + every) % 24 == hour:
        return True, False
    return hourly and last != hour, hourly


def prepared(model: DataFrame | None, words: DataFrame, n: int, expected: int = EXPECTED) -> DataFrame:
    """The model (word, ps) with all words; new ones get small values by a hash of word and topic, so that reruns agree."""
    own = lambda k: F.pmod(F.xxhash64("word", F.lit(k)), F.lit(999_998)) + 1
    values = lambda span: F.array(*[own(k) / 1e6 * span + 1 / expected for k in range(n)])
    if model is None:
        return scaled(words.select("word").distinct().select("word", values(1.0).alias("ps")), n)
    new = words.select("word").distinct().join(model, "word", "left_anti").select("word", values(1 / expected).alias("ps"))
    return scaled(model.select("word", "ps").unionByName(new), n)


def scaled(model: DataFrame, n: int) -> DataFrame:
    """word, ps with a sum of 1 for each topic."""
    sums = model.agg(F.array(*[F.greatest(F.sum(F.col("ps")[k]), F.lit(TINY)) for k in range(n)]).alias("s"))
    return model.crossJoin(F.broadcast(sums)).select("word", F.zip_with("ps", "s", lambda p, s: p / s).alias("ps"))  # one row


def blended(old: DataFrame, new: DataFrame, n: int, keep: float = KEEP) -> DataFrame:
    """old * keep + new * (1 - keep) of two models with arrays; words that only new has come in whole. Normalised again."""
    both = old.select("word", F.col("ps").alias("a")).join(new.select("word", F.col("ps").alias("b")), "word", "full_outer")
    p = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.transform("a", lambda x: x * keep)).otherwise(F.zip_with("a", "b", lambda x, y: x * keep + y * (1 - keep)))
    return scaled(both.select("word", p.alias("ps")), n)


def mixture_posteriors(tf: DataFrame, model: DataFrame, n: int, key: str) -> DataFrame:
    """Per document its posterior topics qs under equal priors, its log likelihood ll and its number of words."""
    both = tf.join(model, "word")
    logs = both.groupBy(key).agg(F.array(*[F.sum(F.col("tf") * F.ln(F.greatest(F.col("ps")[k], F.lit(TINY)))) for k in range(n)]).alias("ls"), F.sum("tf").alias("n_words"))
    logs = logs.withColumn("m", F.array_max("ls")).withColumn("xs", F.expr("transform(ls, l -> exp(l - m))"))
    logs = logs.withColumn("whole", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x))
    return logs.select(key, F.expr("transform(xs, x -> x / whole)").alias("qs"), (F.col("m") + F.ln("whole")).alias("ll"), "n_words")


def topics_of(tf: DataFrame, model: DataFrame, prior: list[float], key: str) -> DataFrame:
    """Per document its topics ds before the first round of the per-document model: the sum of its words' topics."""
    n = len(prior)
    rows = tf.join(model, "word").withColumn("qs", F.zip_with("ps", F.lit(prior), lambda p, x: p * x))
    rows = rows.withColumn("s", F.aggregate("qs", F.lit(0.0), lambda a, x: a + x))
    return _by_document(rows.groupBy(key).agg(F.array(*[F.sum(F.col("tf") * F.col("qs")[k] / F.col("s")) for k in range(n)]).alias("ds")))


def _by_document(rows: DataFrame) -> DataFrame:
    whole = F.greatest(F.aggregate("ds", F.lit(0.0), lambda a, x: a + x), F.lit(TINY))
    return rows.withColumn("_w", whole).withColumn("ds", F.expr("transform(ds, d -> d / _w)")).drop("_w")


def document_sums(tf: DataFrame, model: DataFrame, docs: DataFrame, n: int, key: str) -> DataFrame:
    """Per document the sum of its words' topics given its own ones (ds): qs, with ll and n_words."""
    rows = tf.join(model, "word").join(docs.select(key, "ds"), key).withColumn("xs", F.zip_with("ps", "ds", lambda p, d: p * d))
    rows = rows.withColumn("s", F.greatest(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), F.lit(TINY)))
    sums = F.array(*[F.sum(F.col("tf") * F.col("xs")[k] / F.col("s")) for k in range(n)])
    return rows.groupBy(key).agg(sums.alias("qs"), F.sum(F.col("tf") * F.ln("s")).alias("ll"), F.sum("tf").alias("n_words"))


def next_model(tf: DataFrame, model: DataFrame, docs: DataFrame, n: int, key: str, keep: float = KEEP) -> DataFrame:
    """The model after a round: each word's share of its documents' topics (qs), blended with the model before."""
    sums = tf.join(docs.select(key, "qs"), key).groupBy("word").agg(F.array(*[F.sum(F.col("tf") * F.col("qs")[k]) for k in range(n)]).alias("ps"))
    return blended(model, scaled(sums, n), n, keep)


def perplexity(docs: DataFrame) -> DataFrame:
    """docs: ll, n_words. One row: perplexity."""
    return docs.agg(F.exp(-F.sum("ll") / F.sum("n_words")).alias("perplexity"))


def prior_of(docs: DataFrame, topics: str, n: int) -> list[float]:
    """The mean of the documents' topics, with a sum of 1."""
    sums = docs.agg(*[F.sum(F.col(topics)[k]).alias(f"s{k}") for k in range(n)]).first()
    whole = max(sum(x or 0.0 for x in sums), TINY)
    return [(x or 0.0) / whole for x in sums]


def settled(before: list[float], now: float, back: int = BACK, near: float = NEAR) -> bool:
    """Whether all of the last `back` perplexities are within a share of this one; not without any."""
    return bool(before) and all(abs(x - now) < now * near for x in before[-back:])


def trained(tf: DataFrame, key: str, n: int, model: DataFrame | None = None, prior: list[float] | None = None, mixture: bool = True, keep: float = KEEP, most: int = 100) -> tuple[DataFrame, list[float], list[float]]:
    """tf: key, word, tf. (model, prior, perplexities) after rounds until these settle, `most` at most; the earlier model
    and prior keep their share. Each round's tables are written, so that the next one doesn't compute them again. An empty
    table leaves the model as it is."""
    prior = prior or [1 / n] * n
    tf = written(tf, "topic-counts")
    if tf.isEmpty():
        return model, prior, []
    now = written(prepared(model, tf, n), "topic-model")
    docs = None if mixture else written(topics_of(tf, now, prior, key), "topic-documents")
    seen: list[float] = []
    for _ in range(most):
        docs = written(mixture_posteriors(tf, now, n, key) if mixture else document_sums(tf, now, docs, n, key).withColumn("ds", F.col("qs")), "topic-documents")
        value = perplexity(docs).first()["perplexity"]
        now = written(next_model(tf, now, docs, n, key, keep), "topic-model")
        docs = docs if mixture else _by_document(docs)
        if settled(seen, value):
            break
        seen.append(value)
    own = prior_of(docs, "qs" if mixture else "ds", n)
    return (now if model is None else written(blended(model, now, n, keep), "topic-model")), [keep * a + (1 - keep) * b for a, b in zip(prior, own, strict=True)], seen


def long_form(model: DataFrame, topics: list[str]) -> DataFrame:
    """word, ps as word, topic, p."""
    return model.select("word", F.posexplode("ps").alias("k", "p")).select("word", F.element_at(F.lit(topics), F.col("k") + 1).alias("topic"), "p")


def save_topics(model: DataFrame, path: str) -> None:
    """model: word, topic, p, as a table."""
    model.select("word", "topic", "p").write.mode("overwrite").parquet(path)


def load_topics(model: DataFrame, topics: list[str], expected: int = EXPECTED) -> DataFrame:
    """word, topic, p as word, ps. Topics that a word lacks get a small value by a hash; normalised."""
    own = lambda k: (F.pmod(F.xxhash64("word", F.lit(k)), F.lit(999_998)) + 1) / 1e6 / expected
    wide = model.groupBy("word").agg(*[F.max(F.when(F.col("topic") == t, F.col("p"))).alias(f"p{k}") for k, t in enumerate(topics)])
    return scaled(wide.select("word", F.array(*[F.coalesce(f"p{k}", own(k)) for k in range(len(topics))]).alias("ps")), len(topics))


def topics_by_prior(prior: DataFrame, top: DataFrame) -> DataFrame:
    """prior: topic, prior; top: topic, rank, word. place (of the topic, the likeliest first), topic, rank, word."""
    places = prior.withColumn("place", F.row_number().over(W.orderBy(F.desc("prior"), "topic")))  # a row per topic
    return top.join(F.broadcast(places.select("topic", "place")), "topic").select("place", "topic", "rank", "word")


def summary_json(ordered: DataFrame) -> DataFrame:
    """topics_by_prior's rows as one JSON document for each topic: place, summary."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])  # a hundred words
    return ordered.groupBy("place", "topic").agg(words.alias("words")).select("place", F.to_json(F.struct("topic", "words")).alias("summary"))

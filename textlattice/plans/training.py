"""Queries over topic models: target words, one round of training of each model, perplexity, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import topics as M
from textlattice.plans import counts as C
from textlattice.plans import users as U
from textlattice.sources.files import written
from textlattice.sources.pages import read_documents

#: Light words of the tables' languages; numbers and words of up to two letters go as well.
LIGHT = ["and", "that", "the", "this", "das", "der", "die", "und", "con", "los", "para", "que", "des", "les", "pour", "une"]
KEEP = 0.5


def _targets(spark, d):
    words = M.target_words(T.tokens("text"), lambda x: T.is_number(x) | (F.length(x) <= 2) | x.isin(LIGHT))
    return M.learnable(read_documents(spark, d).select("doc_id", "source", words.alias("words")))


def topic_target_words(spark, d):
    return M.term_counts(_targets(spark, d), "doc_id", F.col("words"))


def topic_unique_words(spark, d):
    return M.unique_words(_targets(spark, d), "source")


def _tf(spark, d):
    return written(topic_target_words(spark, d), "topic-counts")




def _start(spark, d):
    """Counts, a first model and its topics, and what the mixture makes of the documents."""
    tf, (model, langs) = _tf(spark, d), U._smoothed(spark, d)
    return tf, model, langs


def _mixture(tf, model, n):
    return written(M.mixture_posteriors(tf, model, n, "doc_id"), "posteriors")


def mixture_round_once(spark, d):
    tf, model, langs = _start(spark, d)
    out = M.next_model(tf, model, _mixture(tf, model, len(langs)), len(langs), "doc_id", KEEP)
    return M.long_form(out, langs).withColumn("p", F.round("p", 9))


def _documents(tf, model, n):
    return written(M.document_sums(tf, model, M.topics_of(tf, model, [1 / n] * n, "doc_id"), n, "doc_id"), "document-sums")


def topic_round_once(spark, d):
    tf, model, langs = _start(spark, d)
    out = M.next_model(tf, model, _documents(tf, model, len(langs)), len(langs), "doc_id", KEEP)
    return M.long_form(out, langs).withColumn("p", F.round("p", 9))


def topic_perplexity(spark, d):
    tf, model, langs = _start(spark, d)
    one = M.perplexity(_mixture(tf, model, len(langs))).withColumn("model", F.lit("mixture"))
    two = M.perplexity(_documents(tf, model, len(langs))).withColumn("model", F.lit("documents"))
    return one.unionByName(two).select("model", F.round("perplexity", 4).alias("perplexity"))


def _ordered(spark, d):
    prior = read_documents(spark, d).groupBy(F.coalesce("lang", F.lit("")).alias("topic")).agg(F.count(F.lit(1)).alias("prior"))
    return M.topics_by_prior(prior, U.topic_top_words(spark, d))


def topic_prior_words(spark, d):
    return _ordered(spark, d)


def topic_summary(spark, d):
    return M.summary_json(_ordered(spark, d))


def log_sum_pairs(spark, d):
    """Bigram and reversed bigram probabilities added as logs; a reversed one that is missing, or has a log of 0, adds nothing."""
    p = C.word_bigram_prob(spark, d).select("w1", "w2", F.ln("p").alias("a"))
    back = p.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), F.col("a").alias("b"))
    both = p.join(back, ["w1", "w2"], "left")
    return both.select("w1", "w2", F.round(T.finite(T.log_add(F.coalesce("b", F.lit(0.0)), "a")), 6).alias("log_p"))


QUERIES = {
    f.__name__: f
    for f in (topic_target_words, topic_unique_words, mixture_round_once, topic_round_once, topic_perplexity, topic_prior_words, topic_summary, log_sum_pairs)
}

_STOP = ", ".join(f"'{w}'" for w in LIGHT)
_TARGETS = f"""targets AS (SELECT doc_id, source, words FROM (SELECT doc_id, source, list_filter({C.TOKENS},
    lambda x: {C.pos_sql('x')} NOT IN ('num', 'func') AND x NOT IN ({_STOP})) AS words FROM documents) WHERE len(words) >= {M.LEAST_WORDS})"""
_TF = f"{_TARGETS}, tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM targets) GROUP BY ALL)"
_POST = """l AS (SELECT doc_id, topic, sum(tf * ln(p)) AS l, sum(tf) AS n FROM tf JOIN sm USING (word) GROUP BY doc_id, topic),
  m AS (SELECT *, max(l) OVER (PARTITION BY doc_id) AS m FROM l), e AS (SELECT *, sum(exp(l - m)) OVER (PARTITION BY doc_id) AS whole FROM m),
  docs AS (SELECT doc_id, topic, exp(l - m) / whole AS q, m + ln(whole) AS ll, n FROM e)"""
_DOCS = """f AS (SELECT doc_id, topic, sum(tf * q) AS q FROM tf JOIN (SELECT word, topic, p / sum(p) OVER (PARTITION BY word) AS q FROM sm) USING (word) GROUP BY doc_id, topic),
  ds AS (SELECT doc_id, topic, q / sum(q) OVER (PARTITION BY doc_id) AS d FROM f),
  x AS (SELECT doc_id, word, topic, tf, p * d AS x, sum(p * d) OVER (PARTITION BY doc_id, word) AS s FROM tf JOIN sm USING (word) JOIN ds USING (doc_id, topic)),
  docs AS (SELECT doc_id, topic, sum(tf * x / s) AS q, sum(tf * ln(s)) AS ll, sum(tf) AS n FROM x GROUP BY doc_id, topic)"""
_NEXT = f"""nx AS (SELECT word, topic, sum(tf * q) AS x FROM tf JOIN docs USING (doc_id) GROUP BY word, topic),
  np AS (SELECT word, topic, x / sum(x) OVER (PARTITION BY topic) AS p FROM nx),
  b AS (SELECT sm.word, sm.topic, sm.p * {KEEP}::DOUBLE + coalesce(np.p, 0) * {1 - KEEP}::DOUBLE AS p FROM sm LEFT JOIN np ON np.word = sm.word AND np.topic = sm.topic)
  SELECT word, topic, round(p / sum(p) OVER (PARTITION BY topic), 9) AS p FROM b"""
_ORDERED = f"""top AS ({U.ORACLE['topic_top_words']}), places AS (SELECT topic, CAST(row_number() OVER (ORDER BY count(*) DESC, topic) AS INT) AS place FROM (SELECT coalesce(lang, '') AS topic FROM documents) GROUP BY topic),
  ordered AS (SELECT place, topic, rank, word FROM top JOIN places USING (topic))"""


def _perplexity(name: str) -> str:
    return f"SELECT '{name}' AS model, round(exp(-sum(ll) / sum(n)), 4) AS perplexity FROM (SELECT DISTINCT ON (doc_id) doc_id, ll, n FROM docs)"


ORACLE = {
    "topic_target_words": f"WITH {_TF} SELECT * FROM tf",
    "topic_unique_words": f"""WITH {_TARGETS}, s AS (SELECT source, count(*) AS n_docs FROM targets GROUP BY source),
        u AS (SELECT source, count(DISTINCT w) AS n_words FROM (SELECT source, unnest(words) AS w FROM targets) GROUP BY source)
        SELECT source, n_docs, n_words, n_words >= {M.FULL} AS learn, n_words * 5 < {M.FULL} AS save FROM s JOIN u USING (source)""",
    "mixture_round_once": f"WITH {U._SMOOTH}, {_TF}, {_POST}, {_NEXT}",
    "topic_round_once": f"WITH {U._SMOOTH}, {_TF}, {_DOCS}, {_NEXT}",
    "topic_perplexity": f"SELECT * FROM (WITH {U._SMOOTH}, {_TF}, {_POST} {_perplexity('mixture')}) UNION ALL SELECT * FROM (WITH {U._SMOOTH}, {_TF}, {_DOCS} {_perplexity('documents')})",
    "topic_prior_words": f"WITH {_ORDERED} SELECT * FROM ordered",
    "topic_summary": f"""WITH {_ORDERED} SELECT place, '{{"topic":"' || topic || '","words":["' || string_agg(word, '","' ORDER BY rank) || '"]}}' AS summary FROM ordered GROUP BY place, topic""",
    "log_sum_pairs": f"""WITH x AS ({C.ORACLE['word_bigram_prob']})
        SELECT x.w1, x.w2, round(CASE WHEN y.p IS NULL OR y.p = 1 THEN ln(x.p) ELSE greatest(ln(x.p), ln(y.p)) + ln(1 + exp(least(ln(x.p), ln(y.p)) - greatest(ln(x.p), ln(y.p)))) END, 6) + 0.0 AS log_p
        FROM x LEFT JOIN x y ON y.w1 = x.w2 AND y.w2 = x.w1""",
}

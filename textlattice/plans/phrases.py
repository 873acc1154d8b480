"""Queries over phrases, prefixes, homonyms and the word lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import langmodel as L
from textlattice.operators import lattice as A
from textlattice.operators import mining as M
from textlattice.operators import ngrams as N
from textlattice.operators import phrases as P
from textlattice.plans import counts as C
from textlattice.sources.files import drop_written, written

ORDERS, CAP = 7, 1_000_000
#: Parts in which both directions' counts are joined.
JOINED = 4
BEST = 3
ASKED = ["th", "en", "a", "tion", "hein", "ver", "lich", "euxo", "zzz", "the"]


def _discounted(spark, d, *walks):
    """walks: (backward, every). Each one's discounted counts, from sentences that are written once for all of them."""
    texts = M.texts(C.sentences(spark, d))
    out = [M.mined(texts, ORDERS, backward, every).withColumn("disc", F.coalesce("disc", F.lit(0))) for backward, every in walks]
    drop_written(spark, texts)  # what is counted is written
    return out


def phrase_discount_fwd(spark, d):
    return _discounted(spark, d, (False, True))[0]


def phrase_discount_rev(spark, d):
    return _discounted(spark, d, (True, True))[0]


def phrase_reconciled(spark, d):
    return P.reconciled(*_discounted(spark, d, (False, True), (True, False)), ORDERS, JOINED)


def phrase_ranked(spark, d):
    return P.ranked_phrases(P.agreed(*_discounted(spark, d, (False, False), (True, False)), ORDERS, JOINED), ORDERS, CAP)


def _entries(spark, d):
    u = C.unigrams(spark, d)
    return u.select(T.reading_of("w1").alias("reading"), F.col("w1").alias("display"), T.pos_of("w1").alias("pos"), "cnt")


def prefix_topk(spark, d):
    return P.prefix_topk(_entries(spark, d))


def _asked(spark):
    return spark.createDataFrame([(a,) for a in ASKED], "prefix string")


def prefix_lookup(spark, d):
    return P.complete(_asked(spark), _entries(spark, d), prefix_topk(spark, d))


def predict_ordered_dedup(spark, d):
    exact = _asked(spark).join(_entries(spark, d).withColumnRenamed("reading", "prefix"), "prefix")
    exact = exact.select("prefix", F.lit(1).alias("rank"), "display")
    return P.ordered_dedup(prefix_lookup(spark, d), exact)


def _inside(spark, d):
    return C.inside_prob(spark, d).withColumn("reading", T.reading_of("display"))


def homonym_rank(spark, d):
    return P.rank_homonyms(_inside(spark, d))


def homonym_prune(spark, d):
    heads = C.words_of(L.katz_filter(C.grams(spark, d, 2)), 2).select(F.col("w1").alias("display"))
    return P.prune_homonyms(_inside(spark, d), heads)


def key_lcp_neighbors(spark, d):
    return P.unique_prefixes(_entries(spark, d).select(F.col("reading").alias("key")).distinct())


def letter_group(spark, d):
    return P.letter_groups(_entries(spark, d))


def _strings(spark, d):
    return _entries(spark, d).filter("not startswith(display, '[')").select(F.col("reading").alias("s")).distinct()


def lattice_chars(spark, d):
    return A.chars(_strings(spark, d))


def _dictionary(spark, d):
    """All readings: one entry for each part of speech."""
    e = _entries(spark, d).filter(~F.col("display").startswith("["))
    total = C.unigrams(spark, d).agg(F.sum("cnt").alias("total"))
    per = e.groupBy("reading", "pos").agg(F.sum("cnt").alias("cnt"))
    costs = per.crossJoin(F.broadcast(total)).select("reading", "pos", A.cost(F.col("cnt"), F.col("total")).alias("cost"))  # one row
    return written(costs, "dictionary")


def _links(spark, d):
    """Sentences are tagged before they are counted, so that no pair of words is shuffled."""
    kind = lambda w: F.when(w == N.BOS, A.BOS).when(w == N.EOS, A.EOS).otherwise(T.pos_of(w))
    both = N.count_ngrams(C.sentences(spark, d).select(F.transform("words", kind).alias("words")), 2)
    return A.link_costs(both.select(*[F.split("gram", " ")[k].alias(f"p{k + 1}") for k in range(2)], "cnt"))


def lattice_edges(spark, d):
    words = _dictionary(spark, d)
    return A.edges(words.select(F.col("reading").alias("s")).distinct(), words)


def _arcs(spark, d):
    words = _dictionary(spark, d)
    s = words.select(F.col("reading").alias("s")).distinct()
    return A.with_unknown(A.edges(s, words), s, words)


def viterbi_best(spark, d):
    return A.best_paths(_arcs(spark, d), _links(spark, d)).drop("rank")


def segment_enumerate_top(spark, d):
    return A.best_paths(_arcs(spark, d), _links(spark, d), BEST)


QUERIES = {
    f.__name__: f
    for f in (phrase_discount_fwd, phrase_discount_rev, phrase_reconciled, phrase_ranked, prefix_topk, prefix_lookup, predict_ordered_dedup, homonym_rank, homonym_prune, key_lcp_neighbors, letter_group, lattice_chars, lattice_edges, viterbi_best, segment_enumerate_top)
}


def _discount_sql(name: str, reverse: bool) -> str:
    """Common tables {name}_own1..: gram, cnt, disc."""
    out = []
    for n in range(ORDERS, 0, -1):
        gram = "array_to_string(list_reverse(string_split(gram, ' ')), ' ')" if reverse else "gram"
        out.append(f"{name}_g{n} AS MATERIALIZED (SELECT {gram} AS gram, cnt FROM g{n})")
        if n == ORDERS:
            out.append(f"{name}_own{n} AS MATERIALIZED (SELECT gram, cnt, cnt AS disc, false AS swaps FROM {name}_g{n})")
            out.append(f"{name}_list{n} AS MATERIALIZED (SELECT gram AS node, gram AS entry, disc FROM {name}_own{n})")
            continue
        out.append(f"""{name}_top{n} AS MATERIALIZED (SELECT * FROM (SELECT regexp_replace(node, ' [^ ]+$', '') AS node, entry, disc FROM {name}_list{n + 1})
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY disc DESC, entry) <= {P.TOP})""")
        out.append(f"{name}_sum{n} AS MATERIALIZED (SELECT node, sum(disc) AS longer, count(*) AS size, min(disc) AS last FROM {name}_top{n} GROUP BY node)")
        out.append(f"""{name}_own{n} AS MATERIALIZED (SELECT gram, cnt, CAST(CASE WHEN rest <= 0 THEN NULL WHEN size < {P.TOP} THEN rest WHEN last < rest THEN rest + last END AS BIGINT) AS disc,
            size >= {P.TOP} AND rest > 0 AND last < rest AS swaps
            FROM (SELECT gram, cnt, cnt - coalesce(longer, 0) AS rest, coalesce(size, 0) AS size, last FROM {name}_g{n} LEFT JOIN {name}_sum{n} ON gram = node))""")
        out.append(f"""{name}_list{n} AS MATERIALIZED (SELECT node, entry, disc FROM (SELECT t.*, row_number() OVER (PARTITION BY t.node ORDER BY t.disc DESC, t.entry) AS k, coalesce(o.swaps, false) AS swaps
            FROM {name}_top{n} t LEFT JOIN {name}_own{n} o ON o.gram = t.node) WHERE NOT (swaps AND k = {P.TOP})
            UNION ALL SELECT gram, gram, disc FROM {name}_own{n} WHERE disc IS NOT NULL)""")
    every = " UNION ALL ".join(f"SELECT {n} AS n, gram, cnt, disc FROM {name}_own{n}" for n in range(1, ORDERS + 1))
    return ",\n".join(out) + f",\n{name} AS ({every})"


_GRAMS = ",\n".join(f"g{n} AS MATERIALIZED ({C.grams_sql(n)})" for n in range(1, ORDERS + 1))
_BOTH = f"""WITH {_GRAMS}, {_discount_sql("f", False)}, {_discount_sql("r", True)}, agreed AS (
    SELECT f.n, f.gram, f.cnt, least(coalesce(f.disc, 0), coalesce(b.disc, 0)) AS disc
    FROM f LEFT JOIN (SELECT array_to_string(list_reverse(string_split(gram, ' ')), ' ') AS gram, disc FROM r) b ON b.gram = f.gram)"""
_ENTRIES = f"entries AS (SELECT translate(w1, '{T.ACCENTS}', '{T.PLAIN}') AS reading, w1 AS display, {C.pos_sql('w1')} AS pos, cnt FROM uni)"
_CACHE = f"""cache AS (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY cnt DESC, display) AS rank, display, cnt
    FROM (SELECT left(reading, n) AS prefix, display, cnt FROM entries, range(1, 4) t(n) WHERE n < length(reading)) QUALIFY rank <= {P.TOP})"""
_ASKED = "asked(prefix) AS (VALUES " + ", ".join(f"('{a}')" for a in ASKED) + ")"
_LOOKUP = f"""lookup AS (SELECT a.prefix, rank, display, cnt FROM asked a JOIN cache c ON c.prefix = a.prefix
    UNION ALL SELECT a.prefix, row_number() OVER (PARTITION BY a.prefix ORDER BY cnt DESC, display) AS rank, display, cnt
    FROM asked a JOIN entries e ON starts_with(reading, a.prefix) AND reading <> a.prefix WHERE length(a.prefix) > 3 QUALIFY rank <= {P.TOP})"""
_INSIDE = f"WITH {C.UNI}, {C.LEX}, {C.POS}, {C.INSIDE}, i AS (SELECT *, translate(display, '{T.ACCENTS}', '{T.PLAIN}') AS reading FROM inside)"
_STRINGS = "strings AS (SELECT DISTINCT reading AS s FROM entries WHERE NOT starts_with(display, '['))"
_DICT = f"""dict AS (SELECT reading, pos, CAST(round(100 * ln(CAST((SELECT sum(cnt) FROM uni) AS DOUBLE) / sum(cnt))) AS BIGINT) AS cost
    FROM entries WHERE NOT starts_with(display, '[') GROUP BY reading, pos)"""
_EDGES = """edges AS (SELECT s, top, CAST(top + n AS INT) AS "end", reading, pos, cost FROM (
      SELECT s, top, n, substr(s, top + 1, n) AS sub FROM (SELECT s, CAST(unnest(range(0, length(s))) AS INT) AS top FROM strings), (SELECT DISTINCT CAST(length(reading) AS INT) AS n FROM dict) WHERE top + n <= length(s))
    JOIN dict ON reading = sub)"""

ORACLE = {
    "phrase_discount_fwd": f"WITH {_GRAMS}, {_discount_sql('f', False)} SELECT n, gram, cnt, coalesce(disc, 0) AS disc FROM f",
    "phrase_discount_rev": f"WITH {_GRAMS}, {_discount_sql('r', True)} SELECT n, gram, cnt, coalesce(disc, 0) AS disc FROM r",
    "phrase_reconciled": f"{_BOTH} SELECT * FROM agreed",
    "phrase_ranked": f"""{_BOTH} SELECT * FROM agreed WHERE disc >= 1 AND n = 1 UNION ALL
        SELECT * FROM (SELECT * FROM agreed WHERE disc >= 1 AND n > 1 AND n < {ORDERS} ORDER BY disc DESC, gram LIMIT {CAP})""",
    "prefix_topk": f"WITH {C.UNI}, {_ENTRIES}, {_CACHE} SELECT prefix, CAST(rank AS INT) AS rank, display, cnt FROM cache",
    "prefix_lookup": f"WITH {C.UNI}, {_ENTRIES}, {_CACHE}, {_ASKED}, {_LOOKUP} SELECT prefix, CAST(rank AS INT) AS rank, display, cnt FROM lookup",
    "predict_ordered_dedup": f"""WITH {C.UNI}, {_ENTRIES}, {_CACHE}, {_ASKED}, {_LOOKUP},
        every AS (SELECT prefix, display, 0 AS src, rank FROM lookup UNION ALL SELECT prefix, display, 1, 1 FROM asked JOIN entries ON reading = prefix),
        once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY prefix, display ORDER BY src, rank) = 1)
        SELECT prefix, display, CAST(row_number() OVER (PARTITION BY prefix ORDER BY src, rank, display) AS INT) AS place FROM once""",
    "homonym_rank": f"{_INSIDE} SELECT reading, display, pos, CAST(row_number() OVER (PARTITION BY reading ORDER BY p_inside DESC, display) AS INT) AS rank FROM i",
    "homonym_prune": f"""{_INSIDE}, {C.BI}, k AS (SELECT *, row_number() OVER (PARTITION BY reading, pos ORDER BY p_inside DESC, display) AS k FROM i)
        SELECT reading, display, pos FROM k WHERE k = 1 OR display IN (SELECT w1 FROM bi WHERE cnt > {L.KATZ})""",
    "key_lcp_neighbors": f"""WITH {C.UNI}, {_ENTRIES}, k AS (SELECT key, lag(key) OVER (ORDER BY key) AS a, lead(key) OVER (ORDER BY key) AS b FROM (SELECT DISTINCT reading AS key FROM entries)),
        l AS (SELECT key, CAST(greatest(list_max(list_filter(range(0, length(key) + 1), lambda i: left(key, i) = left(coalesce(a, ''), i) AND i <= length(coalesce(a, '')))),
          list_max(list_filter(range(0, length(key) + 1), lambda i: left(key, i) = left(coalesce(b, ''), i) AND i <= length(coalesce(b, ''))))) AS INT) AS shared FROM k)
        SELECT key, shared, left(key, shared + 1) AS prefix, substr(key, shared + 2, 32) AS tail FROM l""",
    "letter_group": f"WITH {C.UNI}, {_ENTRIES} SELECT reading, string_agg(DISTINCT display, '|' ORDER BY display) AS displays, string_agg(DISTINCT pos, '|' ORDER BY pos) AS poses FROM entries GROUP BY reading",
    "lattice_chars": f"WITH {C.UNI}, {_ENTRIES}, {_STRINGS}, t AS (SELECT s, unnest(range(0, length(s))) AS top FROM strings) SELECT s, CAST(top AS INT) AS top, CAST(top + 1 AS INT) AS \"end\", substr(s, top + 1, 1) AS ch FROM t",
    "lattice_edges": f"WITH {C.UNI}, {_ENTRIES}, {_STRINGS}, {_DICT}, {_EDGES} SELECT * FROM edges",
}

"""Queries over word lookup, scores of candidates and predictions, the history's lattice, and character functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import decode as D
from textlattice.operators import history as H
from textlattice.operators import langmodel as L
from textlattice.operators import lattice as A
from textlattice.operators import lexicon as X
from textlattice.plans import counts as C
from textlattice.plans import phrases as P
from textlattice.plans import users as U
from textlattice.sources.files import written
from textlattice.sources.pages import read_documents, read_table

HEADS = ["func", "num"]
CLASSES = [("web", 1), ("books", 2), ("wiki", 3)]
POS_NAMES = [(1, "noun"), (2, "verb"), (3, "mod")]


def _bigrams(spark, d, least):
    return C.words_of(C.grams(spark, d, 2).filter(F.col("cnt") > least), 2)


def _phrases(spark, d):
    """Mined phrases of two words and more with their own counts: gram, w1, cnt."""
    return P.phrase_ranked(spark, d).filter("n > 1").select("gram", F.substring_index("gram", " ", 1).alias("w1"), F.col("disc").alias("cnt"))


def pair_lookup(spark, d):
    """The words of conversations; of odd turns with their display form for a reading, accents or not."""
    words = U._turns(spark, d).select("turn", F.explode("words").alias("display"))
    asked = words.select("display", F.when(F.col("turn") % 2 == 0, T.reading_of("display")).otherwise(F.col("display")).alias("reading")).distinct()
    return D.lookup_pairs(asked, C.lexicon(spark, d))


def _costs(spark, d):
    """Costs of all neighbours in conversations. Words are counted once, and only those of conversations get a cost."""
    uni, pairs = written(C.unigrams(spark, d), "words"), D.neighbours(U._turns(spark, d))
    asked = U._turns(spark, d).select(F.explode("words").alias("display")).distinct()
    lexicon = C.lexicon(spark, d, uni)
    words = L.inside_prob(lexicon.join(asked, "display", "left_semi"), uni, L.pos_unigrams(uni, lexicon)).select(F.col("display").alias("word"), "pos", A.cost(F.col("p_inside"), F.lit(1)).alias("own"))
    stored = _bigrams(spark, d, L.KATZ).join(uni.select("w1", F.col("cnt").alias("total")), "w1").select("w1", "w2", A.cost(F.col("cnt"), F.col("total")).alias("cost"))
    return D.pair_costs(pairs, words, stored, P._links(spark, d))


def pair_cost(spark, d):
    return _costs(spark, d)


def candidate_rank(spark, d):
    """A conversation's turns as candidates."""
    turns = U._turns(spark, d).filter(F.size("words") > 0)
    costs = D.candidate_costs(turns, written(_costs(spark, d), "pair-costs"), ["conv_id", "turn"])
    return D.rank_candidates(costs, "conv_id", "turn")


def predict_ranked(spark, d):
    """Words and phrases that begin with what is asked for, all of them."""
    uni = C.unigrams(spark, d).filter(~F.col("w1").startswith("["))
    total = uni.groupBy(T.pos_of("w1").alias("pos")).agg(F.sum("cnt").alias("total"))
    phrases = _phrases(spark, d).filter(~F.contains("gram", F.lit("[")))
    every = uni.select(F.col("w1").alias("display"), T.pos_of("w1").alias("pos"), "cnt").unionByName(phrases.select(F.col("gram").alias("display"), T.pos_of("w1").alias("pos"), "cnt"))
    items = every.join(F.broadcast(total), "pos").select("display", "pos", A.cost(F.col("cnt"), F.col("total")).alias("own"))  # a row per part of speech
    lengths = P._asked(spark).select(F.length("prefix").alias("n")).distinct()  # a row per length of what is asked for
    begun = items.join(F.broadcast(lengths), F.length("display") >= F.col("n")).withColumn("prefix", F.expr("left(display, n)"))
    return D.rank_predictions(P._asked(spark).join(begun, "prefix"), P._links(spark, d))


def phrase_heads(spark, d):
    return D.filter_phrase_head(_phrases(spark, d), T.pos_of("w1"), HEADS).select("gram", "cnt")


def history_lattice(spark, d):
    """The last two words of each conversation, as one text, over the words of all conversations."""
    turns = U._turns(spark, d)
    last = turns.groupBy("conv_id").agg(F.max_by("words", "turn").alias("w")).select(F.array_join(F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), 2), "").alias("s"))
    words = turns.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    return D.history_edges(last, words)


def _gains(spark, d):
    gain = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return U._events(spark, d).withColumn("g", gain)


def character_weights(spark, d):
    return H.character_weights(_gains(spark, d), "user_id", F.col("event_type"), F.col("g"), 1)


def learned_show(spark, d):
    """A user's kinds of events as candidates, with their share as score."""
    e = _gains(spark, d)
    share = e.groupBy("user_id", F.col("event_type").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    share = share.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("all")), "user_id").select("user_id", "word", F.expr("100 * n div all").alias("score"))
    return H.shown(share, H.reinforced(e, "user_id", ["us", "event_id"], F.col("g")), character_weights(spark, d), "user_id", 1)


def record_format(spark, d):
    pos = F.concat_ws(",", F.lit("*"), "pos", *[F.lit("*")] * 5)
    return C.lexicon(spark, d).select("display", X.format_token("display", "reading", pos).alias("record"))


def class_remap(spark, d):
    classes = spark.createDataFrame(CLASSES, "name string, id int")
    return X.remap_class(read_documents(spark, d).select("doc_id", F.col("source").alias("class_name")), classes)


def pos_names(spark, d):
    names = spark.createDataFrame(POS_NAMES, "pos_id int, name string")
    return X.pos_name(read_table(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("pos_id")), names)


def character_flags(spark, d):
    """Two neighbouring characters of each turn: the last one before the caret, and the next."""
    at = F.col("turn") * 7 + 3
    c = read_table(spark, d, "conversations").select("conv_id", "turn", F.substr("text", at.cast("int"), F.lit(1)).alias("a"), F.substr("text", (at + 1).cast("int"), F.lit(1)).alias("b"))
    return c.select("conv_id", "turn", T.char_type("a").alias("last_type"), T.char_type("b").alias("next_type"), T.need_store("a", "b").alias("store"), T.is_next_word("b").alias("whole_word"))


def spaced_words(spark, d):
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.spaced_words("text")).alias("pos", "w"))
    return rows.select("conv_id", "turn", "pos", "w.word", "w.space_before", "w.space_after")


def map_access(spark, d):
    m = F.create_map(F.col("event_type"), F.col("user_id").cast("string"))
    e = read_table(spark, d, "events").select("event_id", T.map_put(m, "error", F.lit("0")).alias("m"))
    return e.select("event_id", T.map_get("m", "error").alias("error"), T.map_get("m", "purchase").alias("purchase"))


def file_time(spark, d):
    return U._events(spark, d).select("event_id", T.file_timestamp("ts").alias("name"))


QUERIES = {
    f.__name__: f
    for f in (pair_lookup, pair_cost, candidate_rank, predict_ranked, phrase_heads, history_lattice, character_weights, learned_show, record_format, class_remap, pos_names, character_flags, spaced_words, map_access, file_time)
}

_TURNS = U._TURNS
_LINK = f"""lp AS (SELECT CASE w1 WHEN '[BOS]' THEN 'BOS' ELSE {C.pos_sql('w1')} END AS p1, CASE w2 WHEN '[EOS]' THEN 'EOS' ELSE {C.pos_sql('w2')} END AS p2, cnt FROM bi),
  lc AS (SELECT p1, p2, sum(cnt) AS cnt FROM lp GROUP BY p1, p2), links AS (SELECT p1, p2, CAST(round(100 * ln(CAST(sum(cnt) OVER (PARTITION BY p1) AS DOUBLE) / cnt)) AS BIGINT) AS link FROM lc)"""
_NEIGHBOURS = "nb AS (SELECT conv_id, turn, unnest(list_concat([NULL], w)) AS w1, unnest(list_concat(w, [NULL])) AS w2 FROM turns)"
_PAIR = f"""{C.UNI}, {C.BI}, {C.LEX}, {C.POS}, {C.INSIDE}, {_LINK}, {_TURNS}, {_NEIGHBOURS},
  own AS (SELECT display AS word, pos, CAST(round(100 * ln(1.0::DOUBLE / p_inside)) AS BIGINT) AS own FROM inside),
  stored AS (SELECT bi.w1, w2, CAST(round(100 * ln(CAST(uni.cnt AS DOUBLE) / bi.cnt)) AS BIGINT) AS cost FROM bi JOIN uni ON uni.w1 = bi.w1 WHERE bi.cnt > {L.KATZ}),
  pc AS (SELECT n.w1, n.w2, CAST(coalesce(st.cost, coalesce(k.link, {A.NO_LINK}) + CASE WHEN n.w2 IS NULL THEN 0 ELSE coalesce(b.own, {A.UNKNOWN_COST}) END) AS BIGINT) AS cost
    FROM (SELECT DISTINCT w1, w2 FROM nb) n LEFT JOIN own a ON a.word = n.w1 LEFT JOIN own b ON b.word = n.w2
    LEFT JOIN links k ON k.p1 = CASE WHEN n.w1 IS NULL THEN 'BOS' ELSE coalesce(a.pos, 'UNK') END AND k.p2 = CASE WHEN n.w2 IS NULL THEN 'EOS' ELSE coalesce(b.pos, 'UNK') END
    LEFT JOIN stored st ON st.w1 = n.w1 AND st.w2 = n.w2)"""
_GAIN = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"
_CLASS = "CASE WHEN regexp_matches(lower(c), '^[a-z0-9 ]$') THEN lower(c) ELSE '*' END"
_WEIGHTS = f"""cw AS (SELECT user_id, {_CLASS} AS ch, CAST(5 * sum(g) AS BIGINT) AS weight FROM (SELECT user_id, {_GAIN} AS g, unnest(string_split(substr(event_type, 2), '')) AS c FROM events)
  WHERE g <> 0 AND c <> '' GROUP BY ALL)"""


def _type(c: str) -> str:
    return f"CASE WHEN {c} = ' ' THEN 'space' WHEN regexp_matches({c}, '^[A-Za-z]') THEN 'alpha' WHEN regexp_matches({c}, '^[0-9]') THEN 'digit' WHEN regexp_matches({c}, '^[.,!?]') THEN 'punct' WHEN regexp_matches({c}, '^[\\x01-\\x1f]') THEN 'control' ELSE 'other' END"


_RANKED = f"ranked AS (SELECT gram, string_split(gram, ' ')[1] AS w1, disc AS cnt FROM (SELECT * FROM agreed WHERE disc >= 1 AND n > 1 AND n < {P.ORDERS} ORDER BY disc DESC, gram LIMIT {P.CAP}))"

ORACLE = {
    "pair_lookup": f"""WITH {C.UNI}, {C.LEX}, {_TURNS}, a AS (SELECT DISTINCT display, CASE WHEN turn % 2 = 0 THEN translate(display, '{T.ACCENTS}', '{T.PLAIN}') ELSE display END AS reading FROM (SELECT turn, unnest(w) AS display FROM turns))
        SELECT a.display, a.reading, coalesce(pos, 'UNK') AS pos FROM a LEFT JOIN lex ON lex.display = a.display AND lex.reading = a.reading""",
    "pair_cost": f"WITH {_PAIR} SELECT * FROM pc",
    "candidate_rank": f"""WITH {_PAIR}, cc AS (SELECT conv_id, turn, CAST(sum(cost) AS BIGINT) AS cost FROM nb JOIN pc ON pc.w1 IS NOT DISTINCT FROM nb.w1 AND pc.w2 IS NOT DISTINCT FROM nb.w2 WHERE nb.w1 IS NOT NULL OR nb.w2 IS NOT NULL GROUP BY conv_id, turn),
        once AS (SELECT conv_id, cost, min(turn) AS turn FROM cc GROUP BY conv_id, cost) SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY cost, turn) AS INT) AS rank FROM once""",
    "predict_ranked": f"""{P._BOTH}, {_RANKED}, {C.UNI}, {C.BI}, {_LINK}, {P._ASKED}, pt AS (SELECT {C.pos_sql('w1')} AS pos, sum(cnt) AS total FROM uni WHERE NOT starts_with(w1, '[') GROUP BY 1),
        every AS (SELECT w1 AS display, {C.pos_sql('w1')} AS pos, cnt FROM uni WHERE NOT starts_with(w1, '[') UNION ALL SELECT gram, {C.pos_sql('w1')}, cnt FROM ranked WHERE NOT contains(gram, '[')),
        i AS (SELECT prefix, display, CAST(coalesce(link, {A.NO_LINK}) + CAST(round(100 * ln(CAST(total AS DOUBLE) / cnt)) AS BIGINT) AS BIGINT) AS cost FROM every JOIN pt ON pt.pos = every.pos JOIN asked ON starts_with(display, prefix) LEFT JOIN links ON p1 = 'BOS' AND p2 = every.pos)
        SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY cost, display) AS INT) AS rank, display, cost FROM i""",
    "phrase_heads": f"{P._BOTH}, {_RANKED} SELECT gram, cnt FROM ranked WHERE {C.pos_sql('w1')} NOT IN ('func', 'num')",
    "history_lattice": f"""WITH {_TURNS}, last AS (SELECT w FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1), st AS (SELECT DISTINCT array_to_string(w[greatest(len(w) - 1, 1):], '') AS s FROM last WHERE len(w) > 0),
        wd AS (SELECT word, count(*) AS used FROM (SELECT unnest(w) AS word FROM turns) GROUP BY word), tops AS (SELECT s, CAST(unnest(range(0, length(s))) AS INT) AS top FROM st),
        sp AS (SELECT s, top, CAST(top + n AS INT) AS "end", substr(s, top + 1, n) AS word FROM tops, (SELECT DISTINCT CAST(length(word) AS INT) AS n FROM wd) WHERE top + n <= length(s)),
        b AS (SELECT left(word, n) AS begin, count(*) AS n_words, first(word ORDER BY used DESC, word) AS word FROM (SELECT word, used, unnest(range(1, length(word))) AS n FROM wd) GROUP BY 1)
        SELECT s, top, "end", false AS prefix_match, CAST(1 AS BIGINT) AS n_words, word FROM sp JOIN wd USING (word)
        UNION ALL SELECT s, top, CAST(length(s) AS INT), true, n_words, word FROM tops JOIN b ON begin = substr(s, top + 1)""",
    "character_weights": f"WITH {_WEIGHTS} SELECT * FROM cw",
    "learned_show": f"""WITH {_WEIGHTS}, lr AS ({U.ORACLE['reinforce_fold']}), sh AS (SELECT user_id, event_type AS word, 100 * count(*) // sum(count(*)) OVER (PARTITION BY user_id) AS score FROM events GROUP BY user_id, event_type),
        own AS (SELECT x.user_id, x.word, sum(weight) AS own FROM (SELECT user_id, word, {_CLASS} AS ch FROM (SELECT user_id, word, unnest(string_split(substr(word, 2), '')) AS c FROM sh)) x JOIN cw ON cw.user_id = x.user_id AND cw.ch = x.ch GROUP BY ALL)
        SELECT sh.user_id, sh.word, score * bias + 100 * coalesce(own, 0) >= 100 * border AS shown FROM sh JOIN lr USING (user_id) LEFT JOIN own ON own.user_id = sh.user_id AND own.word = sh.word""",
    "record_format": f"WITH {C.UNI}, {C.LEX} SELECT display, display || ',' || pos || ',*,*,*,*,*,*,' || reading || ',' || reading AS record FROM lex",
    "class_remap": f"SELECT doc_id, source AS class_name, CASE source {' '.join(f'''WHEN '{n}' THEN {k}''' for n, k in CLASSES)} ELSE 0 END AS class_id FROM documents",
    "pos_names": f"SELECT event_id, CAST(event_id % 5 AS INT) AS pos_id, CASE event_id % 5 {' '.join(f'''WHEN {k} THEN '{n}' ''' for k, n in POS_NAMES)} ELSE '[UNK]' END AS name FROM events",
    "character_flags": f"""WITH x AS (SELECT conv_id, turn, substr(text, CAST(turn * 7 + 3 AS INT), 1) AS a, substr(text, CAST(turn * 7 + 4 AS INT), 1) AS b FROM conversations), t AS (SELECT conv_id, turn, a, {_type('a')} AS last_type, {_type('b')} AS next_type FROM x)
        SELECT conv_id, turn, last_type, next_type, a <> '' AND (next_type = 'punct' OR (next_type IN ('alpha', 'digit', 'other') AND last_type <> next_type)) AS store, next_type IN ('space', 'punct', 'other') AS whole_word FROM t""",
    "spaced_words": r"""WITH r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^[^ ]*', ''), '(?s)^.*[^ A-Za-z0-9.,!?][^ ]*', '') AS rest FROM conversations),
        e AS (SELECT conv_id, turn, rest, regexp_extract_all(rest, '( ?)([A-Za-z]+|[0-9]+|[.,!?])', 1) AS h, regexp_extract_all(rest, '( ?)([A-Za-z]+|[0-9]+|[.,!?])', 2) AS w FROM r),
        p AS (SELECT conv_id, turn, rest, unnest(range(0, len(w))) AS i, unnest(w) AS word, unnest(h) = ' ' AS before FROM e)
        SELECT conv_id, turn, CAST(i AS INT) AS pos, word, before AS space_before, coalesce(lead(before) OVER (PARTITION BY conv_id, turn ORDER BY i), ends_with(rest, ' ')) AS space_after FROM p""",
    "map_access": "SELECT event_id, '0' AS error, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS purchase FROM events",
    "file_time": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS name FROM events",
}

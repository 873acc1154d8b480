"""Queries against their SQL on small tables with nulls, repeated rows and languages that the test data doesn't have."""

import random

import duckdb
import pytest

import __spark_entry__

NAMES = [
    "word_marginal_entropy", "topic_top_words", "mixunigram_estep_once", "plsa_step_once", "topic_merge", "mixture_round_once", "topic_prior_words",
    "phrase_discount_fwd", "phrase_reconciled", "phrase_ranked", "predict_ranked", "history_phrase_predict", "stream_ngram_flush", "stream_user_history",
    "reinforce_fold", "key_repeat", "modifier_state",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    top = tmp_path_factory.mktemp("tables")
    words = [f"{a}{b}" for a in ("the", "ba", "lo", "mi", "é", "x9") for b in ("", "ra", "ne", "tion", "ing")]

    def text(n):
        return " ".join(words[min(int(r.expovariate(0.15)), len(words) - 1)] for _ in range(n))

    docs = [(k, text(r.randrange(0, 60)), r.choice(("en", "fr", "it", None)), r.choice(("a", "b", None)), 0) for k in range(80)]
    docs += [(None, "the bara the bara", None, None, 0), (90, None, "en", "a", 0), (91, "", "it", "a", 0), docs[3], docs[3]]
    turns = [(k % 7, k // 7, "user", text(r.randrange(0, 9))) for k in range(42)] + [(8, 0, None, None), (8, 1, "user", "the the"), (8, 1, "user", "the the")]
    events = [(k, 1_700_000_000_000_000 + 1_000_000 * r.randrange(0, 9000), r.choice((1, 1, 1, 2, None)), r.choice(("purchase", "error", "signup", "view")), 1.0, '{"k": 1}') for k in range(400)]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
        "events": spark.createDataFrame(events, "event_id long, us long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp_micros(us) AS ts", "user_id", "event_type", "value", "props"),
    }
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, df in frames.items():
        df.coalesce(2).write.parquet(f"{top}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{top}/{name}.parquet/*.parquet')")
    return str(top), con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    top, con = tables
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in want.description]
    df = __spark_entry__.queries()[name](spark, top)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in names]).collect()))) == sorted(map(repr, want.fetchall()))

"""Topic training against plain loops, and character functions on hand-made cases."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.operators import decode, lexicon, topics

TOPICS = 3


def _documents():
    r = random.Random(4)
    sets = ["abcde", "fghij", "klmno"]
    return {d: [r.choice(sets[d % 3] if r.random() < 0.9 else "".join(sets)) for _ in range(r.randrange(5, 40))] for d in range(30)}


@pytest.fixture(scope="module")
def tf(spark):
    rows = [(d, w) for d, words in _documents().items() for w in words]
    return spark.createDataFrame(rows, "doc int, word string").groupBy("doc", "word").agg(F.count("*").alias("tf"))


def _scaled(model):
    sums = [sum(p[k] for p in model.values()) for k in range(TOPICS)]
    return {w: [p[k] / sums[k] for k in range(TOPICS)] for w, p in model.items()}


def _round(docs, model, own, keep=0.5):
    """A round of either model by plain loops over word positions; own: topics of documents, None for the mixture."""
    new, ll, n, after = {w: [0.0] * TOPICS for w in model}, 0.0, 0, {}
    for d, words in docs.items():
        if own is None:
            logs = [sum(math.log(model[w][k]) for w in words) for k in range(TOPICS)]
            whole = math.log(sum(math.exp(x) for x in logs))
            q, ll = [math.exp(x - whole) for x in logs], ll + whole
        else:
            q = [0.0] * TOPICS
            for w in words:
                xs = [own[d][k] * model[w][k] for k in range(TOPICS)]
                ll += math.log(sum(xs))
                q = [a + x / sum(xs) for a, x in zip(q, xs, strict=True)]
        n += len(words)
        after[d] = [x / sum(q) for x in q]
        for w in words:
            new[w] = [a + x for a, x in zip(new[w], q, strict=True)]
    new = _scaled(new)
    return _scaled({w: [a * keep + b * (1 - keep) for a, b in zip(model[w], new[w], strict=True)] for w in model}), math.exp(-ll / n), after


@pytest.mark.parametrize("mixture", [True, False])
def test_training_against_plain_loops(spark, tf, mixture):
    docs = _documents()
    start = {r["word"]: list(r["ps"]) for r in topics.prepared(None, tf, TOPICS).collect()}
    own = None
    if not mixture:
        own = {}
        for d, words in docs.items():
            sums = [sum(start[w][k] / sum(start[w]) for w in words) for k in range(TOPICS)]
            own[d] = [x / sum(sums) for x in sums]
    model, seen = start, []
    while True:
        model, value, after = _round(docs, model, own)
        own = own if mixture else after
        if topics.settled(seen, value):
            break
        seen.append(value)
    got, prior, values = topics.trained(tf, "doc", TOPICS, mixture=mixture)
    assert values == pytest.approx(seen, rel=1e-6)
    assert {r["word"]: list(r["ps"]) for r in got.collect()} == {w: pytest.approx(p, rel=1e-6) for w, p in model.items()}
    assert prior == pytest.approx([(1 / TOPICS + sum(q[k] for q in after.values()) / len(docs)) / 2 for k in range(TOPICS)], rel=1e-6)


def test_training_goes_on_from_a_model(spark, tf):
    old = topics.prepared(None, spark.createDataFrame([("a",), ("zz",)], "word string"), TOPICS)
    got, _, values = topics.trained(tf, "doc", TOPICS, old, [0.2, 0.3, 0.5], most=1)
    rows = {r["word"]: r["ps"] for r in got.collect()}
    assert {"a", "zz", "f"} <= rows.keys() and len(values) == 1
    assert [sum(p[k] for p in rows.values()) for k in range(TOPICS)] == pytest.approx([1.0] * TOPICS)
    same, prior, none = topics.trained(tf.filter("false"), "doc", TOPICS, old, [0.2, 0.3, 0.5])
    assert same is old and prior == [0.2, 0.3, 0.5] and none == []


def test_topic_tables(spark, tmp_path):
    model = topics.prepared(None, spark.createDataFrame([("a",), ("b",)], "word string"), 2)
    topics.save_topics(topics.long_form(model, ["x", "y"]), str(tmp_path / "m"))
    back = topics.load_topics(spark.read.parquet(str(tmp_path / "m")), ["x", "y"])
    assert {r["word"]: pytest.approx(r["ps"]) for r in back.collect()} == {r["word"]: r["ps"] for r in model.collect()}
    more = topics.load_topics(spark.read.parquet(str(tmp_path / "m")), ["x", "y", "z"]).collect()
    assert all(len(r["ps"]) == 3 and min(r["ps"]) > 0 for r in more)


def test_settled_and_snapshots():
    assert not topics.settled([], 5.0) and topics.settled([9.0, 5.1, 5.2, 5.0, 4.9, 5.0], 5.0) and not topics.settled([9.0, 5.0], 5.0)
    assert topics.snapshot_due(8, 8, True) == (False, True) and topics.snapshot_due(8, 9, True) == (True, True)
    assert topics.snapshot_due(8, 14, True) == (True, False) and topics.snapshot_due(20, 2, False) == (True, False) and topics.snapshot_due(8, 9, False) == (False, False)


def test_character_types(spark):
    cases = [("", "a", False), ("a", "b", False), ("a", " ", False), ("a", ".", True), (" ", "b", True), ("1", "a", True), ("a", "\n", False), ("a", "か", True), ("か", "-", False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select("a", "b", T.need_store("a", "b").alias("s")).collect()
    assert [tuple(r) for r in rows] == cases
    kinds = spark.createDataFrame([(c,) for c in " xX7,-\t"], "c string").select(T.char_type("c").alias("t"), T.is_next_word("c").alias("n")).collect()
    assert [r["t"] for r in kinds] == ["space", "alpha", "alpha", "digit", "punct", "other", "control"]
    assert [r["n"] for r in kinds] == [True, False, False, False, True, True, False]


@pytest.mark.parametrize(
    ("text", "words"),
    [("", []), ("cut", []), ("cut it now", [("it", True, True), ("now", True, False)]), ("x a1, b ", [("a", True, False), ("1", False, False), (",", False, True), ("b", True, True)]),
     ("x one tw-o three", [("three", True, False)]), ("x one tw-o", []), ("x  two", [("two", True, False)])],
)
def test_spaced_words(spark, text, words):
    assert [tuple(w) for w in spark.range(1).select(T.spaced_words(F.lit(text)).alias("w")).first()["w"]] == words


def test_many_spaced_words_of_one_text(spark):
    rows = spark.createDataFrame([("x " + "ab 1, " * 4000,), (None,)], "t string").select(T.spaced_words("t").alias("w"))
    began = time.time()
    some, none = (r["w"] for r in rows.collect())
    assert none is None and len(some) == 12000 and tuple(some[0]) == ("ab", True, True) and tuple(some[-1]) == (",", False, True)
    assert time.time() - began < 25  # not a search of the text for each word


def test_numbers(spark):
    r = spark.createDataFrame([(0.0, -2.0), (-1.0, -2.0), (-900.0, -1.0)], "a double, b double").select(T.log_add("a", "b").alias("s")).collect()
    assert [x["s"] for x in r] == pytest.approx([-2.0, math.log(math.exp(-1) + math.exp(-2)), -1.0])
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("inf"),)], "a double").select(T.finite("a")).collect()


def test_records_and_names(spark):
    r = spark.createDataFrame([("は", "ハ", "ハ,助詞,係助詞,*,*,*,*"), ("x", "x", "[BOS]")], "d string, r string, p string")
    text = [x["t"] for x in r.select(lexicon.format_token("d", "r", "p").alias("t")).collect()]
    assert text == ["は,助詞,係助詞,*,*,*,*,*,ハ,ハ", "[BOS]"]
    back = spark.createDataFrame([(text[0],)], "r string").select(lexicon.parse_token("r").alias("t")).select(lexicon.normalize_pos("t").alias("p")).first()
    assert back["p"] == "ハ,助詞,係助詞,*,*,*,*"


def test_candidates_of_equal_cost(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 3, 2), (1, 5, 0), (2, 5, 7)], "k int, cost long, turn int")
    once = sorted(map(tuple, decode.rank_candidates(rows, "k", "turn").select("k", "rank", "cost", "turn").collect()))
    assert once == [(1, 1, 3, 2), (1, 2, 5, 0), (2, 1, 5, 7)]
    assert decode.rank_candidates(rows, "k", "turn", collapse=False).count() == 4


def test_history_edges(spark):
    words = spark.createDataFrame([("ab", 3), ("abc", 1), ("abd", 2), ("b", 1), ("bx", 9)], "word string, used long")
    got = sorted(tuple(r) for r in decode.history_edges(spark.createDataFrame([("ab",), ("",)], "s string"), words).collect())
    assert got == [("ab", 0, 2, False, 1, "ab"), ("ab", 0, 2, True, 2, "abd"), ("ab", 1, 2, False, 1, "b"), ("ab", 1, 2, True, 1, "bx")]
    assert {r["top"] for r in decode.history_edges(spark.createDataFrame([("ab",)], "s string"), words, latin=True).collect()} == {0}

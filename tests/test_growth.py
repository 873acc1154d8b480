"""What a step shuffles or hands on, and that cheaper forms have the results of the plain ones."""

import random
import re
import time

import pyarrow as pa
import pytest

from textlattice.functions import text as T
from textlattice.operators import history, mining, ngrams, phrases, predict, sorted_runs
from textlattice.plans import counts
from textlattice.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_break_by_letters_is_the_class_by_ranges():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000)]))
    assert re.findall(T._BREAK, every) == re.findall(T.TOKEN_BREAK, every)
    assert "-" not in T._BREAK  # no ranges


def test_a_lone_run_is_one_row_of_the_walk():
    walk = mining.Walk(7, True)
    for run in ("a b c d e f g", "a x c d e f g", "b"):
        walk.add(run)
    walk.close(0)
    assert len(walk.rows) == 4
    assert walk.rows[0] == (7, "a b c d e f g", 1, 1, None, 2)


def test_texts_are_split_once_for_runs(spark):
    docs = spark.createDataFrame([("b a",), (None,), ("",)], "text string")
    runs = mining.runs(ngrams.sentences_of(docs), 3, backward=True)
    assert plan(runs).count("split(") == 1
    assert sorted(x["gram"] for x in runs.collect()) == sorted(["[EOS] a b", "a b [BOS]", "b [BOS]", "[BOS]", "[EOS] [BOS]", "[BOS]"])


def test_parts_of_speech_are_counted_without_joins(spark, smoke):
    for n, df in ((2, counts.pos_bigram(spark, smoke)), (3, counts.pos_trigram(spark, smoke))):
        assert "Join" not in plan(df)
        rows = counts.words_of(counts.grams(spark, smoke, n), n)
        want = rows.groupBy(*[T.pos_of(f"w{k}").alias(f"p{k}") for k in range(1, n + 1)]).sum("cnt")
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_out_of_vocabulary_without_a_row_per_word(spark):
    grams = spark.createDataFrame([("a b a", 3), ("a c b", 2), ("c a a", 1), ("b b b", 1)], "gram string, cnt long")
    vocab = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    out = ngrams.drop_oov(grams, vocab, 3)
    assert sorted(map(tuple, out.collect())) == [("a b a", 3), ("b b b", 1)]
    assert "explode" not in plan(out)


def test_unseen_words_come_from_counts(spark, smoke):
    df = counts.lexicon(spark, smoke)
    seen = {x["w1"] for x in counts.unigrams(spark, smoke).collect()}
    assert {x["display"] for x in df.collect()} == seen | {"zz" + w for w in seen if not w.startswith("[")}


def both_walks(rows, every, below):
    stack = mining.Walk(5, every, below=below)
    for x in rows:
        stack.add(x)
    stack.close(0)
    texts, found = pa.array(rows), []
    for b in mining._at_once(texts, sorted_runs.shared_words(sorted_runs.of(texts)), 5, every, below, mining.TOP):
        found += [(x["n"], x["gram"], x["cnt"], x["disc"], x["entries"] and sorted(map(tuple, map(dict.values, x["entries"]))), x["least"]) for x in b.to_pylist()]
    return found, [(*x[:4], x[4] and sorted(x[4]), x[5]) for x in stack.rows]


@pytest.mark.parametrize(("every", "below"), [(True, 5), (False, 5), (False, 6)])
def test_runs_at_once_are_walked_as_one_by_one(every, below):
    for seed in range(60):
        r = random.Random(seed)
        words = ["a", "ab", "b", "é", "zürich", "longerword", "abc", "[EOS]"][: r.randrange(2, 9)]
        rows = sorted((" ".join(r.choice(words) for _ in range(r.choice((r.randrange(1, 6), 5)))) for _ in range(r.randrange(1, 150))), key=str.encode)
        found, want = both_walks(rows, every, below)
        assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_runs_in_pieces_and_through_the_stack(spark, monkeypatch):
    r = random.Random(5)
    rows = [" ".join(r.choice("aab c d ef".split()) for _ in range(r.randrange(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in rows], "gram string")
    want = sorted(map(repr, mining.discounted(df, 5).collect()))
    monkeypatch.setattr(mining, "AT_ONCE", 50)
    assert sorted(map(repr, mining.discounted(df, 5).collect())) == want
    monkeypatch.setattr(mining, "TOO_MANY", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert sorted(map(repr, mining.discounted(df, 5).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_grams_with_a_count_meet_in_the_other_direction(spark):
    ahead = spark.createDataFrame([(2, "a b", 3, 3), (2, "a c", 2, None), (2, "c d", 2, 0), (2, "x y", 1, 1)], "n int, gram string, cnt long, disc long")
    back = spark.createDataFrame([(2, "b a", 3, 2), (2, "c a", 2, 2), (2, "d c", 2, 1), (2, "y x", 1, None)], "n int, gram string, cnt long, disc long")
    out = phrases.reconciled(ahead, back)
    assert sorted(map(tuple, out.collect())) == [(2, "a b", 3, 2), (2, "a c", 2, 0), (2, "c d", 2, 0), (2, "x y", 1, 0)]
    joined = plan(out).split("Join", 1)[1]
    assert joined.count("disc") and "> 0" in joined


def turns_of(spark, r, n):
    rows = [([r.choice(["a", "ab", "b", "é", "c", "d"][: 1 + k % 6]) for _ in range(r.randrange(0, 12))], k) for k in range(n)]
    return spark.createDataFrame([*rows, (None, 0), ([], 1)], "words array<string>, at long")


def test_shares_without_a_row_for_each_gram(spark, monkeypatch):
    turns = turns_of(spark, random.Random(3), 60)
    want = sorted(map(repr, history.conditional(history.register_all(turns)).select("gram", "prefix", "word", "used", "p").collect()))
    assert sorted(map(repr, history.conditional_of(turns).collect())) == want
    monkeypatch.setattr(history, "AT_ONCE", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert sorted(map(repr, history.conditional_of(turns).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = spark.createDataFrame([("a b",), ("a ab b",), ("[BOS] a",), ("zz top",), ("a b a b a b",)], "prefix string")
    short = [x for x in want if "prefix=''" in x or " " not in x.split("prefix='")[1].split("'")[0]]
    some = [x for x in want if x.split("prefix='")[1].split("'")[0] in {"a b", "a ab b", "[BOS] a", "a b a b a b"}]
    assert sorted(map(repr, history.conditional_of(turns, 7, asked).collect())) == sorted(short + some)


def test_predictions_from_what_is_asked_for(spark):
    turns = turns_of(spark, random.Random(4), 50).filter("words is not null")
    asked = turns.select(turns["at"].alias("id"), "words").dropDuplicates(["id"])
    want = history.predict(asked, history.conditional(history.register_all(turns)))
    assert sorted(map(repr, history.predict_of(asked, turns).collect())) == sorted(map(repr, want.collect()))


def test_only_children_of_grams_that_states_are_at(spark):
    kids = spark.createDataFrame([("", "a", 2, 3), ("a", "b", 1, 1), ("a b", "c", 1, 1), ("x", "y", 1, 1)], "parent string, word string, used long, total long")
    states = spark.createDataFrame([("a",), ("a b",), ("",)], "node string")
    assert sorted(x["parent"] for x in predict._near(kids, states, 0).collect()) == ["", "a", "a b"]
    assert sorted(x["parent"] for x in predict._near(kids, states, 1).collect()) == ["a", "a b"]


def test_a_tree_counted_in_passing(spark):
    turns = turns_of(spark, random.Random(6), 40)
    want = predict.children(history.register_all(turns).filter("not contains(gram, '[EOS]')"))
    found = history.counted_of(turns, end=False).selectExpr("prefix AS parent", "word", "used", "total")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_the_longest_grams_need_no_other_direction(spark):
    ahead = spark.createDataFrame([(3, "a b c", 3, 3), (2, "a b", 3, 2), (2, "b c", 3, 0), (1, "a", 4, 1)], "n int, gram string, cnt long, disc long")
    back = spark.createDataFrame([(2, "b a", 3, 1), (1, "a", 4, 4)], "n int, gram string, cnt long, disc long")
    for parts in (1, 3):
        out = phrases.reconciled(ahead, back, 3, parts)
        assert sorted(map(tuple, out.collect())) == [(1, "a", 4, 1), (2, "a b", 3, 1), (2, "b c", 3, 0), (3, "a b c", 3, 3)]
        assert sorted(map(tuple, phrases.agreed(ahead, back, 3, parts).collect())) == [(1, "a", 4, 1), (2, "a b", 3, 1)]


@pytest.mark.parametrize("backward", [False, True])
def test_mining_in_parts(spark, monkeypatch, backward):
    r = random.Random(9)
    docs = [([r.choice("a b c d é ef [EOS]".split()) for _ in range(r.randrange(0, 15))],) for _ in range(120)]
    sentences = spark.createDataFrame([*docs, (None,)], "words array<string>")
    runs = mining.runs(sentences, 5, backward)
    texts = mining.texts(sentences)
    monkeypatch.setattr(mining, "LETTERS", 40)
    monkeypatch.setattr(sorted_runs, "AT_ONCE", 4)
    found = [[x["gram"] for x in mining.runs_of(texts, 5, backward, k, 3).collect()] for k in range(3)]
    assert sorted(sum(found, [])) == sorted(x["gram"] for x in runs.collect())
    pairs = [{tuple(g.split(" ")[:2]) for g in part} for part in found]
    assert all(pairs) and not any(pairs[a] & pairs[b] for a in range(3) for b in range(a))
    for every in (True, False):
        want = sorted(map(repr, mining.discounted(runs, 5, every).collect()))
        assert sorted(map(repr, mining.mined(texts, 5, backward, every, parts=3).collect())) == want


def test_a_written_part_leaves_no_shuffle(spark):
    def shuffles():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString().count("shuffle_")

    spark.range(100).repartition(3, "id").write.format("noop").mode("overwrite").save()
    before = shuffles()
    assert before
    parts = (spark.range(50 * k).repartition(5, "id") for k in (1, 2))
    out = files.written_parts(parts, "parts")
    until = time.time() + 20  # they go in the background
    while shuffles() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() <= before
    assert out.count() == 150
    assert spark.conf.get(files._RELEASE, None) in (None, "false")


def test_grams_with_a_count_are_read_without_the_others(spark):
    texts = mining.texts(spark.createDataFrame([("a b a c".split(),), ("a b x".split(),)], "words array<string>"))
    some = mining.mined(texts, 3)
    assert "sequence(" in plan(some) and "sequence(" not in plan(some.filter("coalesce(disc, 0) > 0"))


def test_children_are_not_joined_to_be_found_near(spark):
    kids = spark.createDataFrame([(f"a{k}", "b", 1, 1) for k in range(3000)] + [("", "a", 1, 1)], "parent string, word string, used long, total long")
    states = spark.createDataFrame([("a7",), ("a7",), ("a19",)], "node string")
    near = predict._near(kids, states, 1)
    assert "LeftSemi" not in plan(near) and "broadcast" in plan(near)
    assert {"a7", "a19"} <= {x["parent"] for x in near.collect()} and near.count() < 5


def test_known_grams_in_parts(spark):
    r = random.Random(12)
    sentences = spark.createDataFrame([([r.choice("abcdef") for _ in range(r.randrange(0, 9))],) for _ in range(80)], "words array<string>")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "word string")
    want = sorted(map(tuple, ngrams.drop_oov(ngrams.count_ngrams(sentences, 3), vocab, 3).collect()))
    for parts in (1, 3):
        found = ngrams.count_known(sentences, vocab, 3, parts)
        assert "Join" not in plan(found) and "Aggregate" not in plan(found)  # counted, joined and written
        assert sorted(map(tuple, found.collect())) == want

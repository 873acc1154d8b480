"""Operators that SQL doesn't check: hand-made cases, round trips, and brute force."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textlattice.functions import literal
from textlattice.functions import text as T
from textlattice.operators import history, lattice, lexicon, mining, ngrams, phrases, quantise
from textlattice.plans import phrases as plans
from textlattice.sources import files


@pytest.mark.parametrize(("romaji", "kana"), [("kanji", "かんじ"), ("gakkou", "がっこう"), ("kyouto", "きょうと"), ("ka1", "か1"), ("shi", "し"), ("tesutx", "てすtx"), ("", "")])
def test_romaji(romaji, kana):
    assert literal.romaji_to_kana(romaji) == kana


@pytest.mark.parametrize("value", sorted({v for k in range(33) for v in (2**k - 1, 2**k) if v < 2**32}))
def test_varint_round_trip(value):
    data = literal.put_varint(value)
    assert literal.get_varint(data + b"rest") == (value, len(data))
    bits = max(1, value.bit_length())
    assert len(data) == next(n for n, most in enumerate((7, 13, 19, 25, 32), 1) if bits <= most)


@pytest.mark.parametrize(("value", "data"), [(0x7F, "7f"), (0x80, "8180"), (0x1FFF, "bfff"), (0x2000, "c0c080"), (0x1FFFFFF, "efffffff"), (0x2000000, "f090808080"), (0xFFFFFFFF, "ffffffffff")])
def test_varint_bytes(value, data):
    assert literal.put_varint(value).hex() == data


@pytest.mark.parametrize("node", [0, -1, 2**31 - 1, (1, b"x"), [], [1, (2, [3, b""]), b"\0" * 9000], [[k] for k in range(10)]])
def test_tree_round_trip(node):
    data = literal.put_tree(node)
    assert literal.get_tree(data) == (node, len(data)) and literal.get_tree(b"zz" + data, 2)[0] == node


def test_incomplete_bytes_are_refused():
    for data in (b"\x81", b"\x81\x01", literal.put_tree(b"abc")[:-1]):
        with pytest.raises(ValueError, match="complete"):
            literal.get_varint(data) if data[0] > 3 else literal.get_tree(data)


def test_trees_as_columns(spark):
    rows = [(["ab", "", "か"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "w array<string>").select("w", literal.tree(F.col("w")).alias("b"))
    assert [r["w"] == r["t"] for r in df.select("w", literal.tree_texts(F.col("b")).alias("t")).collect()] == [True] * 3


def test_kana_cycles(spark):
    cases = [("か", "き"), ("xお", "xあ"), ("ー", "わ"), ("?", "、"), ("a", "a"), ("", "")]
    df = spark.createDataFrame(cases, "a string, b string")
    got = df.select("b", literal.cycle_last(F.col("a")).alias("on"), literal.cycle_last(literal.cycle_last(F.col("a")), back=True).alias("same"), "a").collect()
    assert all(r["on"] == r["b"] and r["same"] == r["a"] for r in got)
    one = spark.createDataFrame([("は",)], "a string")
    turns = [literal.cycle_last(F.col("a"), literal.VARIANTS), literal.tapped(F.col("a"), F.lit("は"), F.lit(True)), literal.tapped(F.col("a"), F.lit("は"), F.lit(False)), literal.tapped(F.lit("z"), F.lit("は"), F.lit(True))]
    assert tuple(one.select(*turns).first()) == ("ば", "ひ", "はは", "zは")


def test_literal_functions_as_columns(spark):
    row = spark.createDataFrame([("kana", 300), (None, 1)], "s string, v long").select(literal.to_kana(F.col("s")).alias("k"), literal.words_of(F.lit("it's a-b, c")).alias("w"), literal.varint(F.col("v")).alias("b")).collect()
    assert [r["k"] for r in row] == ["かな", None] and row[0]["w"] == ["it's", "a-b", ",", "c"] and len(row[0]["b"]) == 2


def test_folds(spark):
    r = spark.range(1).select(T.kata_to_hira(F.lit("カタカナabc")).alias("a"), T.to_fullwidth(F.lit("A1 z")).alias("b"), T.replace_nbsp(F.lit("a&nbsp;b")).alias("c")).first()
    assert tuple(r) == ("かたかなabc", "Ａ１　ｚ", "a　b")


def test_token_records(spark):
    rows = ["東京,名詞,固有名詞,地域,一般,*,*,東京,トウキョウ,トーキョー", "は,助詞,係助詞,*,*,*,*,は,ハ,ワ", "short,x", "[BOS]", "行く,動詞,自立,*,*,a,b,x,y,z,行く,イク,イク"]
    t = spark.createDataFrame([(r,) for r in rows], "r string").select(lexicon.parse_token("r").alias("t")).select("t", lexicon.normalize_pos("t").alias("p")).collect()
    assert [None if r["t"] is None else r["t"]["display"] for r in t] == ["東京", "は", None, "[BOS]", "行く"]
    assert t[0]["p"].startswith("*,名詞") and t[1]["p"].startswith("ハ,助詞") and t[4]["t"]["reading"] == "イク"


def test_discount_against_plain_recursion(spark):
    r = random.Random(3)
    texts = [[r.choice("abcdefgh") for _ in range(r.randrange(1, 40))] for _ in range(60)]
    counts = defaultdict(int)
    for t in texts:
        for n in range(1, 5):
            for k in range(len(t) - n + 1):
                counts[tuple(t[k : k + n])] += 1
    disc = {}

    def lists(node):
        top = [e for c in {g[: len(node) + 1] for g in counts if len(g) > len(node) and g[: len(node)] == node} for e in lists(c)]
        top = sorted(top, key=lambda e: (-e[0], " ".join(e[1])))[:5]
        rest = counts[node] - sum(e[0] for e in top)
        if rest > 0 and len(top) < 5:
            disc[node] = rest
            return [*top, (rest, node)]
        if rest > 0 and top[-1][0] < rest:
            disc[node] = rest + top[-1][0]
            return [*top[:4], (disc[node], node)]
        return top

    for w in "abcdefgh":
        lists((w,))
    runs = mining.runs(spark.createDataFrame([(t,) for t in texts], "words array<string>"), 4)
    got = {tuple(x["gram"].split(" ")): (x["n"], x["cnt"], x["disc"]) for x in mining.discounted(runs, 4).collect()}
    assert got == {g: (len(g), counts[g], disc.get(g)) for g in counts}
    some = {tuple(x["gram"].split(" ")): x["disc"] for x in mining.discounted(runs, 4, every=False).collect()}
    assert some == {g: d for g, d in disc.items() if len(g) < 4}
    back = mining.runs(spark.createDataFrame([(t[::-1],) for t in texts], "words array<string>"), 4, backward=True)
    assert {tuple(x["gram"].split(" ")): x["disc"] for x in mining.discounted(back, 4, every=False).collect()} == some


def test_viterbi_against_enumeration(spark):
    r = random.Random(8)
    entries = [("".join(r.choice("ab") for _ in range(n)), p, r.randrange(50, 900)) for n in (1, 2, 3) for p in "XYZ" for _ in range(2)]
    entries = [(a, p, c) for (a, p), c in {(a, p): c for a, p, c in entries}.items()]
    links = {(a, b): r.randrange(0, 500) for a in ("BOS", "X", "Y") for b in ("X", "Y", "Z", "EOS")}
    strings = ["".join(r.choice("abc") for _ in range(n)) for n in range(1, 7) for _ in range(4)]
    s = spark.createDataFrame([(x,) for x in sorted(set(strings))], "s string")
    e = spark.createDataFrame(entries, "reading string, pos string, cost long")
    link = spark.createDataFrame([(*k, v) for k, v in links.items()], "p1 string, p2 string, link long")
    arcs = lattice.with_unknown(lattice.edges(s, e), s)
    for k in (1, 3):
        best = {(r["s"], r["rank"], r["cost"], r["path"]) for r in lattice.best_paths(arcs, link, k).collect()}
        every = {(r["s"], r["rank"], r["cost"], r["path"]) for r in lattice.enumerate_paths(arcs, link, 6, k).collect()}
        assert best == every and {b[0] for b in best} == set(strings)


def test_predictions_with_the_longest_context_first(spark):
    probabilities = spark.createDataFrame([("", "go", 0.5), ("", "gone", 0.3), ("", "up", 0.2), ("b", "gone", 0.6), ("b", "up", 0.4), ("a b", "up", 1.0)], "prefix string, word string, p double")
    contexts = spark.createDataFrame([(1, ["a", "b"], ""), (2, ["a", "b"], "g"), (3, [], "g"), (4, [], ""), (5, ["x"], "u")], "id int, words array<string>, typed string")
    got = sorted(map(tuple, history.predict(contexts, probabilities).collect()))
    assert got == [(1, 1, "up", 2, 1.0), (1, 2, "gone", 1, 0.6), (2, 1, "gone", 1, 0.6), (2, 2, "go", 0, 0.5), (3, 1, "go", 0, 0.5), (3, 2, "gone", 0, 0.3), (5, 1, "up", 0, 0.2)]
    few = history.predict(contexts.drop("typed"), probabilities, longest=1, k=1)
    assert sorted(map(tuple, few.collect())) == [(1, 1, "gone", 1, 0.6), (2, 1, "gone", 1, 0.6)]


def test_files_round_trip(spark, tmp_path):
    grams = spark.createDataFrame([(1, "a", 9), (1, "b", 1), (2, "a b", 4)], "n int, gram string, cnt long")
    files.write_ngrams(grams, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_ngrams(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, grams.collect()))
    assert sorted(map(tuple, files.read_ngrams(spark, str(tmp_path / "g"), divide=2).collect())) == [(1, "a", 4), (2, "a b", 2)]
    for k in range(4):
        files.replace_table(spark.range(k + 1), str(tmp_path / "t"))
    assert [files.current_table(spark, str(tmp_path / "t"), k).count() for k in range(3)] == [4, 3, 2]
    assert files.table_generations(spark, str(tmp_path / "t")) == [2, 3, 4] and files.table_generations(spark, str(tmp_path / "none")) == []


def test_settings():
    got = files.parse_settings("﻿[a]\nx = 1 ; note\nlong = one\\\n  two\\\n  three\n", "[a]\nx=2\n[b]\ny = 0.5")
    assert got == {"a": {"x": "2", "long": "onetwothree"}, "b": {"y": "0.5"}}


def test_quantiser(spark):
    df = spark.range(1, 2000).select((F.col("id") / 2000).alias("p"))
    centres = quantise.fit(df, "p", clusters=16)
    assert len(centres) == 16 and all(a < b for a, b in itertools.pairwise(centres))
    idx = [r["i"] for r in df.orderBy("p").select(quantise.index_of(F.col("p"), centres).alias("i")).collect()]
    assert idx == sorted(idx) and {*idx} == {*range(1, 17)}


def test_count_all_is_all_orders(spark):
    s = spark.createDataFrame([(["a", "b", "a"],), ([],)], "words array<string>")
    got = sorted(map(tuple, ngrams.count_all(s, 3).collect()))
    assert got == [(1, "a", 2), (1, "b", 1), (2, "a b", 1), (2, "b a", 1), (3, "a b a", 1)]


def test_viterbi_knows_rare_and_long_words(spark, tmp_path):
    rows = [(1, "wonderful extraordinary ab", "en", "a", 26), (2, "wonderful ab ab", "en", "a", 15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    paths = {r["s"]: r["path"] for r in plans.viterbi_best(spark, str(tmp_path)).collect()}
    assert {s: p.split("/")[0] for s, p in paths.items()} == {s: s for s in ("wonderful", "extraordinary", "ab")}

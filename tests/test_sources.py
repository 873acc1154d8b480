"""Sources, settings, symbols, edits of typed text and the streams' states."""

import pytest
from pyspark.sql import functions as F

from textlattice import streaming
from textlattice.functions import literal
from textlattice.operators import history, ngrams, topics
from textlattice.sources import files, symbols


def test_read_lexicon(spark, tmp_path):
    for name, rows in (("a", ["東京,名詞,固有名詞,地域,一般,*,*,東京,トウキョウ,トーキョー", "short,x"]), ("b", ["は,助詞,係助詞,*,*,*,*,は,ハ,ワ"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(rows), encoding="utf-8")
    got = sorted(map(tuple, files.read_lexicon(spark, str(tmp_path)).collect()))
    assert got == [("は", "ハ", "ハ,助詞,係助詞,*,*,*,*"), ("東京", "トウキョウ", "*,名詞,固有名詞,地域,一般,*,*")]


def test_typed_settings_and_paths():
    s = files.parse_settings("[a]\nn = 7\nr = 0.5\nyes = true\nbad = x")
    assert [files.setting(s, "a", k, d) for k, d in (("n", 1), ("r", 1.0), ("yes", False), ("bad", 3), ("none", "d"))] == [7, 0.5, True, 3, "d"]
    assert files.expand_path("%Bin%/x%Bin%", {"Bin": "/b", "User": "/u"}) == "/b/x%Bin%" and files.expand_path("%User%/x", {"Bin": "/b", "User": "/u"}) == "/u/x"


@pytest.mark.parametrize("text", ["kanji", "gakkou", "ka1", "tesutx", "", "xKYOUn'kk"])
def test_edits_give_the_conversion(text):
    out = text
    for start, size, kana in literal.edits_before_caret(text):
        out = out[:start] + kana + out[start + size :]
    assert out == literal.romaji_to_kana(text)


def test_edits_as_column(spark):
    rows = spark.createDataFrame([("kka",), (None,)], "s string").select(literal.romaji_edits(F.col("s")).alias("e")).collect()
    assert [tuple(e) for e in rows[0]["e"]] == [(1, 2, "か"), (0, 1, "っ")] and rows[1]["e"] is None


def test_symbols(spark):
    rows = symbols.symbols(spark).collect()
    assert len({r["category"] for r in rows}) == 15
    arrows = [r["text"] for r in sorted(symbols.symbols(spark, "arrows").collect(), key=lambda r: r["rank"])]
    assert arrows[:2] == ["←", "↑"] and len(arrows) == 112
    stream = [0x1F1EF, 0x1F1F5, 0, 0x41, 0, 0, 0x42, 0]
    r = spark.range(1).select(symbols.split_stream(F.lit(stream)).alias("a"), symbols.split_stream(F.lit([0])).alias("b")).first()
    assert r["a"] == ["🇯🇵", "A"] and r["b"] == []


def test_lattice_log(spark):
    edges = spark.createDataFrame([("ab", 0, 2, "ab", "X", 5), ("ab", 0, 1, "a", "X", 9)], "s string, top int, end int, reading string, pos string, cost long")
    best = spark.createDataFrame([("ab", 1, 7, "ab/X")], "s string, rank int, cost long, path string")
    r = files.lattice_log(edges, best).first()
    assert r["path"] == "ab/X" and r["lattice"].startswith('[{"top":0,"end":1,"reading":"a"')


def _stream(spark, df, path):
    df.repartition(3).write.parquet(f"{path}/in")
    return streaming.stream_documents(spark, f"{path}/in", df.schema, files=1)


def test_history_stream_is_the_batch(spark, tmp_path):
    turns = spark.createDataFrame([(["a", "b"], 1), (["b"], 2), (["a", "b"], 3), (["a"], 4), (["a"], 5), (["a"], 6)], "words array<string>, at long")
    got = streaming.history_state(spark, _stream(spark, turns, tmp_path), f"{tmp_path}/state", f"{tmp_path}/check")
    want = history.register_all(turns)
    key = lambda df: sorted(tuple(r) for r in df.select("gram", "used", "strong", "last_at").collect())
    assert key(got) == key(want)


def test_folded_state(spark, tmp_path):
    docs = spark.createDataFrame([("a b a",), ("a b",), ("c",)], "text string")
    counts = streaming.ngram_state(spark, _stream(spark, docs, tmp_path), 1, f"{tmp_path}/state", f"{tmp_path}/check")
    for limit, halved in ((100, False), (2, True)):
        streaming.folded(spark, f"{tmp_path}/state", f"{tmp_path}/folded{limit}", limit)
        got = spark.read.parquet(f"{tmp_path}/folded{limit}").select("gram", "cnt")
        want = ngrams.decay(counts) if halved else counts
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("gram", "cnt").collect()))


def test_topics_from_a_stream(spark, tmp_path):
    rows = [(d, [f"{'abc'[d % 3]}{(d * 7 + k) % 9}" for k in range(8)]) for d in range(12)] + [(99, ["few"])]
    docs = spark.createDataFrame(rows, "key long, words array<string>")
    streaming.learn_topics(_stream(spark, docs, tmp_path), 2, f"{tmp_path}/state", f"{tmp_path}/check", full=20)
    model = files.current_table(spark, f"{tmp_path}/state/model").collect()
    assert {r["word"] for r in model} <= {w for _, ws in rows for w in ws} - {"few"} and len(model) >= 20
    assert [sum(r["ps"][k] for r in model) for k in range(2)] == pytest.approx([1.0, 1.0]) and sum(model[0]["prior"]) == pytest.approx(1.0)
    assert topics.unique_words(docs.withColumn("b", F.lit(1)), "b", full=20).first()["learn"]

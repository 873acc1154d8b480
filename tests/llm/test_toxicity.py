import itertools
import math
import zlib

import numpy as np

from textlattice.llm import queries, toxicity
from tests.llm import cases


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    move = np.exp(rng.normal(size=(2, 2)))
    e = rng.normal(size=9)
    starts, lengths = np.array([0, 4]), np.array([4, 5])
    p, moves = toxicity.forward_backward(e, starts, lengths, move)
    want, want_moves = np.zeros(9), np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = 1.0
            for k, y in enumerate(path):
                w *= move[path[k - 1] if k else 0][y] * (math.exp(e[s + k]) if y else 1.0)
            total += w
            on += w * np.array(path)
            for k, y in enumerate(path):
                pairs[path[k - 1] if k else 0][y] += w
        want[s : s + n] = on / total
        want_moves += pairs / total
    assert np.allclose(p, want) and np.allclose(moves, want_moves)


def test_pieces_of_a_sentence_give_the_whole_sentence(monkeypatch):
    rng = np.random.default_rng(5)
    move, e = np.exp(rng.normal(size=(2, 2))), rng.normal(size=700) * 3
    breaks = np.zeros(700, bool)
    breaks[[0, 40, 41, 600, 603]] = True
    monkeypatch.setattr(toxicity, "PIECE", 10_000)
    starts, lengths, goes_on = toxicity.chains(breaks)
    assert not goes_on.any()
    whole = toxicity.forward_backward(np.where(breaks, 0, e), starts, lengths, move)
    for piece in (1, 7, 256):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        starts, lengths, goes_on = toxicity.chains(breaks)
        assert goes_on.any() and lengths.max() <= piece
        p, moves = toxicity.forward_backward(np.where(breaks, 0, e), starts, lengths, move, True, goes_on)
        assert np.allclose(p[~breaks], whole[0][~breaks]) and np.allclose(moves, whole[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    hit = wrong = missed = 0
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and d in labels:
            hit += labels[d] and r["predicted"]
            missed += labels[d] and not r["predicted"]
            wrong += (not labels[d]) and r["predicted"]
    assert hit and hit / (hit + missed) >= 0.7 and hit / (hit + wrong) >= 0.7


def ids_of_fold(held_out, n):
    return [k for k in range(20, 400) if (zlib.crc32(str(k).encode()) % 4 == 2) == held_out][:n]


def test_odd_rows(spark):
    ids = ids_of_fold(False, 60)
    bad = [(k, cases.words(30, k) + " vile " * (k % 3 + 1) + ". " + cases.words(20, k + 1)) for k in ids[:30]]
    good = [(k, cases.words(60, k)) for k in ids[30:]]
    labels = spark.createDataFrame([(k, int(k in ids[:30])) for k in ids] + [(None, 1), (8, None), (1, 0)], "doc_id long, toxic int")
    rows = [cases.row(k, t) for k, t in bad + good]
    docs = spark.createDataFrame(cases.ODD + rows + [cases.row(5, "so vile vile a text"), cases.row(None, "vile")], cases.SCHEMA)
    out = toxicity.score(spark, docs, labels).collect()
    assert len(out) == len(cases.ODD) + 62 and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r for r in out}
    assert min(by_id[k]["score"] for k in ids[:30]) > 0.5 > max(by_id[k]["score"] for k in ids[30:])
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1 and by_id[5]["predicted"] == 1
    assert all(r["score"] == 0 for r in toxicity.score(spark, cases.odd(spark), labels.limit(0)).collect())
    assert toxicity.score(spark, cases.empty(spark), labels).collect() == []


def test_labelled_rows_without_anything_to_learn(spark):
    a, b = ids_of_fold(False, 2)
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, toxic int")
    for texts in ([], [(3, "no labels")], [(a, "x" * 50_000), (b, "y" * 50_000)], [(a, ""), (b, None)], [(a, "one class only")], [(a, "t"), (b, "u")]):
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = toxicity.score(spark, docs, labels).collect()
        assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)


def test_an_id_of_many_rows_gives_one_text(spark, monkeypatch):
    many, few = [k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 4 != 2][:2]  # neither is held out
    labels = spark.createDataFrame([(many, 1), (few, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(many, f"text {k}") for k in range(50)] + [(few, "b"), (few, "a")], "doc_id long, text string")
    given = []
    monkeypatch.setattr(toxicity.Field, "fit", lambda texts, toxic, prior: given.extend(zip(texts, toxic.tolist(), strict=True)) or toxicity.Field({}, 0.0, np.ones((2, 2)), np.zeros(4)))
    toxicity.train(docs, labels)
    assert sorted(given) == [("a", 0), ("text 0", 1)]


def test_spans_are_offsets():
    text = "you are a Foul beast. fine"
    p = np.array([0, 0, 0, 0.9, 0.8, 0, 0])
    assert [(text[a:b], q) for a, b, q in toxicity.spans_of(text, p)] == [("Foul beast", 0.9)]

import math
import random
import re
from collections import Counter

import pytest

from textlattice.llm import kneser_ney as K
from textlattice.llm import queries
from tests.llm import cases


def by_hand(trusted: list[str], texts: list[str], size: int) -> list[float | None]:
    """The same model with plain loops over words."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    freq = Counter(w for t in trusted for w in split(t))
    top = [w for w, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0]))[: size - 2]]
    known, others = set(top), len(freq) - len(top)
    mapped = lambda t: ["<s>", *(w if w in known else "<unk>" for w in split(t))]
    bi = Counter(p for m in map(mapped, trusted) for p in zip(m, m[1:]))

    def three(values: list[int]) -> list[float]:
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        return [0, *(min(max(d, 0), hi) for d, hi in zip(raw, (0.95, 1.9, 2.85), strict=True))]

    d = three(list(bi.values()))
    total, after = Counter(), {}
    before = Counter()
    for (v, w), c in bi.items():
        total[v] += c
        after.setdefault(v, []).append(c)
        before[w] += 1
    low = three(list(before.values()))
    every = max(1, sum(before.values()))
    spread = sum(low[min(k, 3)] for k in before.values()) / every / size
    uni = lambda w: max(max(before[w] - low[min(before[w], 3)], 0) / every + spread, 1e-12)
    back = lambda v: min(max(sum(d[min(c, 3)] for c in after[v]) / total[v], 1e-12), 1.0) if v in after else 1.0
    out = []
    for t in texts:
        m = mapped(t)
        logs = []
        for v, w in zip(m, m[1:]):
            p = back(v) * uni(w)
            if (v, w) in bi:
                p += (bi[v, w] - d[min(bi[v, w], 3)]) / total[v]
            logs.append(math.log(p) - (math.log(max(1, others)) if w == "<unk>" else 0))
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


@pytest.mark.parametrize("shards, rounds", [(5, 1), (40, 3)])
def test_perplexities_against_plain_loops(spark, shards, rounds):
    texts = [cases.words(50 + 7 * k, k, 60) for k in range(30)] + ["", "w1", "new words w1 w2 w3 w4", None]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long").na.fill("").repartition(5)
    labels = spark.createDataFrame([(k, 1 if k < 20 else 0) for k in range(30)], "doc_id long, quality int")
    trusted = [r["doc_id"] for r in labels.filter("quality = 1").filter(f"not ({K.HELD_OUT})").collect()]
    got = {r["key"]: r["perplexity"] for r in K.perplexities(spark, docs, labels, shards=shards, chunk=200, rounds=rounds).collect()}
    kinds = len({w for k in trusted for w in texts[k].split()})
    want = by_hand([texts[k] for k in trusted], [t or "" for t in texts], kinds + 2)
    assert sorted(k for k, p in got.items() if p is None) == [30, 33]
    assert [got[k] for k in range(30)] == pytest.approx(want[:30], rel=1e-9)
    assert [got[31], got[32]] == pytest.approx(want[31:33], rel=1e-9)


def test_keeps_good_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["kept"] for r in queries.op3_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and d in got]
    bad = [got[d] for d, q in labels.items() if q == 0 and d in got]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    kept = K.survivors(spark, cases.odd(spark), labels)
    assert kept.columns == cases.odd(spark).columns
    texts = [r["text"] for r in kept.collect()]
    assert texts and all((t or "").strip() for t in texts)
    every = K.survivors(spark, cases.odd(spark), labels.limit(0)).count()
    assert every == sum(bool(re.search(r"[^\x20\x09-\x0D]", t or "")) for _, t, *_ in cases.ODD)
    assert K.survivors(spark, cases.empty(spark), labels).collect() == []
    assert K.judged(spark, cases.odd(spark), labels).count() == len(cases.ODD)


def test_every_word_keeps_its_own_counts(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(200_000)}" for _ in range(12_000)) for _ in range(12)] + ["", "w1 new w2", "w5"]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int")
    trusted = [texts[x["doc_id"]] for x in labels.filter(f"not ({K.HELD_OUT})").collect()]
    kinds = len({w for t in trusted for w in t.split()})
    assert kinds > 1 << 16
    got = {x["key"]: x["perplexity"] for x in K.perplexities(spark, docs, labels).collect()}
    want = by_hand(trusted, texts, kinds + 2)
    assert got.pop(12) is None and [got[k] for k in sorted(got)] == pytest.approx(want[:12] + want[13:], rel=1e-9)


def test_thresholds_have_one_formula_at_every_size(spark):
    ids = range(400)
    docs = spark.createDataFrame([(k, cases.words(40, k, 60 if k % 10 else 3000), "b" if k % 10 else "r") for k in ids] + [(400, "w1", "none")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int")
    fair = {x["doc_id"] for x in labels.filter(K.HELD_OUT).collect()}
    rows = K.judged(spark, docs, labels).collect()
    logs = lambda lang: sorted(math.log(x["perplexity"]) for x in rows if x["doc_id"] in fair and lang in (None, x["lang"]))
    top = lambda x: x[math.ceil(K.QUANTILE * len(x)) - 1]
    cuts = {x["lang"]: math.log(x["threshold"]) / K.MARGIN for x in rows}
    assert 0 < len(logs("r")) < 20 < len(logs("b"))
    for lang in "rb":
        n = len(logs(lang))
        assert cuts[lang] == pytest.approx((n * top(logs(lang)) + 20 * top(logs(None))) / (n + 20), rel=1e-9)
    assert cuts["none"] == pytest.approx(top(logs(None)), rel=1e-9)


def test_quantiles_read_held_out_rows_once_written(spark, smoke, monkeypatch):
    plans, real = {}, K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, name: (plans.update({name: df._jdf.queryExecution().toString()}), real(df, name))[1])
    K.judged(spark, spark.read.parquet(f"{smoke}/documents.parquet"), spark.read.parquet(f"{smoke}/labels.parquet"))
    assert "Union" in plans["fair"] and "Union" not in plans["cuts"]

import re
from collections import defaultdict

from textlattice.llm import mixing
from tests.llm import cases


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, rest = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            rest -= full[s]


def check(got, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
        most[s] = max(most[s], size(t))
    want = plain_targets(dict(totals))
    for r in got:
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    return {s: (taken[s], want[s], most[s]) for s in totals}


def test_targets_are_met(spark):
    rows = [(k, cases.words(1 + k % 90, k), "hot" if k % 3 == 0 else f"s{k % 7}" if k % 50 else None) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for got, want, most in check(mixing.mix(docs).collect(), rows).values():
        assert abs(got - want) <= 2 * most
    again = mixing.mix(docs.repartition(3))
    assert cases.rows_of(again, "doc_id", "taken") == cases.rows_of(mixing.mix(docs), "doc_id", "taken")


def test_odd_rows(spark):
    got = mixing.mix(cases.odd(spark)).collect()
    check(got, [(r[0], r[1], r[3]) for r in cases.ODD])
    assert mixing.mix(cases.empty(spark)).collect() == [] and mixing.repeated(cases.empty(spark)).collect() == []
    times = sum(r["times"] for r in got)
    out = mixing.repeated(cases.odd(spark))
    assert out.columns == cases.odd(spark).columns and out.count() == times

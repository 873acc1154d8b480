"""The audit of filters against a loop over documents and orders."""

import itertools
import re
from collections import Counter

from tests.llm import cases
from textlattice.llm import filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = [(1, 1, 0), (3, 0, 1), (6, 1, 1), (7, 0, 0), (7, 1, 0), (8, None, 1), (None, 1, 1), (99, 1, 1)]


def failures(rows):
    """rows: (doc_id, text, source). The letters that each fails."""
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min([x for x in (first.get(t or ""), i) if x is not None], default=None)
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        low = first[t]
        says = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(set(t) & set("#$%&*|")),
            "E": low is not None and (i is None or i > low),
        }
        yield "".join(f for f in "ABCDE" if says[f])


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = [], Counter()
    docs = [(i, s or "", f) for (i, _, s), f in zip(rows, failures(rows), strict=True)]
    for part in {p for _, p, _ in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in docs if p == part]
            every = left
            for step, own in enumerate(order, 1):
                gone = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                fails = sum(own in f for _, f in every)
                shapley[part, own] += len(gone)
                alone = sum(f == own for _, f in every)
                out.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, docs, labels=LABELS):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(docs, table).select(*COLUMNS).collect())


def test_odd_rows_and_every_order(spark):
    rows = [*cases.ODD, cases.row(20, "A B # " + cases.words(250, 9), source=None), cases.row(21, cases.words(300, 9, 20), source="")]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = audited(spark, docs)
    assert got == brute([(r[0], r[1], r[3]) for r in rows], LABELS)
    assert {r[0] for r in got} == {"", "a", "b"} and len(got) == 3 * 600


def test_repeated_rows_count_each(spark):
    rows = [(1, "same words", "a"), (1, "same words", "a"), (1, "same words", "b"), (2, "same words", "b"), (1, "x " * 250, "a"), (1, "x " * 250, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audited(spark, docs) == brute(rows, LABELS)


def test_hot_copies_take_the_broadcast(spark):
    rows = [(k, "hot text", "a") for k in range(3000)] + [(5000 + k, cases.words(210, k), "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert audited(spark, docs) == brute(rows, LABELS)


def test_empty_table(spark):
    assert audited(spark, cases.empty(spark)) == []
    assert audited(spark, spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), []) == brute([(1, "a", "s")], [])

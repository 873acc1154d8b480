"""MinHash near-duplicates against all pairs of sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from textlattice.llm import minhash
from textlattice.llm.common import table


def shingles(text, n=2):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in w]
    return frozenset(b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    """rows: (doc_id, text). (doc_id, n_shingles, component_id, kept), by the pairs that have a shingle in common."""
    by_set = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        by_set[shingles(text)].append(k)
    sets = [s for s in by_set if s]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    for k, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < k:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(k), root(j)
                up[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for k, s in enumerate(sets):
        low[root(k)] += [rows[r][0] for r in by_set[s]]
    out = []
    for s, members in by_set.items():
        for r in members:
            i = rows[r][0]
            c = min((x for x in low[root(sets.index(s))] if x is not None), default=None) if s else i
            out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(spark, docs, **how):
    return cases.rows_of(minhash.near_duplicates(spark, docs, **how), "doc_id", "n_shingles", "component_id", "kept")


def edited(words, share, r):
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in words]


def families(seed, n=25, size=12):
    """Copies at similarities around 0.8, and copies of copies."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        base = cases.words(r.choice((8, 30, 120, 400)), r.randrange(10**6), 10**5).split()
        for _ in range(size):
            rows.append((len(rows), " ".join(edited(base, r.choice((0, 0.02, 0.05, 0.08)), r))))
            base = edited(base, 0.03, r) if r.random() < 0.3 else base
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 512), (2, 3)])
def test_families_against_all_pairs(spark, seed, tile):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(spark, docs, tile=tile)
    assert got == brute(rows)
    assert 25 < len({r[2] for r in got}) < len(rows) - 50


def test_odd_rows(spark):
    rows = [*cases.ODD, cases.row(30, "ONE"), cases.row(31, "Two words"), cases.row(32, "two  WORDS"), cases.row(33, "İ two words")]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    assert found(spark, docs) == brute([(r[0], r[1]) for r in rows])


def test_one_large_family(spark):
    """Many different near copies: the smallest one meets all, and those that fail meet the rest."""
    r = random.Random(4)
    base = cases.words(60, 5, 10**5).split()
    rows = [(k, " ".join(edited(base, 0.05, r))) for k in range(400)] + [(1000 + k, cases.words(40, k, 10**5)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(spark, docs, tile=64) == brute(rows)


def test_a_whole_table(spark, smoke):
    docs = table(spark, smoke, "documents")
    assert found(spark, docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert found(spark, cases.empty(spark)) == []


def test_pruning_keeps_its_chance():
    least = minhash.least_matches(0.8)
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (100_000, minhash.HASHES), dtype=np.uint8)
    same = r.random(a.shape) < 0.8
    b = np.where(same, a, r.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(minhash.not_pruned(a, b, least)) >= len(a) - 2
    far = np.where(r.random(a.shape) < 0.45, a, b[::-1])
    assert len(minhash.not_pruned(a, far, least)) < 20
    assert minhash.not_pruned(a[7], a[:20], least).tolist() == [7]


def test_minhashes_estimate_similarity():
    s = minhash.Sketcher()
    words = cases.words(2000, 8, 10**6).split()
    a, b = (s.grams(" ".join(w)) for w in (words[:1800], words[200:]))
    share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = (s.minhashes(a) == s.minhashes(b)).mean()
    assert abs(equal - share) < 0.1


def test_rows_in_another_order(spark):
    rows = families(9, 6)
    one, two = (found(spark, spark.createDataFrame(rows, "doc_id long, text string").orderBy(o)) for o in (F.col("doc_id"), F.col("text")))
    assert one == two


def test_failed_entries_are_dealt_without_a_union_of_joins(spark):
    rows = [(1, k, 1 if k < 8 else k, k >= 8) for k in range(1, 12)] + [(20, 20, 20, False), (20, 21, 21, True)] + [(30, k, 30, False) for k in (30, 31, 32)]
    payload = spark.createDataFrame([(r[1], bytes(minhash.HASHES)) for r in rows], "id long, bytes binary")
    out = minhash.dealt(spark.createDataFrame(rows, "group long, id long, base long, failed boolean"), payload, 2)
    assert "Union" not in out._jdf.queryExecution().toString()
    met = defaultdict(lambda: ([], []))
    for r in out.collect():
        assert r["base"] == (1 if r["side"] and r["id"] < 8 else r["id"])
        met[r["group"], r["tile"], r["chunk"]][r["side"]].append(r["id"])
    pairs = sorted((g, a, b) for (g, _, _), (own, others) in met.items() for a in own for b in others)
    assert pairs == [(1, a, b) for a in range(8, 12) for b in range(1, 12)]
    assert all(len(own) <= 4 for own, _ in met.values())

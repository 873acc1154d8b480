"""Counts of a stream with halving: against a plain loop, with batches that run again, and saved by the clock."""

import random
from collections import Counter

import pytest

from textlattice.streaming import flush


def frame(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "gram string, cnt long").coalesce(1)


def batches(seed, n=11):
    r = random.Random(seed)
    return [Counter(f"g{int(r.random() ** 2 * 60)}" for _ in range(r.randrange(0, 50))) for _ in range(n)]


def plain(parts, limit):
    state, saved = Counter(), {}
    for k, p in enumerate(parts):
        state.update(p)
        if len(state) >= limit:
            saved[k] = dict(state)
            state = Counter({g: c // 2 for g, c in state.items() if c // 2})
    return dict(state), saved


def rows(df):
    return {r["gram"]: r["cnt"] for r in df.collect()}


@pytest.mark.parametrize(("limit", "fan"), [(30, 2), (45, 3), (1000, 2)])
def test_against_a_loop_with_repeats(spark, tmp_path, limit, fan):
    parts = batches(limit)
    store = flush.CountStore(spark, str(tmp_path / "counts"), limit, fan)
    for k, p in enumerate(parts):
        for _ in range(1 + (k % 3 == 1)):  # some run again after they have ended
            store.add(frame(spark, p), k)
        assert rows(store.current()) == plain(parts[: k + 1], limit)[0]
    assert {k: rows(s) for k, s in store.snapshots().items()} == plain(parts, limit)[1]
    assert len([t for t in store.tables() if t.kind != "snapshot"]) <= 3 * fan + 2


def test_a_batch_that_failed_half_way(spark, tmp_path, monkeypatch):
    parts = batches(3, 6)
    store = flush.CountStore(spark, str(tmp_path / "counts"), 30, 2)
    for k, p in enumerate(parts):
        if k in (3, 5):
            monkeypatch.setattr(store, "_drop", lambda path: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                store.add(frame(spark, p), k)
            monkeypatch.undo()
        store.add(frame(spark, p), k)
        assert rows(store.current()) == plain(parts[: k + 1], 30)[0]


def test_saved_by_the_clock(spark, tmp_path):
    store = flush.CountStore(spark, str(tmp_path / "counts"), 1000)
    hours = [8, 8, 9, 9, 15, 16, 21]
    for k, hour in enumerate(hours):
        for _ in range(2):
            store.add(frame(spark, Counter({"a": 1})), k, hour)
    assert {k: rows(s)["a"] for k, s in store.snapshots().items()} == {0: 1, 2: 3, 4: 5, 6: 7}


def test_nothing_yet(spark, tmp_path):
    store = flush.CountStore(spark, str(tmp_path / "none"), 10)
    assert rows(store.current()) == {} and store.snapshots() == {}
    store.add(frame(spark, Counter()), 0)
    assert rows(store.current()) == {}

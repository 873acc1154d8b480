"""Users' ageing history: a stream that is stopped and goes on gives what one pass over all turns gives."""

import random

import pytest
from pyspark.sql import functions as F

from textlattice.streaming import users as U

AGE = 150_000


def brute(rows, now, longest=3):
    state = {}
    for user, words, at in sorted(rows, key=lambda r: r[2]):
        for k in range(1, min(longest, len(words)) + 1):
            key = (user, " ".join(words[-k:]))
            used, strong, last = state.get(key, (0, 0, at))
            used >>= (at - last) // AGE
            state[key] = (used + 1, min(strong + 1, 4) if used else 1, at)
    out = set()
    for key, (used, strong, last) in state.items():
        h = (now - last) // AGE
        if used >> h:
            out.add((*key, used >> h, strong, last + h * AGE))
    return out


def made(seed):
    r = random.Random(seed)
    return [(r.randrange(3), [r.choice("ab") for _ in range(r.randrange(0, 4))], 60_000 * (t + 1)) for t in range(24) for _ in range(r.randrange(0, 4))]


def put(spark, rows, path):
    table = spark.createDataFrame(rows, "user long, words array<string>, ms long")
    table.select("user", "words", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_stopped_and_restarted(spark, tmp_path, seed):
    rows, path, state = made(seed), str(tmp_path / "turns"), str(tmp_path / "state")
    schema = "user long, words array<string>, at timestamp"
    for part in ((0, 7), (7, 14), (14, 24)):
        put(spark, [r for r in rows if part[0] * 60_000 < r[2] <= part[1] * 60_000], path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        U.learn(stream, state, str(tmp_path / "checkpoint"), AGE, longest=3)
    now = max(r[2] for r in rows)
    got = {tuple(r) for r in U.current(spark, state, now, AGE).select("user", "gram", "used", "strong", "last_ms").collect()}
    assert got == brute(rows, now)
    later = now + 4 * AGE
    assert {tuple(r) for r in U.current(spark, state, later, AGE).select("user", "gram", "used", "strong", "last_ms").collect()} == brute(rows, later)
    timers = spark.read.schema(f"{U.CHANGES}, batch long").parquet(state).filter("as_of_ms % 60000 <> 0").count()
    assert timers > 0


def test_ageing_in_steps():
    assert U.aged(5, 3, 0, 149_999, AGE) == (5, 3)
    assert U.aged(5, 3, 0, 300_000, AGE) == (1, 3)
    assert U.aged(5, 3, 0, 450_000, AGE) == (0, 0)


def test_one_row_for_each_turn(spark):
    """all grams of a turn are one row and one key, by their last word, not one for each gram."""
    turns = spark.createDataFrame([(1, ["a", "b", "c"], 1000), (1, ["c"], 2000), (2, [], 3000), (2, None, 3000)], "user long, words array<string>, ms long")
    got = U.last_words(turns.select("user", "words", F.timestamp_millis("ms").alias("at")), longest=2)
    assert {(r["user"], r["word"], tuple(r["words"]), r["at_ms"]) for r in got.collect()} == {(1, "c", ("b", "c"), 1000), (1, "c", ("c",), 2000)}
    assert got.count() == 2

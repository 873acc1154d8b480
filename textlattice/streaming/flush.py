"""Counts of a stream that are halved when they are too many, and saved by size and by time.

The state is a set of tables, each of which stands for a run of batches: `part-a-b` for the counts of batches a to b, `base-b` for
all up to b. Every `fan` tables of one tier become one of the next, so that there are few of them and a count is written again
once per tier. As long as the tables' rows together are fewer than `limit`, so are the distinct grams, and nothing is added up.
Otherwise all are added up to a new base; if that has `limit` grams or more, it is saved as it is and its counts are halved.

What a batch does depends on its number and on the tables of earlier batches only, and tables that others stand for are
deleted when the next batch begins: a batch that runs again, after it failed anywhere or after it has ended, changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.operators import ngrams
from textlattice.operators.topics import snapshot_due
from textlattice.sources.files import _fs

FAN = 4
_NAME = re.compile(r"(part|base|snapshot)-(\d+)(?:-(\d+))?(?:-(\d+))?$")


class Table(NamedTuple):
    kind: str
    first: int
    last: int
    path: str


class CountStore:
    """Counts (gram, cnt) below the folder `top`. For one writer at a time; readers see whole tables only."""

    def __init__(self, spark: SparkSession, top: str, limit: int, fan: int = FAN) -> None:
        self.spark, self.top, self.limit, self.fan = spark, top, limit, fan

    def tables(self) -> list[Table]:
        fs, at = _fs(self.spark, self.top)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        out = []
        for name in names:
            m = _NAME.fullmatch(name)
            if m and fs.exists(_fs(self.spark, f"{self.top}/{name}/_SUCCESS")[1]):
                a, b = int(m[2]), int(m[3] or m[2])
                out.append(Table(m[1], a if m[1] == "part" else 0, b if m[1] == "part" else a, f"{self.top}/{name}"))
        return sorted(out)

    def _base(self, before: int) -> Table | None:
        return max((t for t in self.tables() if t.kind == "base" and t.last < before), key=lambda t: t.last, default=None)

    def _cover(self, first: int, last: int, widest: int = 1 << 62) -> list[Table]:
        """Parts that stand for the batches from first to last, each once: the widest first."""
        parts = [t for t in self.tables() if t.kind == "part" and t.last <= last and t.last - t.first + 1 <= widest]
        out = []
        while first <= last:
            best = max((t for t in parts if t.first == first), key=lambda t: t.last, default=None)
            if best is None:
                first += 1  # a batch without a table
            else:
                out.append(best)
                first = best.last + 1
        return out

    def _read(self, tables: list[Table]) -> DataFrame:
        frames = [self.spark.read.schema("gram string, cnt long").parquet(t.path) for t in tables]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], "gram string, cnt long")

    def _summed(self, tables: list[Table]) -> DataFrame:
        return self._read(tables).groupBy("gram").agg(F.sum("cnt").alias("cnt"))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.top}/{name}")
        return self.spark.read.schema("gram string, cnt long").parquet(f"{self.top}/{name}")

    def _drop(self, path: str) -> None:
        fs, at = _fs(self.spark, path)
        fs.delete(at, True)

    def _forget(self, number: int) -> None:
        """Deletes what tables of batches before this one stand for."""
        base = self._base(number)
        done = -1 if base is None else base.last
        parts = [t for t in self.tables() if t.kind == "part" and t.last < number]
        for t in self.tables():
            wider = any(p != t and p.first <= t.first and t.last <= p.last for p in parts)
            if t.kind == "part" and (t.last <= done or (t.last < number and wider)) or t.kind == "base" and t.last < done:
                self._drop(t.path)

    def add(self, counts: DataFrame, number: int, hour: int | None = None) -> bool:
        """Takes in the counts of a batch. Whether the counts were halved. hour: of the clock, if states are to be saved by time."""
        self._forget(number)
        self._write(counts.select("gram", "cnt"), f"part-{number}-{number}")
        base = self._base(number)
        done = -1 if base is None else base.last
        size = self.fan
        while (number + 1) % size == 0 and number - size >= done:
            self._write(self._summed(self._cover(number + 1 - size, number, size // self.fan)), f"part-{number + 1 - size}-{number}")
            size *= self.fan
        every = ([base] if base else []) + self._cover(done + 1, number)
        halved = False
        if self._read(every).count() >= self.limit:
            whole = self._write(self._summed(every), f"whole-{number}")
            halved = whole.count() >= self.limit
            self._write(ngrams.decay(whole, 2) if halved else whole, f"base-{number}")
            if halved:
                self._save(whole, number, hour)
            self._drop(f"{self.top}/whole-{number}")
        if hour is not None and not halved:
            last, hourly = self._saved(number)
            now, hourly = (True, True) if last is None else snapshot_due(last, hour, hourly)
            if now:
                self._save(self._summed(every), number, hour, hourly)
        return halved

    def _saved(self, before: int) -> tuple[int | None, bool]:
        """The hour of the last state that was saved before a batch, and whether one is still due in each hour."""
        fs, at = _fs(self.spark, self.top)
        found = [_NAME.fullmatch(f.getPath().getName()) for f in fs.listStatus(at)]
        names = sorted((int(m[2]), int(m[3]), m[4] == "1") for m in found if m and m[1] == "snapshot" and m[3] and int(m[2]) < before)
        return (names[-1][1], names[-1][2]) if names else (None, True)

    def _save(self, state: DataFrame, number: int, hour: int | None, hourly: bool | None = None) -> None:
        name = f"snapshot-{number}" if hour is None else f"snapshot-{number}-{hour}-{int(self._saved(number)[1] if hourly is None else hourly)}"
        state.write.mode("overwrite").parquet(f"{self.top}/{name}")

    def snapshots(self) -> dict[int, DataFrame]:
        """States that were saved, by the number of their batch."""
        return {t.last: self._read([t]) for t in self.tables() if t.kind == "snapshot"}

    def current(self) -> DataFrame:
        """The counts after all batches so far: gram, cnt."""
        base = self._base(1 << 62)
        last = max((t.last for t in self.tables() if t.kind == "part"), default=-1)
        return self._summed(([base] if base else []) + self._cover(0 if base is None else base.last + 1, last))


def count_stream(documents: DataFrame, n: int, store: CountStore, checkpoint: str, hour: Callable[[int], int] | None = None) -> None:
    """Counts the n-grams of all that a stream of documents has so far; a later call with the same checkpoint goes on."""

    def take(batch: DataFrame, number: int) -> None:
        store.add(ngrams.count_ngrams(ngrams.sentences_of(batch), n), number, hour(number) if hour else None)

    documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Each user's history of grams as keyed state of a stream, which ages.

Of a (user, gram) its uses, its strength and the time of its last use are kept. For each `age` that passes without a use
the uses are halved, in whole numbers; a gram with none left is forgotten, and with it its strength. Ageing is a matter of event
time alone: whether a timer fires or the next use comes first, a gram has the same counts. A key is a user and the last word of
a turn, as all grams that a turn counts end in it: a turn is one row and one visit of the state, not one for each gram, a busy
user is spread over all tasks, and what one key holds is what is alive of its grams.

Every batch's changes are written under its number, so that one that runs again replaces itself; a stream that is stopped goes on
from its checkpoint, with its state and its timers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from textlattice.operators.history import LONGEST, STRONGEST

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "user long, gram string, used long, strong long, last_ms long, as_of_ms long"


def aged(used: int, strong: int, last_ms: int, now_ms: int, age_ms: int) -> tuple[int, int]:
    """Uses and strength at a time, after the halvings since the last use that `last_ms` stands for."""
    used >>= max(0, min(62, (now_ms - last_ms) // age_ms))
    return used, strong if used else 0


class Ageing(StatefulProcessor):
    """The state of one (user, word): the grams that end in the word and are alive, and one timer for the first halving due."""

    def __init__(self, age_ms: int) -> None:
        self.age_ms = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("grams", "grams array<string>, used array<long>, strong array<long>, last_ms array<long>, timer_ms long")

    def _stored(self) -> tuple[dict[str, tuple[int, int, int]], int | None]:
        """The stored grams (used, strong, last_ms) and their timer."""
        old = self.state.get()
        if old is None:
            return {}, None
        return dict(zip(old[0], zip(*old[1:4], strict=True), strict=True)), old[4]

    def _store(self, grams: dict[str, tuple[int, int, int]], timer: int | None, fired: bool = False) -> None:
        """Stores what is alive, with a timer for its next halving; one that has fired goes by itself."""
        alive = {gram: x for gram, x in grams.items() if x[0]}
        due = min(x[2] for x in alive.values()) + self.age_ms if alive else None
        if due != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if alive:
            self.state.update((list(alive), *[list(x) for x in zip(*alive.values(), strict=True)], due))
        elif timer is not None:
            self.state.clear()

    def _rows(self, key: Any, grams: dict[str, tuple[int, int, int]], touched: Iterable[str]) -> Iterator[Row]:
        for gram in touched:
            used, strong, last = grams[gram]
            yield Row(user=key[0], gram=gram, used=used, strong=strong, last_ms=last, as_of_ms=last)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        grams, timer = self._stored()
        touched = {}
        for at, words in sorted((r["at_ms"], r["words"]) for r in rows):
            for k in range(1, len(words) + 1):
                gram = " ".join(words[-k:])
                used, strong, last = grams.get(gram, (0, 0, at))
                used, strong = aged(used, strong, last, at, self.age_ms)
                grams[gram] = (used + 1, min(strong + 1, STRONGEST), max(at, last))
                touched[gram] = None
        self._store(grams, timer)
        yield from self._rows(key, grams, touched)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        grams, timer = self._stored()
        touched = [gram for gram, x in grams.items() if x[2] + self.age_ms <= now]
        for gram in touched:
            used, strong, last = grams[gram]
            grams[gram] = (*aged(used, strong, last, now, self.age_ms), last + (now - last) // self.age_ms * self.age_ms)
        self._store(grams, timer, fired=True)
        yield from self._rows(key, grams, touched)

    def close(self) -> None:
        pass


def last_words(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """turns: user, words, at (a time). One row for each turn with words: user, word (the last one), words (the last ones, up to `longest`), at, at_ms."""
    rows = turns.filter((F.size("words") > 0) & F.col("at").isNotNull())
    n = F.least(F.lit(longest), F.size("words"))
    return rows.select("user", F.element_at("words", -1).alias("word"), F.slice("words", -n, n).alias("words"), "at", F.unix_millis("at").alias("at_ms"))


def learn(turns: DataFrame, state: str, checkpoint: str, age_ms: int, longest: int = LONGEST) -> None:
    """Runs over all that a stream of turns (user, words, at) has so far, and stops; a later call with the same checkpoint goes on.

    Turns that come after later ones of an earlier batch are late and don't count, nor do turns of 1970's first moment and before.
    """
    spark = turns.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state with timers needs this store
    try:
        rows = last_words(turns, longest).withWatermark("at", "0 seconds").groupBy("user", "word")
        changed = rows.transformWithState(Ageing(age_ms), CHANGES, "Update", "EventTime")
        store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{state}/batch={number}")
        query = changed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def current(spark: SparkSession, state: str, now_ms: int, age_ms: int) -> DataFrame:
    """The grams that are alive at a time: user, gram, used, strong, last_ms (the time up to which halvings have been done)."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(state)
    w = W.partitionBy("user", "gram").orderBy(F.desc("as_of_ms"), F.desc("batch"))
    last = rows.withColumn("k", F.row_number().over(w)).filter("k = 1")
    halvings = F.least(F.lit(62), F.expr(f"({now_ms} - last_ms) div {age_ms}")).cast("int")
    used = F.when(halvings > 0, F.call_function("shiftright", "used", halvings)).otherwise(F.col("used"))
    out = last.select("user", "gram", used.alias("used"), "strong", (F.col("last_ms") + F.greatest(halvings, F.lit(0)) * age_ms).alias("last_ms"))
    return out.filter("used > 0")

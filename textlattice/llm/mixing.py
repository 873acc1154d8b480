"""Mixing sources to target weights by hash thresholds, without sorting rows.

Every document has a 60-bit hash of its id. For each source the words are summed by the first 12 hash bits; the
boundary bucket, in which the budget runs out, is refined by the next 12 bits, and that bucket's boundary again.
The documents below the resulting threshold are taken once more than the whole repeats that the target allows.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a null id hashes like
the empty text; rows with equal ids are taken or left together; sources that fill up at the same level go in their order;
a text of any length is one size; columns of any name may stand beside those named, and `repeated` keeps them all; an empty
table gives an empty result. Sources are few beside documents: their targets are found in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textlattice.llm.common import WORD, materialise, packed, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS, LEVELS = 12, 3
HASH_BITS = 60


def id_hash(id_col: str | Column) -> Column:
    """60 bits of MD5 of the id as text."""
    key = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        id_hash(id_col).alias("h"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: its size and its target. The windows run over the sources, not over the documents.

    Shares go by weight; a source stops at `most` times its size. The level that all others reach is found by
    walking the sources in the order in which they fill up.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    over = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / over)
    level = s.filter("level <= full_at").agg(F.min_by("level", F.struct("full_at", "rank")).alias("lam"))
    s = s.crossJoin(F.broadcast(level))  # one row
    target = F.least(F.col("cap"), F.coalesce(F.col("lam"), F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """For each source: whole repeats, and the hash prefix below which documents are taken once more."""
    repeats = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    cut = goals.withColumn("repeats", repeats.cast("long"))
    cut = cut.withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size"))
    cut = cut.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        down = HASH_BITS - BITS * level
        part = rows.select("source", "size", F.shiftright("h", down).alias("bucket"))
        at = part
        if level > 1:
            inner = cut.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            at = part.join(inner, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("p"))).select(*part.columns)
        sums = at.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        lefts = cut.select(F.col("source").alias("s"), "left")
        edge = sums.join(lefts, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("upto") > F.col("left"))
        edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("edge"))
        edge = edge.select(F.col("source").alias("s"), "edge")
        cut = cut.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("prefix", F.coalesce(F.col("edge.bucket"), F.lit(0)))
        cut = cut.withColumn("left", F.col("left") - F.coalesce(F.col("edge.upto") - F.col("edge.words"), F.lit(0)))
        cut = cut.withColumn("edge_words", F.coalesce(F.col("edge.words"), F.lit(0))).drop("s", "edge")
        cut = materialise(cut, "mix-cut")
    nearer = (F.col("edge_words") > 0) & (F.col("edge_words") - F.col("left") < F.col("left"))
    return cut.select("source", "source_size", "target", "repeats", (F.col("prefix") + nearer.cast("long")).alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats of this document, taken."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "sized")
    cut = thresholds(rows, materialise(targets(rows, weights, most), "targets"), most).withColumnRenamed("source", "s")
    extra = (F.shiftright("h", HASH_BITS - BITS * LEVELS) < F.col("below")).cast("long")
    out = rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", F.col("repeats") + F.when(F.col("repeats") < most, extra).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "sized")
    cut = thresholds(rows, materialise(targets(rows), "targets"))
    full = packed(docs).withColumn("__h", F.shiftright(id_hash(F.col(f"__row.{id_col}")), HASH_BITS - BITS * LEVELS))
    out = full.join(cut, F.col(f"__row.{source_col}").eqNullSafe(F.col("source")))
    times = F.col("repeats") + F.when(F.col("repeats") < MOST_REPEATS, (F.col("__h") < F.col("below")).cast("long")).otherwise(0)
    out = out.select("__row", times.cast("int").alias("__times")).filter("__times > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")

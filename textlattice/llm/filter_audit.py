"""What filters remove together: every order of the filters, step by step, for each source.

1. Texts are dealt out by row, words are exploded and counted by (row, word), then by row: words and distinct words. A row is
   known by its id and a hash of its text, and a null "word" counts how many rows share both, so that repeated rows count
   each for itself.
2. Facts of a row that need no words (capitals, symbols, digest) are joined with the counts by an outer join; a text's
   smallest id comes from a grouping by digest. Digests of very many rows meet a broadcast of bounded size.
3. A row's failures are a pattern of five bits. One grouping by source counts the 32 patterns as conditional sums, for all
   rows, for good ones and for toxic ones.
4. All that an order's steps remove follows from these counts: what a set of filters keeps is the sum over the patterns
   that it doesn't meet. No order reads a document.

Filters: A too few words, B too few distinct words, C too many capitals, D a symbol of code, E a copy of a smaller id.

Defined results: a null text counts as empty (it fails A alone, and E if the empty text has a smaller id); a null source
and the empty one are the part ''; a null id is larger than other ids and has no label; rows of equal id and text are no
copies of each other; an id with several labels is good (toxic) if one of them says so; a document of any length is
counted whole; columns of other names are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.llm.common import SPACE, materialise, text_or_empty
from textlattice.llm.exact_dedup import with_group

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
SALTS = 32
PATTERNS = range(1 << len(FILTERS))
MEASURES = ("all", "good", "toxic")
_KEY = ["doc_id", "text_hash"]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text_hash, text. For each (doc_id, text_hash): words and distinct words of one row.

    Texts are dealt out by their key before they are exploded, so that both groupings of words find all of a row's words
    in their task and no word is shuffled. Many rows of one key are spread by salts, which all give the same counts.
    """
    words = F.concat(F.array(F.lit(None).cast("string")), F.split("text", SPACE))
    key = [*_KEY, "salt"]
    each = docs.withColumn("salt", F.spark_partition_id() % SALTS).repartition(*key)
    each = each.select(*key, F.explode(words).alias("word")).filter("word is null or word <> ''")
    each = each.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    by_row = each.groupBy(*key).agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"),
        F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words"),
        F.count("word").alias("n_distinct"),
    )
    each_row = by_row.select(*_KEY, (F.coalesce("words", F.lit(0)) / F.col("rows")).cast("long").alias("n_words"), "n_distinct")
    return each_row.groupBy(*_KEY).agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, n (equal rows), and whether they fail each filter, as columns A to E. Written once."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    single = rows.select(*_KEY, "part", F.sha2("text", 256).alias("text_sha256"), (100 * capitals > MOST_CAPITALS * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"))
    single = single.groupBy(*_KEY, "part", "text_sha256", "C", "D").agg(F.count(F.lit(1)).alias("n"))
    counts = word_counts(rows).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n_words", "n_distinct")
    both = single.join(counts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    few = F.col("n_words") < LEAST_WORDS
    repeated = 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")
    both = materialise(both.select("doc_id", "part", "text_sha256", "n", few.alias("A"), repeated.alias("B"), "C", "D"), "facts")
    first = materialise(both.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("group_size")), "first-ids")
    copy = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    return with_group(both, first).select("doc_id", "part", "n", *"ABCD", copy.alias("E"))


def marked(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """rows with `good` and `toxic`, by their labels."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    by_id = labels.groupBy(F.col(id_col).alias("doc_id")).agg(says(good_col).alias("good"), says(toxic_col).alias("toxic"))
    out = rows.join(by_id, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def pattern_counts(rows: DataFrame) -> DataFrame:
    """For each part, the number of documents of each pattern of failures: columns all_0 ... all_31, good_..., toxic_..."""
    bits = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.select("part", "n", bits.alias("pattern"), F.lit(True).alias("all"), "good", "toxic")
    count = lambda m, p: F.sum(F.when(F.col(m) & (F.col("pattern") == p), F.col("n")).otherwise(0)).alias(f"{m}_{p}")
    return rows.groupBy("part").agg(*[count(m, p) for m in MEASURES for p in PATTERNS])


def _kept(measure: str) -> Column:
    """At place S the number of documents that fail no filter of the set S."""
    return F.array(*[sum((F.col(f"{measure}_{p}") for p in PATTERNS if not p & s), F.lit(0)) for s in PATTERNS])


def steps(counts: DataFrame) -> DataFrame:
    """All orders' steps from the counts of the patterns."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    share = F.array(*[sum((F.col(f"all_{p}") * (len(orders) // p.bit_count()) for p in PATTERNS if p >> k & 1), F.lit(0)) for k in range(len(FILTERS))])
    rows = counts.select("part", share.alias("share"), *[_kept(m).alias(m) for m in MEASURES])
    rows = rows.select("*", F.explode(F.lit(orders)).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = sum((F.when(F.locate(f, F.col("filter_order")) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("place", place).withColumn("before", before).withColumn("own", F.expr("shiftleft(1, place)"))
    at = lambda m, s: F.get(F.col(m), s)
    lost = lambda m: at(m, F.col("before")) - at(m, F.col("before") + F.col("own"))
    fails = at("all", F.lit(0)) - at("all", F.col("own"))
    others = F.lit(len(PATTERNS) - 1) - F.col("own")
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("all", F.col("before") + F.col("own")).alias("kept"),
        lost("all").alias("removed"),
        (fails - lost("all")).alias("redundant"),
        (at("all", others) - at("all", F.lit(len(PATTERNS) - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at("share", F.col("place")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    return steps(pattern_counts(marked(facts(docs, id_col, text_col, part_col), labels)))

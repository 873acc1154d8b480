"""N-gram counting and what is done with counts: decay, vocabulary, ranking.

A gram is its words joined by one space, so that grouping works on one flat key. Counting is partial before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.sources.files import written, written_parts

BOS, EOS = "[BOS]", "[EOS]"


def bounded(words: str | Column) -> Column:
    """Words between a start and an end mark."""
    w = F.col(words) if isinstance(words, str) else words
    return F.concat(F.array(F.lit(BOS)), w, F.array(F.lit(EOS)))


def windows(words: str | Column, n: int) -> Column:
    """All full windows of n words, joined; none if there are fewer words."""
    w = F.col(words) if isinstance(words, str) else words
    last = F.size(w) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def sentences_of(docs: DataFrame, col: str = "text") -> DataFrame:
    return docs.select(bounded(T.tokens(col)).alias("words"))


def count_ngrams(sentences: DataFrame, n: int) -> DataFrame:
    """sentences: words. gram, cnt of order n."""
    return sentences.select(F.explode(windows("words", n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))


def count_long(sentences: DataFrame, n: int) -> DataFrame:
    """As `count_ngrams`, for orders whose grams are nearly all different: neighbouring windows go through the shuffle together.

    Each window has a mark, the least hash of its `seed` words in a row; windows in a row with one mark are one row, as the words
    that they cover. Equal grams have equal marks, so that they meet in one part. Nothing is counted before the shuffle but equal
    rows of one batch, so that no task holds or spills its input's grams; parts are small, and not merged by their size.
    """
    seed = max(2, (n - 1) // 2)
    parts = 4 * int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(0)), 0).to_numpy(zero_copy_only=False))
            rows = 0
            while rows < len(ends):  # some 400,000 words at a time
                upto = max(rows + 1, int(np.searchsorted(ends, (ends[rows - 1] if rows else 0) + 400_000, "right")))
                yield _marked(b.column(0).slice(rows, upto - rows), n, seed)
                rows = upto

    rows = sentences.select("words").mapInArrow(run, "mark long, words string, n long").repartition(parts, "mark")
    grams = rows.select("mark", F.explode(windows(F.split("words", " "), n)).alias("gram"), "n")
    return grams.groupBy("mark", "gram").agg(F.sum("n").alias("cnt")).select("gram", "cnt")


def _marked(sentences: pa.ListArray, n: int, seed: int) -> pa.RecordBatch:
    """mark, words, n: runs of windows of n words with one mark, equal ones once with their number."""
    words = sentences.flatten()
    sizes = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.dictionary_encode()
    h = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    count = max(0, len(words) - n + 1)
    seeds = np.zeros(max(0, len(words) - seed + 1), np.uint64)
    for k in range(seed):
        seeds = (seeds ^ h[k : k + len(seeds)]) * np.uint64(0x9E3779B97F4A7C15)
        seeds ^= seeds >> np.uint64(29)
    mark = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for k in range(n - seed + 1):
        mark = np.minimum(mark, seeds[k : k + count])
    within = np.arange(count) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:count] <= np.repeat(sizes, sizes)[:count] - n
    first = within.copy()
    first[1:] &= ~within[:-1] | (mark[1:] != mark[:-1])
    starts = np.flatnonzero(first)
    lengths = np.add.reduceat(within.astype(np.int64) * 1, starts) + n - 1 if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(0, np.cumsum(lengths))
    taken = words.take(pa.array(np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), taken), " ")
    table = pa.table({"mark": pa.array(mark[starts].view(np.int64)), "words": texts, "n": pa.array(np.ones(len(starts), np.int64))})
    table = table.group_by(["mark", "words"]).aggregate([("n", "sum")]).select(["mark", "words", "n_sum"]).rename_columns(["mark", "words", "n"]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], names=table.column_names)


def count_all(sentences: DataFrame, n_max: int = 7) -> DataFrame:
    """n, gram, cnt of all orders in one pass and one shuffle."""

    def of(n: int) -> Column:
        return F.transform(windows("words", n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    every = F.flatten(F.array(*[of(n) for n in range(1, n_max + 1)]))
    return sentences.select(F.explode(every).alias("g")).groupBy("g.n", "g.gram").agg(F.count(F.lit(1)).alias("cnt"))


def decay(ngrams: DataFrame, div: int = 2) -> DataFrame:
    """Counts divided in whole numbers; what falls to zero goes."""
    return ngrams.withColumn("cnt", F.expr(f"cnt div {int(div)}")).filter("cnt > 0")


def drop_oov(ngrams: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """ngrams (gram, cnt) of n words, all of which are in vocab (word): place by place, so that each join has what the one before left."""
    words = vocab.select(F.col("word").alias("_word")).distinct()
    out = ngrams.select("gram", "cnt")
    for k in range(n):
        out = out.join(words, F.get(F.split("gram", " "), F.lit(k)) == F.col("_word"), "left_semi")
    return out


def count_known(sentences: DataFrame, vocab: DataFrame, n: int, parts: int) -> DataFrame:
    """`count_ngrams` and `drop_oov`: gram, cnt of n words, all of which are in vocab (word). Grams are counted in parts by their hash, one after
    another, and the shuffles of a part's counts and joins are gone before those of the next one; written."""
    words = written(vocab.select("word").distinct(), "vocabulary")

    def part(k: int) -> DataFrame:
        grams = sentences.select(F.explode(windows("words", n)).alias("gram"))
        grams = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k) if parts > 1 else grams
        return drop_oov(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("cnt")), words, n)

    return written_parts((part(k) for k in range(parts)), "known-grams")


def compact(ngrams: DataFrame, limit: int) -> DataFrame:
    """Halve the counts if there are at least `limit` distinct grams."""
    size = ngrams.agg(F.count(F.lit(1)).alias("size"))
    kept = F.when(F.col("size") >= limit, F.expr("cnt div 2")).otherwise(F.col("cnt"))
    return ngrams.crossJoin(F.broadcast(size)).withColumn("cnt", kept).filter("cnt > 0").drop("size")  # one row


def encode_words(words: DataFrame) -> DataFrame:
    """words: word. Distinct words with ids from 1, in order of the words; 0 stays reserved.

    Ids come from range partitions and their sizes, so that no task numbers all words. The numbered words are written
    once: sizes and ids are of the same partitions, whatever is computed again.
    """
    ranged = words.select("word").distinct().repartitionByRange("word").sortWithinPartitions("word")
    numbered = ranged.withColumn("m", F.monotonically_increasing_id())
    numbered = numbered.withColumn("part", F.shiftright("m", 33)).withColumn("own", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = written(numbered.drop("m"), "numbered-words")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.select("part", "n"), sizes.select(F.col("part").alias("before"), F.col("n").alias("size"))
    base = a.join(F.broadcast(b), F.col("before") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("base"))  # a row per partition
    return numbered.join(F.broadcast(base), "part").select("word", (F.col("base") + F.col("own") + 1).alias("word_id"))


def rank_ngrams(ngrams: DataFrame, limit: int | None = None) -> DataFrame:
    """By count, the largest first, then by gram."""
    out = ngrams.orderBy(F.desc("cnt"), "gram")
    return out if limit is None else out.limit(limit)


def lookup_counts(requests: DataFrame, ngrams: DataFrame) -> DataFrame:
    """requests: gram. Their counts, 0 where there is none."""
    return requests.join(ngrams, "gram", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def filter_min_count(ngrams: DataFrame, lower: int | None = None) -> DataFrame:
    return ngrams if lower is None else ngrams.filter(F.col("cnt") >= lower)

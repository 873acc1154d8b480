"""Micro-batch versions of the counting operators.

Counts of a batch are written under the batch's number, so that a batch that runs again replaces itself; the state is the
sum over all batches, folded into one table when there are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.operators import history, ngrams, topics
from textlattice.sources.files import current_table, replace_table, table_generations


def _counted_batches(source: DataFrame, count: Callable[[DataFrame], DataFrame], state: str, checkpoint: str) -> None:
    def store(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    query = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_documents(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ngram_state(spark: SparkSession, documents: DataFrame, n: int, state: str, checkpoint: str) -> DataFrame:
    """Counts of all n-grams that a stream of documents has had so far: gram, cnt."""
    _counted_batches(documents, lambda b: ngrams.count_ngrams(ngrams.sentences_of(b), n), state, checkpoint)
    return spark.read.parquet(state).groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def history_state(spark: SparkSession, turns: DataFrame, state: str, checkpoint: str, longest: int = history.LONGEST) -> DataFrame:
    """A history's grams from a stream of turns (words, at): gram, used, strong, last_at."""
    _counted_batches(turns, lambda b: history.register_all(b, longest), state, checkpoint)
    out = spark.read.parquet(state).groupBy("gram").agg(F.sum("used").alias("used"), F.max("last_at").alias("last_at"))
    return out.withColumn("strong", F.least(F.col("used"), F.lit(history.STRONGEST)))


def folded(spark: SparkSession, state: str, target: str, limit: int) -> None:
    """The state as one table; all counts halved if there are at least `limit` grams."""
    total = spark.read.parquet(state).groupBy("gram").agg(F.sum("cnt").alias("cnt"))
    ngrams.compact(total, limit).write.mode("overwrite").parquet(f"{target}/batch=-1")


def learn_topics(documents: DataFrame, n: int, state: str, checkpoint: str, full: int = topics.FULL, mixture: bool = True) -> None:
    """Topics from a stream of documents (key, words). Documents with enough words wait in a buffer until they have `full`
    unique words; then a model is trained on them, into which the earlier one goes. The buffer's batches carry their number
    and a model the number of the last batch that it has learned, so that a batch that runs again changes nothing."""
    spark = documents.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        topics.learnable(batch).select("key", "words").write.mode("overwrite").parquet(f"{state}/buffer/batch={number}")
        known = current_table(spark, f"{state}/model") if table_generations(spark, f"{state}/model") else None
        last = -1 if known is None else known.agg(F.max("batch")).first()[0]
        if last >= number:
            return
        waiting = spark.read.schema("key long, words array<string>, batch long").parquet(f"{state}/buffer").filter(F.col("batch") > last)
        if waiting.select(F.explode("words")).distinct().count() < full:
            return
        model, prior = (None, None) if known is None else (known.select("word", "ps"), list(known.select("prior").first()[0]))
        model, prior, _ = topics.trained(topics.term_counts(waiting, "key", F.col("words")), "key", n, model, prior, mixture)
        replace_table(model.select("word", "ps", F.lit(prior).alias("prior"), F.lit(number).cast("long").alias("batch")), f"{state}/model")

    documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

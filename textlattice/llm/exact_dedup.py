"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. Rows come to it in batches, those with smaller ids first. A batch is
reduced to one row per digest, the digests that the index already has are removed by a sort-merge anti-join, and the rest
are appended. Everything is DataFrame code.

Defined results: a null text counts as the empty text; a null id is larger than every other id; of repeated rows (equal
text and equal id) any one stays; a text of any length is one digest; an empty table gives an empty result. Columns other
than the id and the text are not looked at, so their names don't matter. A digest of an earlier call keeps the id that it
has in the index, and no row of a later call stays for it. Ids that aren't numbers come as one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from textlattice.llm.common import SPACE, materialise, packed, text_or_empty

BUCKETS, BATCHES = 64, 2
#: A digest with more than 1/HEAVY of all rows is heavy; there are fewer than HEAVY of them, so they can be broadcast.
HEAVY = 1000


def digest_of(text: str) -> Column:
    """SHA-256 of the text in which each run of white space is one space."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " ").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, with the id that stays and the number of rows, in the bucketed table `name`."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS, id_type: str = "long"):
        self.spark, self.name, self.buckets, self.id_type = spark, name, buckets, id_type

    def table(self) -> DataFrame:
        """The index, which is made without rows where there is none."""
        if not self.spark.catalog.tableExists(self.name):
            columns = {"text_sha256": "string", "keep_id": self.id_type, "keep_row": "long", "n_keep": "long"}
            self._append(self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()]))
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        writer.saveAsTable(self.name)

    def append(self, batch: DataFrame) -> None:
        """batch: doc_id, row, text_sha256. Adds the digests that the index doesn't have yet.

        A digest of an earlier batch keeps the id that it has there, whatever the ids of later copies.
        """
        same = batch.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n"))
        fresh = same.groupBy("text_sha256").agg(first.alias("first"))
        fresh = fresh.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("first.n").alias("n_keep"))
        fresh = fresh.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # A bucket's rows come to one task, which writes one file for it, into however many tasks they are dealt.
        bucket = F.pmod(F.hash("text_sha256"), F.lit(self.buckets))
        self._append(fresh.repartitionByRange(self.buckets, bucket))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of its own for each row), text_sha256; written once, so that the numbers stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest_of(text_col).alias("text_sha256"))
    return materialise(rows, "digests")


def batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """rows by ranges of doc_id, about equally large, smaller ids first and nulls last."""
    if n < 2 or not isinstance(rows.schema["doc_id"].dataType, NumericType):
        return [rows]
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        above = F.lit(True) if lo is None else F.col("doc_id").isNull() | (F.col("doc_id") > lo)
        out.append(rows.filter(above & (F.lit(True) if hi is None else F.col("doc_id") <= hi)))
    return out


def registered(rows: DataFrame, index: DigestIndex, n: int) -> DataFrame:
    """Appends rows to the index, in n batches. The index with `old`, whether it had a digest before."""
    before = materialise(index.table().select("text_sha256", F.lit(True).alias("old")), "known")
    for batch in batches(rows, n):
        index.append(batch)
    return index.table().join(before, "text_sha256", "left")


def with_group(rows: DataFrame, index: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rows joined with their digest's group. Digests of very many rows meet a broadcast, the others a sort-merge join.

    At most `heavy` digests can each hold more than 1/heavy of the rows, so the broadcast has a fixed bound.
    """
    total = index.agg(F.sum("group_size")).first()[0] or 0
    limit = max(total // heavy, 1000)
    large = index.filter(F.col("group_size") > limit).withColumn("large", F.lit(True))
    marked = rows.join(F.broadcast(large), "text_sha256", "left")
    hot = marked.filter("large").drop("large")
    rest = marked.filter("large is null").select(*rows.columns)
    return hot.unionByName(rest.join(index, "text_sha256"))


def report(spark: SparkSession, docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size (of this call), kept, text_sha256; the index grows by the new digests."""
    rows = digests(docs, id_col, text_col)
    found = registered(rows, index, n_batches)
    sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialise(found.join(sizes, "text_sha256"), "groups")
    rows = with_group(rows, groups)
    kept = F.col("old").isNull() & (F.col("row") == F.col("keep_row"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES) -> DataFrame:
    """The rows of docs, with all their columns, that stay. Only kept rows find their pair, so no key is hot."""
    found = registered(digests(docs, id_col, text_col), index, n_batches).filter("old is null")
    keep = found.select(F.col("text_sha256").alias("__keep_digest"), F.col("keep_id").alias("__keep"), "n_keep")
    rows = packed(docs).select("__row", F.col(f"__row.{id_col}").alias("__id"), digest_of(f"__row.{text_col}").alias("__digest"))
    hit = rows.join(keep, (F.col("__digest") == F.col("__keep_digest")) & F.col("__id").eqNullSafe(F.col("__keep")))
    hit = hit.select("__row", "__digest", "n_keep")
    once = hit.filter("n_keep = 1").select("__row.*")
    tied = hit.filter("n_keep > 1").groupBy("__digest").agg(F.first("__row").alias("__row")).select("__row.*")
    return once.unionByName(tied)

"""Readers of the corpus tables. Schemas are read from Parquet; columns and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


SMALL = 64 << 20  # bytes of files for each core


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def spread(df: DataFrame) -> DataFrame:
    """A table of a few small files, which few tasks would read, is dealt out over all cores; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores) if bytes_of(df) < SMALL * cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages: page_id, url, html."""
    return read_table(spark, sf_dir, "pages")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")

"""Symbols and emoji by category, from ranges of code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last code points of each category, in the order of their lists.
CATEGORIES = {
    "human": [(0x1F466, 0x1F487)], "animal": [(0x1F400, 0x1F43E)], "food": [(0x1F345, 0x1F37B)], "time_region": [(0x1F550, 0x1F567), (0x1F300, 0x1F320)],
    "game": [(0x1F3A0, 0x1F3C4)], "items": [(0x1F4A0, 0x1F4F7)], "symbol_marks": [(0x2600, 0x26FF)], "flags": [(0x1F1E6, 0x1F1FF)], "standard": [(0x2010, 0x2027), (0x3001, 0x3007)],
    "parentheses": [(0x3008, 0x3011), (0x3014, 0x301B)], "arrows": [(0x2190, 0x21FF)], "math": [(0x2200, 0x22FF)], "numbers": [(0x2460, 0x24FF)], "images": [(0x25A0, 0x25FF)], "full_width": [(0xFF01, 0xFF5E)],
}


def text_of(codes: str | Column) -> Column:
    """The text of an array of code points."""
    c = F.col(codes) if isinstance(codes, str) else codes
    return F.decode(F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), "")), "UTF-32")


def symbols(spark: SparkSession, category: str | None = None) -> DataFrame:
    """category, rank, text."""
    rows = [(c, lo, hi) for c, spans in CATEGORIES.items() if category in (None, c) for lo, hi in spans]
    codes = spark.createDataFrame(rows, "category string, lo int, hi int")
    lists = codes.groupBy("category").agg(F.flatten(F.transform(F.collect_list(F.struct("lo", "hi")), lambda x: F.sequence(x["lo"], x["hi"]))).alias("codes"))
    return lists.select("category", F.posexplode(F.array_sort("codes")).alias("rank", "code")).select("category", "rank", text_of(F.array("code")).alias("text"))


def split_stream(codes: str | Column) -> Column:
    """Texts of a stream of code points, each of them ended by a zero; an empty one ends the stream."""
    texts = F.split(text_of(codes), "\0")
    return F.slice(texts, F.lit(1), F.array_position(F.concat(texts, F.array(F.lit(""))), "").cast("int") - 1)

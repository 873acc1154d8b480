"""Text and table files: n-gram and phrase lists, lexicons, generations, settings."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.operators import lexicon


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that the driver and all executors see: below spark.checkpoint.dir. Where that is unset, a temporary folder in
    local mode; on a cluster it has to be set."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="textlattice-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/textlattice/{name}"


#: Whether Spark deletes the shuffles of a write as soon as it has ended.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, one part per value of `by`, so that several uses count it once."""
    return written_parts([df], name, by)


def written_parts(parts: Iterable[DataFrame], name: str, by: str | None = None) -> DataFrame:
    """All parts, frames of one schema, as one table in the shared folder. They are made one after another, and the shuffles of each are gone before
    the next one begins, so that no more than those of one part are on disk."""
    path, df = "", None
    for df in parts:
        spark = df.sparkSession
        path = path or shared_path(spark, f"{name}-{uuid.uuid4().hex}")
        before = spark.conf.get(_RELEASE, None)
        spark.conf.set(_RELEASE, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a written table."""
    for f in df.inputFiles()[:1]:
        top = f.split("/textlattice/", 1)
        fs, at = _fs(spark, f"{top[0]}/textlattice/{top[1].split('/', 1)[0]}")
        fs.delete(at, True)


def write_ngrams(ngrams: DataFrame, path: str) -> None:
    """ngrams (n, gram, cnt): tab-separated files per order, by falling count."""
    ngrams.select("n", "cnt", "gram").repartitionByRange("n", F.desc("cnt"), "gram").sortWithinPartitions("n", F.desc("cnt"), "gram").write.partitionBy("n").option("sep", "\t").mode("overwrite").csv(path)


def read_ngrams(spark: SparkSession, path: str, divide: int = 1, lower: int | None = None) -> DataFrame:
    """Counts divided in whole numbers on the way in; what falls to zero goes."""
    rows = spark.read.option("sep", "\t").schema("cnt long, gram string, n int").csv(path)
    rows = rows.withColumn("cnt", F.expr(f"cnt div {int(divide)}")).filter("cnt > 0").select("n", "gram", "cnt")
    return rows if lower is None else rows.filter(F.col("cnt") >= lower)


def write_phrases(phrases: DataFrame, path: str) -> None:
    phrases.select("gram", "disc").orderBy(F.desc("disc"), "gram").write.option("sep", "\t").mode("overwrite").csv(path)


def read_phrases(spark: SparkSession, path: str, lower: int = 0) -> DataFrame:
    rows = spark.read.option("sep", "\t").schema("gram string, disc long").csv(path)
    return rows.filter(F.col("disc") >= lower).withColumn("words", F.split("gram", " "))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Token records of all CSV files of a folder: display, reading, pos."""
    token = spark.read.text(path).select(lexicon.parse_token("value").alias("t")).filter("t is not null")
    return token.select("t.display", F.col("t.reading").alias("reading"), lexicon.normalize_pos("t").alias("pos"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's whole generations, rising: those whose writing has ended."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    found = [n for n in names if re.fullmatch(r"generation-\d+", n) and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.rsplit("-", 1)[1]) for n in found)


def replace_table(df: DataFrame, path: str, generations: int = 3) -> None:
    """Write the next generation beside the others, which stay readable; then the oldest ones go. For one writer at a time."""
    spark = df.sparkSession
    number = max(table_generations(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/generation-{number}")
    for old in table_generations(spark, path)[:-generations]:
        fs, at = _fs(spark, f"{path}/generation-{old}")
        fs.delete(at, True)


class StaleWriter(RuntimeError):
    """A writer that started from a generation which isn't the last one any more, or while another one writes."""


def replace_if_current(df: DataFrame, path: str, seen: int | None, generations: int = 3) -> int:
    """Write the next generation only if the last one is still `seen` (None: there was none), the one that df was made from.

    A writer claims the next number by creating a file, which only one can; all others are refused, during its work and
    after it. A claim whose writer failed is taken back; one whose writer was killed stays until `release`.
    """
    spark = df.sparkSession
    last = max(table_generations(spark, path), default=0)
    if last != (seen or 0):
        raise StaleWriter(f"generation {last} of {path} is newer than {seen}")
    fs, claim = _fs(spark, f"{path}/claim-{last + 1}")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise StaleWriter(f"another writer has claimed generation {last + 1} of {path}") from e
    try:
        if max(table_generations(spark, path), default=0) != last:
            raise StaleWriter(f"generation {last + 1} of {path} was written meanwhile")
        replace_table(df, path, generations)
    except BaseException:
        fs.delete(claim, False)
        raise
    for old in range(max(1, last + 1 - generations), last + 1):
        fs.delete(_fs(spark, f"{path}/claim-{old}")[1], False)
    return last + 1


def release(spark: SparkSession, path: str) -> None:
    """Take back the claims of writers that were killed."""
    fs, at = _fs(spark, path)
    last = max(table_generations(spark, path), default=0)
    for f in fs.listStatus(at) if fs.exists(at) else []:
        name = f.getPath().getName()
        if re.fullmatch(r"claim-\d+", name) and int(name[6:]) > last:
            fs.delete(f.getPath(), False)


def current_table(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The last whole generation of a table, or one `back` generations before it."""
    return spark.read.parquet(f"{path}/generation-{table_generations(spark, path)[-1 - back]}")


def lattice_log(edges: DataFrame, best: DataFrame) -> DataFrame:
    """What a conversion has seen and chosen: s, lattice (its edges as JSON), cost, path. To be appended to a log table."""
    rows = edges.groupBy("s").agg(F.to_json(F.array_sort(F.collect_list(F.struct("top", "end", "reading", "pos", "cost")))).alias("lattice"))  # one string's edges
    return rows.join(best.select("s", F.col("cost"), "path"), "s").select("s", "lattice", "cost", "path")


def setting(settings: dict[str, dict[str, str]], section: str, key: str, default: str | int | float | bool) -> str | int | float | bool:
    """A value with the type of the default, which stands for one that is missing or can't be read."""
    text = settings.get(section, {}).get(key)
    if text is None:
        return default
    if isinstance(default, bool):
        return text.lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(text)
    except ValueError:
        return default


def expand_path(value: str, places: dict[str, str]) -> str:
    """The value with the first `%Name%` of the first place that it names."""
    for name, at in places.items():
        if f"%{name}%" in value:
            return value.replace(f"%{name}%", at, 1)
    return value


def parse_settings(*texts: str) -> dict[str, dict[str, str]]:
    """Sections of keys and values; later texts win. `;` starts a comment, a backslash at a line's end goes on."""
    out: dict[str, dict[str, str]] = {}
    for text in texts:
        section = ""
        joined = re.sub(r"\\[ \t]*\r?\n[ \t]*", "", text.lstrip("﻿"))
        for line in joined.splitlines():
            line = line.split(";", 1)[0].strip()
            if line.startswith("[") and line.endswith("]"):
                section = line[1:-1].strip()
            elif "=" in line:
                key, value = line.split("=", 1)
                out.setdefault(section, {})[key.strip()] = value.strip()
    return out

"""Documents with everything that can go wrong, and a schema whose further columns clash with working names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, h int, size int, m int, fp int, rank int, length int, label int, shard int, __row int"
CLASH = ("x", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *CLASH)


def words(n: int, seed: int, kinds: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


PASSAGE = words(60, 1)
ODD = [
    row(1, words(300, 2)),
    row(2, None),
    row(3, ""),
    row(4, " \t\n\r\x0b\x0c "),
    row(5, "one"),
    row(6, "one"),
    row(7, " one\n"),
    row(7, " one\n"),
    row(None, "one"),
    row(None, None, None, None),
    row(8, words(20, 3) + " " + PASSAGE + " " + words(30, 4), None, "b"),
    row(9, PASSAGE + " " + words(10, 5), "fr", None),
    row(10, "Ünïcödé <s> </s> <unk> <|endoftext|> 漢字かな 👍🏽 \x85 \u00a0 ▁ ▁▁x \u2028y \x00z", "de", "b"),
    row(11, "loop " * 30_000, "en", "b"),
    row(12, words(300, 2)[:-1] + "X"),
    row(13, "a" * 100_000),
    row(14, "\n\n\n  \n x  y   z \n"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)

"""the parts of speech without regular expressions, and the steps that use them."""

import re

from pyspark.sql import functions as F

from textlattice.functions import text as T
from textlattice.plans import counts, decoding

RULES = (("num", "^[0-9]"), ("func", "^.{0,2}\\Z"), ("verb", "(ing|ed|er|en)\\Z"), ("noun", "(tion|heit|keit|ment|dad)\\Z"), ("mod", "(ly|lich|eux|oso)\\Z"))


def test_parts_of_speech(spark):
    words = ["", "0", "9zz", "/ab", ":ab", "ab", "abc", "ing", "sing", "bed", "ingx", "nation", "freiheit", "édad", "only", "oso", "÷oso", "١٢٣x", "[BOS]"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.pos_of("w").alias("p"), T.is_number("w").alias("n")).collect()
    assert {r["w"]: r["p"] for r in got} == {w: next((p for p, x in RULES if re.search(x, w)), "other") for w in words}
    assert all(r["n"] == bool(re.match("[0-9]", r["w"])) for r in got)
    none = spark.range(1).select(F.lit(None).cast("string").alias("w")).select(T.pos_of("w")).first()[0]
    assert none == "other"


def test_documents_counted_once(spark, smoke):
    """Bigrams and words that several steps need are read from a written table, not counted anew."""
    for query, most in ((counts.word_trigram_backoff, 1), (decoding._costs, 3)):
        plan = query(spark, smoke)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [doc_id") <= most, plan

import hashlib
import re

import corpus_pipeline
from textlattice.llm import mixing, queries
from tests.llm import cases
from tests.llm.test_simhash import linked_near, plain_components, plain_sketch


def test_stages_one_by_one(spark, smoke, tmp_path):
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, smoke).write.parquet(str(tmp_path / str(k)))
        docs_after = spark.read.parquet(str(tmp_path / str(k)))
        after = [r.asDict() for r in docs_after.collect()]
        ids = sorted(r["doc_id"] for r in after)
        if name != "packing":
            assert docs_after.columns == docs.columns and {repr(r) for r in after} <= {repr(r) for r in before}
        if name == "quality":
            good = {r["doc_id"] for r in queries.op3_quality(spark, smoke).filter("kept").collect()}
            assert ids == sorted(good)
        elif name == "exact_dedup":
            low = {}
            for r in before:
                h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).digest()
                low[h] = min(low.get(h, r["doc_id"]), r["doc_id"])
            assert ids == sorted(low.values())
        elif name == "near_dedup":
            rows = [(r["doc_id"], plain_sketch(r["text"])) for r in before]
            assert ids == sorted(set(plain_components(rows, linked_near)))
        elif name == "mixing":
            assert len(ids) == sum(r["times"] for r in mixing.mix(docs).collect())
        elif name == "packing":
            assert {r["doc_id"] for r in before} == set(ids) and max(r["offset"] + r["length"] for r in after) <= 1024
        docs = docs_after


def test_odd_rows_through_all_stages(spark, smoke):
    for docs in (cases.odd(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, smoke)
        docs.collect()


def test_run(spark, smoke):
    assert corpus_pipeline.run(spark, smoke).count() > 0

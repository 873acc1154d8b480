import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlattice.llm import packing, queries
from tests.llm import cases

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = packing.Encoder(packing.prove(VOCABULARY))


def check(got, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, texts_of in texts.items():
        want = []
        for t in texts_of:
            ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            total += len(ids)
            edges = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(want)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) <= -(-total // 1024) * 1.03 + 1 and by_doc.keys() == texts.keys()


def test_whole_table(spark, smoke):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()}
    check(queries.op9_best_fit_packing(spark, smoke).collect(), texts)


def test_odd_rows(spark):
    texts = defaultdict(list)
    for i, t, *_ in cases.ODD:
        texts[i].append(t)
    check(packing.pack(spark, cases.odd(spark), VOCABULARY).collect(), texts)
    assert packing.pack(spark, cases.empty(spark), VOCABULARY).collect() == []


def test_equal_rows_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(None, "one two") for _ in range(5000)], "doc_id long, text string")
    got = packing.pack(spark, docs, VOCABULARY)
    rows = got.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 5000
    length = rows[0]["length"]
    assert len({r["sequence_id"] for r in rows}) == -(-5000 // (1024 // length))
    pieces = packing.pieces(docs, VOCABULARY)
    counts = spark.createDataFrame([(length, 5000)], "length long, n long")
    sizes = [r["count"] for r in packing.ranked(pieces, counts).groupBy("part").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 2 * packing.GROUP


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sté1½²\x85\xa0\u2003\x1c\x1d|<>"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text_against_the_library(text):
    assert np.frombuffer(ENCODER.ids(text), dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_plan_is_gapless_and_as_tight_as_documents_one_by_one():
    r = random.Random(1)
    for _ in range(20):
        capacity = 50
        histogram = {r.randrange(1, capacity + 1): r.randrange(1, 40) for _ in range(12)}
        steps = packing.plan(histogram, capacity)
        places = defaultdict(list)
        for length, lo, hi, first, offset in steps:
            for k in range(hi - lo):
                places[first + k].append((offset, length))
        assert sum(len(p) for p in places.values()) == sum(histogram.values())
        for p in places.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= capacity
        room = []
        for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            fit = [k for k, left in enumerate(room) if left >= length]
            if fit:
                room[min(fit, key=lambda k: room[k])] -= length
            else:
                room.append(capacity - length)
        assert len(places) <= len(room)

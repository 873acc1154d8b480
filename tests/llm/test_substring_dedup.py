import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from textlattice.llm import queries
from textlattice.llm import substring_dedup as S
from tests.llm import cases


def plain(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_whole_table_against_brute_force(spark, smoke):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    want = plain(texts, 35)
    assert cases.rows_of(queries.op8_substring_dedup(spark, smoke), *COLS) == want
    assert sum(r[2] for r in want) > 0


def test_odd_rows(spark):
    got = S.remove_repeats(cases.odd(spark))
    assert cases.rows_of(got, *COLS) == plain([r[:2] for r in cases.ODD], 35)
    assert S.remove_repeats(cases.empty(spark)).collect() == []


def test_small_windows_in_small_shards(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for k in range(80)]
    rows += [(100 + k, "p q r s t u v w x y " * r.randrange(4)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.remove_repeats(docs, window=7, gram=3, shard=50)
    assert cases.rows_of(got, *COLS) == plain(rows, 7)


def test_heavy_minimizers(spark):
    r = random.Random(10)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, f"{cases.words(20, k)} {passage} {cases.words(20, 7000 + k)}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cases.rows_of(S.remove_repeats(docs), *COLS) == plain(rows, 35)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 6))
def test_index_against_brute_force(segments, window):
    weights = np.array([1 + k % 2 for k in range(len(segments))])
    index = S.FMIndex([np.array(s, dtype=np.uint64) for s in segments], weights)
    seg, at = index.repeated(np.arange(len(segments)), window)
    seen = Counter()
    for s, n in zip(segments, weights.tolist(), strict=True):
        for k in range(len(s) - window + 1):
            seen[tuple(s[k : k + window])] += n
    want = {(j, k) for j, s in enumerate(segments) for k in range(len(s) - window + 1) if seen[tuple(s[k : k + window])] > 1}
    assert set(zip(seg.tolist(), at.tolist(), strict=True)) == want

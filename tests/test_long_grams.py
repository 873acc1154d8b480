"""long orders go through the shuffle as runs of windows with one mark; counts are those of single windows."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from textlattice.operators import ngrams as N


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_runs_hold_all_windows(n):
    r = random.Random(n)
    docs = [[r.choice("abcd") for _ in range(r.randrange(0, 40))] if r.random() < 0.9 else None for _ in range(60)]
    rows = N._marked(pa.array(docs, pa.list_(pa.string())), n, max(2, (n - 1) // 2)).to_pydict()
    got, marks = Counter(), {}
    for mark, words, cnt in zip(rows["mark"], rows["words"], rows["n"], strict=True):
        w = words.split(" ")
        for i in range(len(w) - n + 1):
            gram = " ".join(w[i : i + n])
            got[gram] += cnt
            assert marks.setdefault(gram, mark) == mark
    assert got == Counter(" ".join(d[i : i + n]) for d in docs if d for i in range(len(d) - n + 1))


def test_fewer_words_than_windows():
    docs = [["w" + str(k) for k in range(5000)]]
    rows = N._marked(pa.array(docs, pa.list_(pa.string())), 7, 3).to_pydict()
    assert sum(len(w.split(" ")) for w in rows["words"]) < 0.55 * 7 * 4994


def test_counts_are_equal(spark):
    docs = [(["a", "b", "c", "d", "e"] * 3,), (["a", "b", "c", "d", "e"],), ([],), (["x"],)]
    s = spark.createDataFrame(docs, "words array<string>")
    for n in (4, 7):
        assert sorted(map(tuple, N.count_long(s, n).collect())) == sorted(map(tuple, N.count_ngrams(s, n).collect()))

import functools
import random
import re

import numpy as np
import xxhash

from textlattice.llm import queries, simhash
from textlattice.llm.substring_dedup import WordHash, gram_hashes, mixed
from tests.llm import cases


def plain_fingerprint(text, shingle=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(fps, a):
    return np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 4) + a + 1


def linked_near(fps, a):
    """For rows of the words' fingerprint and four longs of the shingles'."""
    d = np.bitwise_count(fps[a + 1 :] ^ fps[a])
    return np.flatnonzero((d[:, 0] <= 6) & (d[:, 1:].sum(axis=1, dtype=int) <= 44)) + a + 1


@functools.cache
def hashed(word):
    return int(WordHash().of(word)[0])


def plain_sketch(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return [0] * 5
    grams = [words[k : k + 5] for k in range(len(words) - 4)] or [words]
    grams = {int(gram_hashes(np.array([hashed(w) for w in g], dtype=np.uint64), len(g))[0]) for g in grams}
    out = []
    for salt, kinds in enumerate([{hashed(w) for w in words}, grams, grams, grams, grams]):
        h = [int(mixed(np.array([x], dtype=np.uint64) + np.uint64(1000 * salt))[0]) for x in kinds]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def plain_components(rows, linked=linked):
    ids, fps = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in linked(fps, a):
            label[find(a)] = find(int(b))
    low = {}
    for k, i in enumerate(ids):
        low.setdefault(find(k), []).append(i)
    return [min((i for i in low[find(k)] if i is not None), default=None) for k in range(len(rows))]


def check(got, texts):
    rows = [(i, plain_fingerprint(t)) for i, t in texts]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, plain_components(rows), strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == want


def test_whole_table_against_brute_force(spark, smoke):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    check(queries.op5_simhash(spark, smoke), texts)


def test_odd_rows(spark):
    check(simhash.near_duplicates(cases.odd(spark)), [r[:2] for r in cases.ODD])
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []
    kept = simhash.survivors(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 12 not in ids and 3 not in ids
    assert simhash.survivors(cases.empty(spark)).collect() == []


def test_chains_and_large_groups_in_small_tiles(spark):
    r = random.Random(4)
    fps = []
    for _ in range(40):  # chains in which each step changes up to four bits
        x = r.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    base = r.getrandbits(64)
    fps += [base ^ (r.getrandbits(64) & 0x7F) for _ in range(200)] + [0, 1, (1 << 64) - 1]
    fps = sorted(set(fps))
    rows = list(enumerate(fps))
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long").repartition(4)
    first = df.select("fp")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(first, tile=16)).collect()}
    same = {}
    for (k, fp), c in zip(signed, plain_components(rows), strict=True):
        same.setdefault(c, set()).add(roots.get(fp, fp))
    assert all(len(v) == 1 for v in same.values()) and len({*map(min, same.values())}) == len(same)


def test_each_component_keeps_one_row(spark):
    a, b, c, d = (cases.words(80, k, 5000) for k in (21, 22, 23, 24))
    rows = [(5, a), (5, b), (9, b), (12, b), (None, c), (None, c), (None, d), (None, a)]
    kept = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(5, a), (5, b), (None, c), (None, d)], key=repr)


def test_sketches_against_plain_loops(spark):
    rows = [(k, t) for k, (_, t, *_) in enumerate(cases.ODD) if len(t or "") < 5000]
    rows += [(len(rows), cases.words(90, 3, 40)), (len(rows) + 1, "A b\tC\u00c4 \u00e4 d")]
    got = simhash.sketches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("fp").collect()
    want = [(k, *[x - (1 << 64) if x >> 63 else x for x in plain_sketch(t)]) for k, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def edited(words, n, r):
    """The words with n of them replaced, and the share of five-word shingles that both have."""
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"{out[k]}x"
    return out, similarity(shingles(words), shingles(out))


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_edited_copies_are_dropped_and_others_stay(spark, smoke):
    r = random.Random(8)
    texts = [t["text"] for t in simhash.survivors(spark.read.parquet(f"{smoke}/documents.parquet")).collect()]
    texts = [t for t in texts if 80 <= len((t or "").split()) <= 3000]
    apart = [shingles(t.split()) for t in texts]
    texts = [t for k, t in enumerate(texts) if all(k == j or similarity(apart[k], w) < 0.5 for j, w in enumerate(apart))]
    rows, copies = list(enumerate(texts)), {}
    for k, t in rows[:]:
        words = t.split()
        out, similar = edited(words, max(1, len(words) // 70), r)
        if similar >= 0.82:
            copies[10_000 + k] = similar
            rows.append((10_000 + k, " ".join(out)))
    kept = {d["doc_id"] for d in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(copies) > 40 and set(range(len(texts))) <= kept
    assert len(copies.keys() - kept) >= 0.9 * len(copies)

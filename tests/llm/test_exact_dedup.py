import hashlib
import re
import uuid

from textlattice.llm import exact_dedup
from tests.llm import cases


def index(spark):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")


def plain(rows):
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        once = iter([True])
        out += [(i, keep, len(ids), i == keep and next(once, False), h) for i in ids]
    return sorted(out, key=repr)


def test_odd_rows(spark):
    got = exact_dedup.report(spark, cases.odd(spark), index(spark))
    assert cases.rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain([r[:2] for r in cases.ODD])
    assert exact_dedup.report(spark, cases.empty(spark), index(spark)).collect() == []


def test_second_batch_meets_the_index(spark):
    own = index(spark)
    a = spark.createDataFrame([(5, "x 1"), (6, "x \n 1"), (7, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x 1"), (2, "z"), (3, "z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(a, own).collect()) == [5, 7]
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(b, own).collect()) == [2]
    assert own.table().count() == own.table().select("text_sha256").distinct().count()


def test_batches_meet_in_the_anti_join(spark):
    rows = [(k, f"t{(k * 7) % 60}") for k in range(100)] + [(None, "t1"), (None, "new"), (3, "t21"), (3, "t21")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (1, 2, 5):
        got = exact_dedup.report(spark, docs, index(spark), n_batches=n)
        assert cases.rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(rows)
    own = index(spark)
    own.table()
    plans = []
    real = exact_dedup.DigestIndex._append
    own._append = lambda rows: (plans.append(rows._jdf.queryExecution().toString()), real(own, rows))
    exact_dedup.survivors(docs, own)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "LeftAnti" in p for p in plans)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], "doc_id string, text string")
    own = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", id_type="string")
    assert sorted(r["doc_id"] for r in exact_dedup.survivors(docs, own).collect()) == ["a", "c"]


def test_heavy_digests(spark):
    rows = [(k, "hot") for k in range(3000)] + [(k, f"t{k % 500}") for k in range(3000, 4000)]
    got = exact_dedup.report(spark, spark.createDataFrame(rows, "doc_id long, text string"), index(spark))
    assert cases.rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(rows)


def test_survivors_keep_all_columns(spark):
    docs = cases.odd(spark)
    kept = exact_dedup.survivors(docs, index(spark))
    want = [r for r in plain([r[:2] for r in cases.ODD]) if r[3]]
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in want), key=repr)


def test_a_bucket_is_one_file_of_a_batch(spark, monkeypatch):
    kind = type(spark.range(0))
    for name in ("repartition", "repartitionByRange"):  # more tasks than buckets
        monkeypatch.setattr(kind, name, lambda self, n, *by, f=getattr(kind, name): f(self, max(n, 24), *by))
    docs = spark.createDataFrame([(k, f"t{k % 300}") for k in range(600)], "doc_id long, text string")
    own = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=8)
    assert exact_dedup.survivors(docs, own, n_batches=2).count() == 300
    assert own.table().count() == 300 and len(own.table().inputFiles()) <= 16

import random
from hashlib import sha256

from pyspark.sql import functions as F

from siltstone.llm import substring_dedup as op
from tests.llm.fixtures import REAL, awkward, empty


def brute(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df, **kw):
    got = op.substring_dedup(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()], kw.get("window", 50))
    assert sorted(map(tuple, got), key=str) == want
    return want


def test_real_rows(spark):
    df = spark.read.parquet(f"{REAL}/documents.parquet")
    assert sum(r[2] > 0 for r in check(df.repartition(5))) > 3
    check(df, window=21, block=11)


def test_awkward_rows(spark):
    df = awkward(spark)
    df = df.unionByName(df.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    assert any(r[2] for r in check(df))
    assert op.substring_dedup(empty(spark)).count() == 0


def test_shared_passages_at_all_offsets(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + str(rnd.randrange(30))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 74, 75, 130)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages)
            at = rnd.randrange(0, 12)
            w += p[at:] if rnd.random() < 0.5 else p
            w += [word() for _ in range(rnd.randrange(0, 40))]
        rows.append((rnd.randrange(1000), " ".join(w)))
    rows += [(2000 + i, "same same " * 60) for i in range(5)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_packed_ids():
    import numpy as np

    for ids in ([5], [-3, 0, 9], [1, 2, 1 << 40], [-(1 << 62), 1 << 62], list(range(100))):
        assert op._unpack_ids(op._pack_ids(np.array(ids, np.int64))).tolist() == ids


def test_ids_that_are_no_integers(spark):
    """Strings are numbered in their order: b is before c, whatever the rows' order."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [("c", "x y " + passage), ("b", passage + " z"), ("a", "q"), (None, passage), ("d", None), ("c", "tail " + passage)]
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id string, text string").repartition(n)
        got = sorted((r.doc_id or "", r.n_words, r.n_removed, r.kept_text) for r in op.substring_dedup(df).collect())
        assert got == [("", 60, 0, passage), ("a", 1, 0, "q"), ("b", 61, 0, passage + " z"), ("c", 61, 60, "tail"), ("c", 62, 60, "x y"), ("d", 0, 0, "")]


def test_long_texts_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(op, "PART_BYTES", 1 << 16)
    long = " ".join(f"w{i}" for i in range(160_000))
    assert len(long) > 1 << 20
    cut = " ".join(f"w{i}" for i in range(70_000, 70_100))
    rows = [(1, long), (2, f"a b {cut} c"), (3, "a b c"), (4, long[:-1] + "x")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in op.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (160_000, 0), 2: (103, 100), 3: (3, 0), 4: (160_000, 159_999)}

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import mixing as op
from tests.llm.fixtures import REAL, awkward, empty


def brute(sizes, weights, cap=3):
    """Share, clamp, share the rest again, until none is above its cap."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        all_w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / all_w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / all_w for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def dealt(sources):
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def check(df):
    rows = op.sized(df)
    first = sorted((tuple(r) for r in op.take(rows, op.plan(rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)
    assert first == sorted((tuple(r) for r in op.take(rows, op.plan(rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)
    assert len(first) == df.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, n, _, _, t in first:
        sizes[s] += n
        taken[s] += t
        assert 0 <= t <= 3 * n
    want = brute(sizes, dealt(sizes)) if sizes else {}
    for _, s, _, whole, target, _ in first:
        assert whole == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return first


def test_real_rows(spark):
    check(spark.read.parquet(f"{REAL}/documents.parquet"))


def test_caps_and_awkward_rows(spark):
    df = spark.read.parquet(f"{REAL}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, "a").when(F.col("doc_id") % 9 == 1, "b").when(F.col("doc_id") == 5, "c").otherwise("z").alias("source"))
    assert any(abs(t - 3 * whole) < 1e-9 for _, _, _, whole, t, _ in check(df))
    check(awkward(spark).withColumn("doc_id", F.when(F.col("doc_id") % 4 != 1, F.col("doc_id"))))
    check(empty(spark))
    check(awkward(spark).where("doc_id IN (4, 5, 6)"))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_water_fill(spark, sizes):
    named = {chr(97 + i): n for i, n in enumerate(sizes)}
    if not sum(sizes):
        return
    rows = [(s, n, float(w)) for (s, n), w in zip(named.items(), dealt(named).values(), strict=True)]
    got = {r.source: r.target for r in op.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}
    want = brute(named, dealt(named))
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixed_table(spark):
    df = spark.read.parquet(f"{REAL}/documents.parquet")
    out = op.mixing(df)
    assert out.columns == df.columns
    words = out.withColumn("n", F.size(op.words(F.col("text")))).groupBy("source").agg(F.sum("n").alias("n")).collect()
    sizes = {r.source: r.n for r in df.withColumn("n", F.size(op.words(F.col("text")))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    want = brute(sizes, dealt(sizes))
    assert all(abs(r.n - want[r.source]) < 0.25 * want[r.source] + 500 for r in words)
    clash = op.mixing(awkward(spark))
    assert clash.columns == awkward(spark).columns and {(r.size, r.target) for r in clash.collect()} == {("clash", "clash")}


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 250_000, "a"), (2, "x " * 100, "b"), (3, "", "b")], "doc_id long, text string, source string")
    rows = check(df)
    assert max(n for _, _, n, _, _, _ in rows) == 250_000

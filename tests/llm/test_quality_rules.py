import math
import re
from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm.quality_rules import RULES, allowed_rejections, cutoffs, quality_rules
from tests.llm.fixtures import REAL, awkward, empty, megabyte

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def compare(df, out):
    texts = sorted((r.doc_id, r.text or "") for r in df.collect())
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = sorted((d, *(b := brute(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for d, t in texts)
    assert got == want


def test_measures_of_real_rows(spark):
    df = spark.read.parquet(f"{REAL}/documents.parquet")
    labels = spark.read.parquet(f"{REAL}/labels.parquet")
    out = quality_rules(df, labels)
    compare(df, out)
    assert out.where("base_failed AND kept").count() == 0


def test_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (13, 0), (13, 1)], "doc_id long, quality int")
    compare(df, quality_rules(df, labels))
    assert quality_rules(empty(spark), labels).count() == 0
    assert quality_rules(df, labels.limit(0)).where("kept = base_failed").count() == 0


def test_exact_binomial_limit(spark):
    for n, rate, risk in ((10, 0.1, 0.3), (100, 0.05, 0.01), (3000, 0.02, 0.001), (20, 0.05, 0.05)):
        cdf, want = 0.0, -1
        for k in range(n + 1):
            cdf += math.comb(n, k) * rate**k * (1 - rate) ** (n - k)
            if cdf > risk:
                break
            want = k
        assert spark.range(1).select(allowed_rejections(F.lit(n).cast("long"), rate, F.lit(risk)).alias("k")).first()["k"] == want


def test_guarantee_holds_on_fresh_rows(spark):
    """Cutoffs from one half keep the false rejections in the other half near alpha; without enough labels none is made."""
    rows = spark.range(8000).select(
        F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("stratum"),
        (F.rand(3) < 0.8).alias("good"),
        *[F.floor(F.rand(10 + i) * 500).cast("int").alias(r) for i, r in enumerate(RULES)],
        F.col("id"),
    )
    rows = rows.withColumn("bangs", F.when(F.col("good"), F.col("bangs")).otherwise(F.col("bangs") + 450).cast("int")).cache()
    table = {(r.stratum, r.rule): r.cutoff for r in cutoffs(rows.where("id < 4000")).collect()}
    assert ("s", "bangs") in table and ("t", "bangs") in table
    for s in "st":
        fresh = [r for r in rows.where(f"id >= 4000 AND good AND stratum = '{s}'").collect()]
        wrong = sum(any(r[x] > table.get((s, x), 10**9) for x in RULES) for r in fresh)
        assert wrong <= 0.07 * len(fresh)
    assert cutoffs(rows.where("id < 40")).count() == 0


def test_long_texts(spark):
    text = megabyte()
    rows = [(1, text, "en"), (2, "line of words # $\n" * 60_000, "en"), (3, "short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    compare(df, quality_rules(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))

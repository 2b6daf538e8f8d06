import hashlib
import re

from pyspark.sql import functions as F

from siltstone.llm.decontamination import clean, decontamination
from tests.llm.fixtures import REAL, awkward, empty, megabyte

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def check(docs, items):
    out = decontamination(docs, items)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(got, key=str) == want
    return want


def test_real_rows(spark):
    want = check(spark.read.parquet(f"{REAL}/documents.parquet"), spark.read.parquet(f"{REAL}/benchmark.parquet"))
    assert any(r[5] for r in want)


def test_awkward_rows_and_short_items(spark):
    docs = awkward(spark)
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    long = docs.where("doc_id = 9").first().text.split()
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[700:707])), (3, "ONE"), (4, None), (5, ""), (6, "x-y x"), (7, " ".join(long[-10:])), (7, "nowhere to be found " * 5), (8, " ".join(long[:11]))]
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("clash"))
    assert sum(r[5] for r in check(docs, items)) >= 4
    check(empty(spark), items)
    check(docs, items.limit(0))
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) if r[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in bad), key=str)


def test_long_texts(spark):
    text = megabyte()
    w = text.split()
    docs = spark.createDataFrame([(1, text), (2, " ".join(w[500:600])), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w[90_000:90_030])), (2, " ".join(w[-10:])), (3, " ".join(w[505:525]))], "item_id long, text string")
    assert {r[0]: r[2:4] for r in check(docs, items)}[1][0] >= 60


def test_many_items_with_the_same_windows(spark):
    """Items that share windows, in documents that hold many of them: each document's items are the union, once."""
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i, f"{shared} own{i} " + " ".join(f"o{i}x{j}" for j in range(12))) for i in range(60)]
    docs = [(1, shared), (2, f"{shared} {shared}"), (3, items[7][1]), (4, " ".join(items[9][1].split()[31:]))]
    want = check(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r[3] for r in want] == [60, 60, 60, 1]

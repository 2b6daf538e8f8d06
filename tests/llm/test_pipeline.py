import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from siltstone.llm import language_id
from siltstone.llm.shared import stored
from tests.llm.fixtures import REAL, awkward, empty, megabyte
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_minhash_dedup import brute as near
from tests.llm.test_mixing import brute as brute_targets
from tests.llm.test_mixing import dealt
from tests.llm.test_sharding import reference_tree


#: Id of a text of a megabyte in no language that is learned.
LONG = 99


def kept_by_near(rows):
    """Ids that stay: of each group of rows linked by similarity or by an equal id, the least."""
    numbers = list(range(len(rows)))
    group = {n: c for n, _, c, _ in near([(i, r.text) for i, r in enumerate(rows)], 5)}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    by_id = {}
    for i in numbers:
        j = by_id.setdefault(rows[i].doc_id, i)
        a, b = find(i), find(j)
        group[max(a, b)] = min(a, b)
    least = {}
    for i in numbers:
        least[find(i)] = min(least.get(find(i), rows[i].doc_id), rows[i].doc_id)
    return {rows[i].doc_id for i in numbers if least[find(i)] == rows[i].doc_id}


def taken(rows):
    """How often each row is taken: targets, whole repetitions, and the rest in the seeded order."""
    sizes, words = Counter(), [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    for r, n in zip(rows, words, strict=True):
        sizes[r.source] += n
    targets, out = brute_targets(sizes, dealt(sizes)) if sizes else {}, Counter()
    for source in sizes:
        own = [(hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id, n) for r, n in zip(rows, words, strict=True) if r.source == source]
        whole = int(targets[source] // sizes[source]) if sizes[source] else 0
        rest = max(0, round(targets[source] - whole * sizes[source]))
        for _, doc, n in sorted(own, key=lambda x: (x[0], x[1] or 0, x[2])):
            part = min(n, rest)
            rest -= part
            if n:
                out[doc] += math.floor((whole * n + part) / n + 0.5)
    return +out


def check(spark, docs):
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{REAL}/benchmark.parquet").collect()]
    out = {}
    for name, stage in p.STAGES:
        before = docs.collect()
        fitted = language_id.fit(docs) if name == "language_id" else None
        docs = stored(stage(spark, docs, REAL), "test")
        rows = out[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
            assert all(r[c] == "clash" for r in rows for c in ("size", "shard", "target") if c in columns)
        ids = sorted(r.doc_id for r in rows)
        if name == "language_id":
            said = language_id.predict(fitted, [r.text for r in before])
            assert sorted((r.doc_id, r.lang or lang) for r, (lang, _, rejected) in zip(before, said, strict=True) if not rejected) == sorted((r.doc_id, r.lang) for r in rows)
            lost = [r for r in before if r.doc_id not in set(ids)]
            assert all(sum(c.isalpha() for c in r.text or "") < 12 for r in lost if r.doc_id != LONG)
        elif name == "near_dedup":
            kept = kept_by_near(before)
            assert ids == sorted(r.doc_id for r in before if r.doc_id in kept)
        elif name == "decontamination":
            bad = Counter(r[0] for r in contaminated([(r.doc_id, r.text) for r in before], items) if r[5])
            assert Counter(ids) == Counter(r.doc_id for r in before) - bad
        elif name == "mixing":
            assert Counter(ids) == taken(before)
            assert max(Counter(ids).values(), default=0) <= 3 * max(Counter(r.doc_id for r in before).values(), default=0)
        else:
            assert set(docs.columns) == {*columns, "size", "shard"}
            want = reference_tree([(r.doc_id, r.text, r.source, r.lang) for r in before], p.SHARDS)
            assert all(r.shard == want[r.text] for r in rows)
            assert Counter(ids) == Counter(r.doc_id for r in before)
    return out


def test_real_rows(spark):
    out = check(spark, spark.read.parquet(f"{REAL}/documents.parquet"))
    n = [len(v) for v in out.values()]
    assert n[0] > n[1] > n[2] > 100


def test_awkward_rows(spark):
    """Nulls, empty texts, ties, an id with two texts, a text of a megabyte, and columns with the operators' own names."""
    df = awkward(spark)
    long = df.where("doc_id = 9").withColumn("doc_id", F.lit(LONG).cast("long")).withColumn("text", F.lit(megabyte()))
    check(spark, df.unionByName(long).withColumn("score", F.lit("clash")).withColumn("rejected", F.lit("clash")))
    assert all(not v for v in check(spark, empty(spark)).values())


def test_run(spark):
    assert p.run(spark, REAL).count() > 0

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import xxhash

from pyspark.sql import functions as F

from siltstone.llm import sharding as op
from siltstone.llm.queries import op10_sharding
from siltstone.llm.sharding import _place_heavy, sharding, size_of
from tests.llm.fixtures import awkward, empty, megabyte


def check(df, shards):
    out = sharding(df.withColumn("bytes_", size_of(F.col("text"))), shards)
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r.shard < shards for r in rows)
    groups, load = defaultdict(set), Counter()
    for r in rows:
        groups[r.text].add(r.shard)
        load[r.shard] += r.bytes_
    assert all(len(g) == 1 for g in groups.values())
    return load, rows


def test_equal_bytes(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for shards in (1, 7, 16):
        load, rows = check(df, shards)
        mean = sum(load.values()) / shards
        assert len(load) == shards and max(load.values()) <= 1.1 * mean and min(load.values()) >= 0.9 * mean


def reference_tree(rows, shards):
    """The method in plain Python: {text: shard} of rows (doc_id, text, source, lang)."""
    groups = {}
    for doc, text, source, lang in rows:
        groups.setdefault(text, []).append((doc, source, lang))
    size = {t: (len((t or "").encode()) + 16) * len(g) for t, g in groups.items()}
    name = {t: "null" if t is None else hashlib.md5(t.encode()).hexdigest() for t in groups}
    total = sum(size.values())
    heavy = [t for t in groups if size[t] >= max(1.0, total / shards / 100)]
    load, out = [0] * shards, {}
    for t in sorted(heavy, key=lambda t: (-size[t], name[t])):
        out[t] = min(range(shards), key=lambda i: (load[i], i))
        load[out[t]] += size[t]
    light = [t for t in groups if t not in out]
    level, left = 0.0, sum(size[t] for t in light)
    for n in range(1, shards + 1):
        level = (left + sum(sorted(load)[:n])) / n
        if n == shards or level <= sorted(load)[n]:
            break
    wants = [max(0.0, level - x) for x in load]
    first = {t: min(d for d, _, _ in groups[t]) for t in light}
    low, span = min(first.values(), default=0), max(1, max(first.values(), default=0) - min(first.values(), default=0))
    least = lambda values: min((v for v in values if v is not None), default="\0")
    top, points = (1 << 16) - 1, {}
    for t in light:
        tie = xxhash.xxh64_intdigest(name[t].encode(), 42) >> 18
        parts = [
            min(top, math.floor(math.log2(len((t or "").encode()) + 16) * (top / 40.0))),
            math.floor((first[t] - low) / span * top),
            zlib.crc32(least(s for _, s, _ in groups[t]).encode()) >> 16,
            zlib.crc32(least(x for _, _, x in groups[t]).encode()) >> 16,
        ]
        points[t] = [(p << 46) + tie for p in parts]

    def split(own, at, wants):
        if len(wants) == 1:
            out.update(dict.fromkeys(own, at))
            return
        half = len(wants) // 2
        want = sum(wants[:half]) / max(sum(wants), 1e-9) * sum(size[t] for t in own)
        dim = max(range(4), key=lambda d: (max((points[t][d] for t in own), default=0) - min((points[t][d] for t in own), default=0), -d))
        before, left = 0, []
        for t in sorted(own, key=lambda t: points[t][dim]):
            if before < int(want) or (before == 0 and want > 0):
                left.append(t)
            before += size[t]
        split(left, at, wants[:half])
        split([t for t in own if t not in set(left)], at + half, wants[half:])

    split(light, 0, wants)
    return out


def test_equals_the_tree_in_plain_python(spark):
    rnd = random.Random(9)
    rows = [(i, "t" * rnd.randint(1, 90) + str(rnd.randint(0, 1300)), rnd.choice(["a", "b", None]), rnd.choice(["en", "de", None])) for i in range(1500)]
    rows += [(5000 + i, "a copy of much text " * 40, "c", "en") for i in range(40)] + [(9000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    for shards in (2, 5, 8):
        got = {r.text: r.shard for r in sharding(df, shards).collect()}
        want = reference_tree(rows, shards)
        assert sum(got[t] != want[t] for t in want) == 0


def test_ids_that_are_no_numbers_and_long_texts(spark):
    rows = [(f"id{i}", f"text {i} " * 9, "s", "en") for i in range(300)] + [("long", megabyte(), "s", "en")]
    load, _ = check(spark.createDataFrame(rows, "doc_id string, text string, source string, lang string"), 4)
    assert len(load) == 4 and max(sorted(load.values())[:-1]) <= 1.1 * min(load.values())


def test_many_heavy_groups(spark, monkeypatch):
    """The driver holds a bounded number of heavy groups; the others go down the tree, and nothing is lost."""
    monkeypatch.setattr(op, "HEAVY_ROWS", 9)
    rows = [(i, f"text {i} " * (3 + i % 50), "s", "en") for i in range(400)]
    load, _ = check(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 5)
    assert max(load.values()) <= 1.1 * min(load.values())


def test_slots_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 0, i % 3) for i in range(60_000)], "doc_id long, text_crc32 long, shard int")
    out = op.with_slots(df, ["doc_id", "text_crc32"]).collect()
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(20_000)) for k in range(3))


def test_hot_group_and_few_values(spark):
    """A third of all rows are copies, and all metadata is equal: hashes still split the rest evenly."""
    rows = [(i, "copy " * 50 if i % 3 == 0 else f"text {i} " * 20, "s", "en") for i in range(3000)]
    load, _ = check(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 10)
    light = sorted(load.values())[:-1]
    assert max(light) <= 1.1 * min(light)


def test_awkward_rows(spark):
    check(awkward(spark), 5)
    assert sharding(empty(spark), 5).count() == 0
    check(spark.createDataFrame([(None, None, None, None, None)] * 3, awkward(spark, False).schema), 4)


def test_query(spark):
    out = op10_sharding(spark, "/root/testdata/sf0.01").collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 16 for r in out)


def test_heavy_groups_fill_up():
    where, wants = _place_heavy([{"grp": "a", "bytes": 50}, {"grp": "b", "bytes": 10}], 4, 100)
    assert where == {"a": 0, "b": 1}
    assert [round(w, 2) for w in wants] == [0, 6.67, 16.67, 16.67]

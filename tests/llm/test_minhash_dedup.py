import random
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import components as graph
from siltstone.llm import minhash_dedup as op
from siltstone.llm.components import connected_components
from siltstone.llm.minhash_dedup import deduplicated, near_duplicates
from tests.llm.fixtures import REAL, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(rows, width=2, percent=80):
    """All pairs, by the ids' sets."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    inverted = {}
    for d in ids:
        for s in sets[d]:
            inverted.setdefault(s, []).append(d)
    common = {}
    for group in inverted.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").distinct().collect())


def test_real_rows(spark):
    df = spark.read.parquet(f"{REAL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    for width in (2, 5):
        want = brute(texts, width)
        assert rows_of(near_duplicates(df, width)) == want
        assert any(not r[3] for r in want)
    assert sorted(r.doc_id for r in deduplicated(df).select("doc_id").collect()) == [r[0] for r in want if r[3]]


def test_awkward_rows(spark):
    df = awkward(spark)
    df = df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    # Id 13 bears two texts: it is one document with the links of both.
    rows = [(r.doc_id if r.doc_id != 13 else (13, i), r.text) for i, r in enumerate(df.where("doc_id IS NOT NULL").collect())]
    numbers = {d: d if isinstance(d, int) else 1000 + i for i, (d, _) in enumerate(rows)}
    want = {r[0]: r for r in brute([(numbers[d], t) for d, t in rows])}
    got = near_duplicates(df, 2)
    assert got.count() == df.count()
    assert rows_of(got.where("doc_id IS NOT NULL AND doc_id <> 13")) == sorted(r for d, r in want.items() if d < 1000)
    assert [(r.component_id, r.kept) for r in got.where("doc_id = 13").collect()] == [(13, True)] * 2
    assert got.where("doc_id IS NULL AND kept AND component_id IS NULL").count() == 1
    assert near_duplicates(empty(spark)).count() == 0
    assert deduplicated(df).columns == df.columns


def test_one_id_with_several_texts_joins_their_groups(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [("d7", one), ("d3", two), ("d5", one), ("d5", two), ("d5", None), ("d9", one + " tail")]
    for n in (1, 8):
        df = spark.createDataFrame(rows, "doc_id string, text string").repartition(n)
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df, 2).collect()}
        assert got == {("d7", 39): ("d3", False), ("d3", 39): ("d3", True), ("d5", 39): ("d3", False), ("d5", 0): ("d5", True), ("d9", 40): ("d3", False)}


def family(n, size, unique, seed=4):
    """n texts of `size` words, made of a template with `unique` words of their own at the end: all similar to all, none enough."""
    template = [f"t{i}" for i in range(size - unique)]
    return [(i + 1, " ".join(template + [f"u{i}x{j}" for j in range(unique)])) for i in range(n)]


def test_a_large_family_just_below_the_similarity(spark):
    """5,000 documents of similarity 0.79: no links, and no pairs in the square of their number."""
    rows = family(5000, 200, 23)
    a, b = shingles(rows[0][1], 2), shingles(rows[1][1], 2)
    assert 0.78 < len(a & b) / len(a | b) < 0.8
    sizes = []
    confirm = op._Confirm.__call__
    op._Confirm.__call__ = lambda self, pairs: (sizes.append((p := pairs.persist()).count()), confirm(self, p))[1]
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    finally:
        op._Confirm.__call__ = confirm
    assert len(got) == 5000 and all(r.kept for r in got)
    assert sum(sizes) <= 5000 * op.SIDE * op.SIDE and sizes[-1] <= 5000


def test_cells_and_hubs(spark, monkeypatch):
    """Hot shingles in a grid of cells and hubs in blocks give the same links."""
    monkeypatch.setattr(op, "CELL", 3)
    monkeypatch.setattr(op, "HUB", 2)
    rows = family(12, 60, 7) + [(100 + d, t + f" z{d}") for d, t in family(12, 60, 7)] + [(200 + d, t + " y z") for d, t in family(4, 60, 7)]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows)


def test_long_texts(spark):
    long = " ".join(f"w{i % 70001}" for i in range(180_000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, long + " tail"), (3, "w1 w2 w3"), (4, long[: len(long) // 2])]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows)


def test_groups_of_near_copies(spark):
    """Chains and a group with one common text: links beyond a table's least member count as well."""
    base = [f"w{i}" for i in range(100)]
    rows, n = [], 0
    for i in range(60):  # each differs from the base in two words, from its fellows in four
        w = list(base)
        w[(7 * i) % 100], w[(11 * i + 3) % 100] = f"x{i}", f"y{i}"
        rows.append((n := n + 1, " ".join(w)))
    rows.append((n := n + 1, " ".join(base)))
    for i in range(12):  # a chain: each is near the next one only
        rows.append((n := n + 1, " ".join(f"c{j}" for j in range(i * 8, i * 8 + 120))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_duplicates(df, 2)) == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, 1000: 1000, 1001: 1000}


def test_components_of_a_chain_take_few_queries(spark, monkeypatch):
    """What the driver holds grows with the queries that it plans, so a long chain must not take rounds of them."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, name, f=graph.stored: made.append(name) or f(df, name))
    order = list(range(1, 2000))
    random.Random(3).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(len(order) - 1)] + [(9000, 9002), (9001, 9002), (9002, 9003)]
    edges = spark.createDataFrame(chain, "a long, b long")
    want = {**dict.fromkeys(order, 1), 9000: 9000, 9001: 9000, 9002: 9000, 9003: 9000}
    assert {r.node: r.component for r in connected_components(edges).collect()} == want
    assert len(made) <= 2
    monkeypatch.setattr(graph, "FEW", -1)  # the rounds of larger graphs
    assert {r.node: r.component for r in connected_components(edges).collect()} == want
    assert connected_components(edges.where("a < 0")).collect() == []


def test_least_nodes():
    rng = random.Random(5)
    for n, m in ((1, 0), (2, 1), (30, 20), (200, 150), (2000, 1500)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = {x: x for p in pairs for x in p}
        for _ in range(n):
            before = dict(root)
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
            if root == before:
                break
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        nodes, least = graph.least_nodes(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == root


def test_rows_of_tables_are_not_broadcast(spark):
    """Spark takes them for as few as their classes; of a hundred rows a class the driver would have to hold all."""
    from siltstone.llm import minhash_dedup as m
    from siltstone.llm.shared import BROADCAST_ROWS

    classes = spark.range(50).selectExpr("id AS cls", "transform(sequence(0, 19), i -> xxhash64(id % 5, i)) AS groups")
    shared = m._table_rows(classes).groupBy("key").agg({"cls": "min"}).toDF("k", "least")
    many = m._members(classes, shared, BROADCAST_ROWS + 1)
    assert many.count() == 50 * m.SIDE * m.SIDE
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert many.exceptAll(m._members(classes, shared, 1)).isEmpty()

"""Connected components of a distributed graph: of up to FEW edges by one task, of more by rounds (large star, small star;
Kiveris et al. 2014). Each round is queries of its own, and what the driver holds for plans and threads grows with their number
in a minute, so that graphs which one task settles are not worth them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import forget, ship, stored

#: Edges up to which one task finds the components (16 MB of ids), whatever the size of the input.
FEW = 1 << 20


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a[i], b[i]), and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        # Every root takes its least neighbour if that is less than itself; then all nodes look up their roots.
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def _by_one_task(edges: DataFrame) -> DataFrame:
    """node, component of every node of a few edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
        found = pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(np.concatenate(a), np.concatenate(b))], ["node", "component"])
        for at in range(0, found.num_rows, 1 << 16):
            yield found.slice(at, 1 << 16)

    ship(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long). Beyond FEW edges, each round is two
    aggregations and two joins on one row an edge, stored in the shared folder; there are about log(nodes) rounds. Nothing
    reaches the driver but counts."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    state = _state(e)
    if state[0] <= FEW:
        return _by_one_task(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "cc-large")
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
        joined = large.join(small, F.col("a") == F.col("w"))
        pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("w").alias("a"), F.col("m").alias("b")))
        new = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        forget(large)
        after = _state(new)
        forget(e)
        e = new
        if after == state:
            break
        state = after
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

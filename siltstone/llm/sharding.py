"""Sharding by a k-d tree over groups of equal texts, in DataFrame expressions only.

Points are groups (equal texts, by the md5 of the text), weighted by their bytes; their coordinates are size,
smallest id, source and language. A node of the tree is split along its widest dimension at a weighted median
(in general the quantile that leaves each side the bytes of its leaves), until every leaf is one shard.

* Medians are found by histograms: all nodes of a level together, BINS bins each, then again inside the bin
  in which the wanted weight falls, up to ROUNDS times. Ties of a coordinate are ordered by the group's hash, so that a language
  or source with a third of all rows can be split. The driver gets one row a node.
* The tree is an array in heap order, a literal of the plan; a point walks down it. So the plan's size does not depend
  on the number of shards. Points are written again with the node they have reached every STEP levels, so walks stay short.
* Heavy groups (over 1 % of a shard's bytes) are placed first, largest first
  into the shard with the least; leaves then get as target what their shard still lacks. Thus sizes are as
  equal as whole groups allow. The driver holds HEAVY_ROWS of them at most: if more are that heavy, the limit is
  doubled until it fits, and the others go down the tree like all lighter groups.
* In the join that takes shards to rows, groups of many rows are a table of their own, broadcast if it has been counted
  to be small; all other groups have few rows. So no task gets a hot key.

Law: `bytes`. A group never spans two shards, even if it is larger than a shard's share.

Defined cases: null texts are one group (16 bytes a row), empty texts another; null source or language is a
value of its own; ids that are no numbers are placed by their hash; repeated rows each get a slot; an empty table gives
an empty result; extra columns pass through unless they bear the output's names (sharding()).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm.shared import BROADCAST_ROWS, forget, small, stored

BINS, ROUNDS, STEP = 128, 4, 4
HEAVY_ROWS = BROADCAST_ROWS
#: Bins of less than this share of a shard's bytes are not looked into.
TOLERANCE = 0.001
OVERHEAD = 16
_COORD_BITS, _TIE_BITS = 16, 46
DIMENSIONS = ("d_size", "d_id", "d_source", "d_lang")
#: Parts into which rows are dealt by their place in the input, so that equal rows are spread.
SPREAD = 64


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def group_of(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("null"))


def _coordinates(groups: DataFrame) -> DataFrame:
    """A 62-bit position of each group along every dimension: the coordinate, then the group's hash."""
    if not isinstance(groups.schema["first_id"].dataType, T.NumericType):
        groups = groups.withColumn("first_id", F.shiftright(F.xxhash64("first_id"), 32))
    low, high = groups.agg(F.min("first_id").cast("double"), F.max("first_id").cast("double")).first()
    top = (1 << _COORD_BITS) - 1
    low = low or 0.0
    span = max(1.0, (high or 0.0) - low)
    part = {
        "d_size": F.least(F.lit(top), F.floor(F.log2(F.col("unit")) * (top / 40.0))),
        "d_id": F.floor((F.coalesce(F.col("first_id").cast("double"), F.lit(low)) - F.lit(low)) / F.lit(span) * top),
        "d_source": F.shiftright(F.crc32(F.coalesce("first_source", F.lit("\u0000"))), 32 - _COORD_BITS),
        "d_lang": F.shiftright(F.crc32(F.coalesce("first_lang", F.lit("\u0000"))), 32 - _COORD_BITS),
    }
    tie = F.shiftrightunsigned(F.xxhash64("grp"), 64 - _TIE_BITS)
    at = [(F.shiftleft(c.cast("long"), _TIE_BITS) + tie) for c in part.values()]
    return groups.select("grp", "n", "bytes", F.array(*at).alias("at"), F.lit(0).alias("node"))


def _place_heavy(heavy: list, shards: int, total: int) -> tuple[dict[str, int], list[float]]:
    """Largest first into the shard with the least bytes; and the bytes each shard still wants."""
    load = [0] * shards
    least = [(0, i) for i in range(shards)]
    where = {}
    for r in sorted(heavy, key=lambda r: (-r["bytes"], r["grp"])):
        _, at = least[0]
        where[r["grp"]] = at
        load[at] += r["bytes"]
        heapq.heapreplace(least, (load[at], at))
    light, level, filled = total - sum(load), 0.0, 0
    order = sorted(load)
    for n, own in enumerate(order, 1):  # the n least loaded shards are filled up to one level
        filled += own
        level = (light + filled) / n
        if n == shards or level <= order[n]:
            break
    return where, [max(0.0, level - x) for x in load]


def _list(values: list[int]) -> Column:
    """A literal array (made of one text, whatever its length)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


class _Tree:
    """Nodes in heap order: node h has the children 2h + 1 and 2h + 2. shards[h]: the first shard below a node and what
    its shards want; split[h]: dimension and cut."""

    def __init__(self, wants: list[float]):
        self.shards: dict[int, tuple[int, list[float]]] = {0: (0, wants)}
        self.splits: dict[int, tuple[int, int]] = {}

    def share(self, h: int) -> float:
        wants = self.shards[h][1]
        return sum(wants[: len(wants) // 2]) / max(sum(wants), 1e-9)

    def split(self, h: int, dim: int, cut: int) -> list[int]:
        low, wants = self.shards[h]
        half = len(wants) // 2
        self.splits[h] = (dim, cut)
        self.shards[2 * h + 1], self.shards[2 * h + 2] = (low, wants[:half]), (low + half, wants[half:])
        return [2 * h + 1, 2 * h + 2]

    def walk(self, first: int, levels: int) -> Column:
        """The node reached from the point's node, which is of level `first`, after so many levels; leaves are kept."""
        if not levels:
            return F.col("node")
        base, end = (1 << first) - 1, (1 << (first + levels)) - 1
        at = [self.splits.get(h, (-1, 0)) for h in range(base, end)]
        dims, cuts = _list([d for d, _ in at]), _list([c for _, c in at])

        def step(h, _):
            i = (h - base).cast("int")
            dim = F.get(dims, i).cast("int")
            down = 2 * h + F.when(F.get(F.col("at"), dim) <= F.get(cuts, i), 1).otherwise(2)
            return F.when((h >= base) & (dim >= 0), down).otherwise(h).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.col("node"), step)

    def shard(self, node: Column) -> Column:
        """Shard of a leaf; leaves lie on the two last levels."""
        leaves = [h for h in self.shards if h not in self.splits]
        base = min(leaves)
        return F.get(_list([self.shards.get(h, (-1, []))[0] for h in range(base, max(leaves) + 1)]), (node - base).cast("int")).cast("int")


def _split_level(points: DataFrame, tree: _Tree, nodes: list[int], node: Column, tolerance: float) -> list[int]:
    """Split all nodes of a level at their weighted quantiles, each to `tolerance` bytes; gives the new nodes that hold several
    shards. node: the node of a point."""
    base = min(nodes)
    at = points.select("at", "bytes", node.alias("node")).where(F.col("node").isin(nodes) if len(nodes) < 20 else F.col("node") >= base)
    ends = [f(F.get("at", F.lit(i))).alias(f"{n}{i}") for i in range(len(DIMENSIONS)) for n, f in (("min", F.min), ("max", F.max))]
    wide = at.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends)
    state, wanted_nodes = {}, set(nodes)
    for r in wide.collect():  # one row a node
        if r["node"] in wanted_nodes:
            dim = max(range(len(DIMENSIONS)), key=lambda d: (r[f"max{d}"] - r[f"min{d}"], -d))
            state[r["node"]] = [dim, int(r[f"min{dim}"]), int(r[f"max{dim}"]), tree.share(r["node"]) * r["bytes"]]
    for _ in range(ROUNDS):
        if not state:
            break
        width = {h: max(1, -(-(b - a + 1) // BINS)) for h, (_, a, b, _) in state.items()}
        known = [state.get(h, [-1, 0, 0, 0.0]) for h in range(base, max(nodes) + 1)]
        widths = _list([width.get(h, 1) for h in range(base, max(nodes) + 1)])
        dims, lows, highs = (_list([int(s[i]) for s in known]) for i in range(3))
        wants = _list([int(s[3]) for s in known])
        i = (F.col("node") - base).cast("int")
        place = F.get("at", F.get(dims, i).cast("int"))
        inside = at.where(F.get(dims, i) >= 0).select("node", "bytes", place.alias("d"), i.alias("i")).where(F.col("d").between(F.get(lows, F.col("i")), F.get(highs, F.col("i"))))
        bins = inside.select("node", "bytes", F.floor((F.col("d") - F.get(lows, F.col("i"))) / F.get(widths, F.col("i"))).cast("int").alias("bin"))
        bins = bins.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"))
        running = bins.select("node", "bin", "bytes", F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")).alias("upto"))
        # The bin in which the wanted weight falls: the last one that begins at or below it.
        hit = running.where(F.col("upto") - F.col("bytes") <= F.get(wants, i)).groupBy("node").agg(F.max(F.struct("bin", "bytes", "upto")).alias("h"))
        hits = hit.collect()  # one row a node
        for r in hits:
            d, a, b, want = state[r["node"]]
            begin = a + r["h"]["bin"] * width[r["node"]]
            state[r["node"]] = [d, begin, min(b, begin + width[r["node"]] - 1), want - (r["h"]["upto"] - r["h"]["bytes"])]
        if all(r["h"]["bytes"] <= tolerance for r in hits):
            break
    found = []
    for h in nodes:
        # Inside the last bin nothing is known any more: it goes to the side that it fits better. A node without points is cut anywhere.
        d, a, b, want = state.get(h, [0, 0, 0, 0.0])
        found += tree.split(h, d, b if want > 0 else a - 1)
    return [h for h in found if len(tree.shards[h][1]) > 1]


def _heavy_limit(rows: DataFrame, least: float) -> float:
    """`least`, doubled until HEAVY_ROWS groups at most have so many bytes."""
    powers = rows.where(F.col("bytes") >= least).groupBy(F.floor(F.log2(F.col("bytes") / least)).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    limit, left = least, 0
    counts = {r["e"]: r["n"] for r in powers.collect()}  # 63 rows at most
    left = sum(counts.values())
    for e in sorted(counts):
        if left <= HEAVY_ROWS:
            break
        left -= counts[e]
        limit = least * 2.0 ** (e + 1)
    return limit


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """grp, shard, n: from rows with grp, bytes, unit (bytes of one row), n, first_id, first_source, first_lang, one row
    a group (stored)."""
    spark = rows.sparkSession
    total = int(rows.agg(F.sum("bytes")).first()[0] or 0)
    limit = _heavy_limit(rows, max(1.0, total / shards / 100))
    heavy = rows.where(F.col("bytes") >= limit).select("grp", "bytes", "n").collect()  # HEAVY_ROWS at most
    where, wants = _place_heavy(heavy, shards, total)
    points = stored(_coordinates(rows.where(F.col("bytes") < limit)), "shard-points")
    tree, first, level = _Tree(wants), 0, 0
    nodes = [0] if shards > 1 else []
    while nodes:
        if level - first == STEP:
            old, points, first = points, stored(points.withColumn("node", tree.walk(first, STEP)), "shard-points"), level
            forget(old)
        nodes = _split_level(points, tree, nodes, tree.walk(first, level - first), TOLERANCE * total / shards)
        level += 1
    placed = spark.createDataFrame([(r["grp"], where[r["grp"]], r["n"]) for r in heavy], "grp string, shard int, n long")
    points = points.withColumn("node", tree.walk(first, level - first))
    return placed.unionByName(points.select("grp", tree.shard(F.col("node")).alias("shard"), "n"))


def sharding(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """df with shard (0 to shards - 1). Only columns of df that are kept travel with it, so narrow tables stay narrow:
    a column `__grp` and `__bytes` may be given instead of the text."""
    kept = [c for c in df.columns if c not in ("shard", "__grp", "__bytes")]
    if "__grp" not in df.columns:
        df = df.withColumn("__grp", group_of(F.col(text_col))).withColumn("__bytes", size_of(F.col(text_col)))
    groups = df.groupBy(F.col("__grp").alias("grp")).agg(
        F.sum("__bytes").alias("bytes"), F.max("__bytes").alias("unit"), F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.min(source_col).alias("first_source"), F.min(lang_col).alias("first_lang")
    )
    groups = stored(groups, "shard-groups")
    placed = stored(assign(groups, shards), "shard-placed")
    forget(groups)
    rows = placed.agg(F.sum("n")).first()[0] or 0
    hot = placed.where(F.col("n") >= max(2, rows // shards // 100))  # 100 groups a shard at most
    n_hot = hot.count()
    hot = small(hot.select(F.col("grp").alias("__h"), F.col("shard").alias("__hs")), n_hot)
    light = placed.where(F.col("n") < max(2, rows // shards // 100)).select(F.col("grp").alias("__l"), F.col("shard").alias("__ls"))
    out = df.drop("shard").join(hot, F.col("__grp") == F.col("__h"), "left")
    # Rows of hot groups have no key in the shuffled join; each goes where its own hash sends it.
    key = F.when(F.col("__h").isNull(), F.col("__grp")).otherwise(F.concat(F.lit("-"), F.xxhash64(F.col(id_col).cast("string")).cast("string")))
    out = out.withColumn("__key", key).join(light, F.col("__key") == F.col("__l"), "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("__hs", "__ls").alias("shard"))


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with shard; narrow) with slot, gapless from 0 in each shard. Shards are cut into buckets by the hash of the order
    columns and by a row's place in the input, fixed by writing the rows; so no shard and no heap of equal rows, however
    large, is sorted in one task."""
    rows = stored(rows.withColumn("__spread", (F.monotonically_increasing_id() % SPREAD).cast("int")), "shard-slots")
    buckets = max(1, rows.count() // 20_000)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order, "__spread"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    number = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(*order, "__spread"))
    out = rows.withColumn("__number", number).join(offsets, (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return out.withColumn("slot", (F.col("__offset") + F.col("__number") - 1).cast("long")).drop("__bucket", "__spread", "__number", "__s", "__b", "__offset")

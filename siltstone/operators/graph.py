"""The call graph: traversal, flows, paths, chains. Edges are (caller_qn, callee_qn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import staged


#: By the side on which a flow goes on: the end of an edge that it starts from, and the end that it comes to.
SIDES = {"Caller": ("callee_qn", "caller_qn"), "Callee": ("caller_qn", "callee_qn")}


def neighbours(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """side, at, qn: the distinct callers and callees of some nodes, all by one pass over the edges. They are kept, because edges may
    be a long plan, and because hops that start from a table of known size need not shuffle the edges."""
    near = edges.where(F.col("caller_qn").isin(*nodes) | F.col("callee_qn").isin(*nodes))
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(source).alias("at"), F.col(target).alias("qn")) for side, (source, target) in SIDES.items()])
    return staged(near.select(F.inline(ends)).where(F.col("at").isin(*nodes)).distinct(), "neighbours")


def _reached(edges: DataFrame, near: DataFrame, seed: str, max_depth: int, side: str) -> DataFrame:
    """reachable() on from the seed's neighbours: one pass over the edges a level."""
    source, target = SIDES[side]
    level = near.where((F.col("side") == side) & (F.col("at") == seed)).select("qn")
    out = level.select("qn", F.lit(1).alias("depth"))
    for depth in range(2, max_depth + 1):
        level = edges.join(level.where(F.col("qn") != seed).withColumnRenamed("qn", source), source, "left_semi").select(F.col(target).alias("qn")).where(F.col("qn") != seed).distinct()
        level = staged(level, "level") if depth < max_depth else level
        out = out.unionByName(level.select("qn", F.lit(depth).alias("depth")))
    return out.groupBy("qn").agg(F.min("depth").alias("depth"))


def reachable(edges: DataFrame, seed: str, max_depth: int, reverse: bool = False) -> DataFrame:
    """qn, depth: the least number of edges (up to max_depth) from the seed, or to it. Breadth first: each level is the
    distinct nodes one edge on, so paths are never listed. The seed itself is a result only by an edge to itself."""
    return _reached(edges, neighbours(edges, [seed]), seed, max_depth, "Caller" if reverse else "Callee")


def call_paths(edges: DataFrame, start: str, goal: str, max_depth: int = 6) -> DataFrame:
    """path (array), length: all simple paths; none goes on past the goal. Paths are listed by nature. They are made from
    halves that meet in the middle node: k edges from the start, and k or k - 1 edges to the goal."""
    ahead = edges.where(F.col("caller_qn") == start).select(F.lit(1).alias("k"), F.col("callee_qn").alias("at"), F.array(F.lit(start), "callee_qn").alias("path"))
    behind = edges.sparkSession.range(1).select(F.lit(0).alias("j"), F.lit(goal).alias("mid"), F.array().cast("array<string>").alias("rest"))
    first, last = ahead, behind
    for k in range(2, (max_depth + 1) // 2 + 1):
        ahead = ahead.where(F.col("at") != goal).join(edges, F.col("at") == F.col("caller_qn")).where(~F.array_contains("path", F.col("callee_qn")))
        ahead = ahead.select(F.lit(k).alias("k"), F.col("callee_qn").alias("at"), F.concat("path", F.array("callee_qn")).alias("path"))
        first = first.unionByName(ahead)
    for j in range(1, max_depth // 2 + 1):
        behind = behind.select(F.concat(F.array("mid"), "rest").alias("rest"), "mid").join(edges, F.col("mid") == F.col("callee_qn")).where(~F.array_contains("rest", F.col("caller_qn")))
        behind = behind.select(F.lit(j).alias("j"), F.col("caller_qn").alias("mid"), "rest")
        last = last.unionByName(behind)
    whole = first.join(last, (F.col("at") == F.col("mid")) & F.col("j").between(F.col("k") - 1, F.col("k"))).where(~F.arrays_overlap("path", "rest"))
    return whole.select(F.concat("path", "rest").alias("path"), (F.col("k") + F.col("j")).alias("length"))


def _flow(edges: DataFrame, near: DataFrame, seed: str, depth: int) -> DataFrame:
    callers = _reached(edges, near, seed, depth, "Caller").select(F.lit("Caller").alias("side"), "depth", "qn")
    callees = _reached(edges, near, seed, depth, "Callee").select(F.lit("Callee").alias("side"), "depth", "qn")
    return callers.unionByName(callees).select("side", "depth", "qn", F.concat(F.lit("["), "side", F.lit("|depth="), F.col("depth").cast("string"), F.lit("] "), "qn").alias("line"))


def execution_flow(edges: DataFrame, seed: str, depth: int = 2) -> DataFrame:
    """line, side, depth, qn: callers, then callees, each by depth and name."""
    return _flow(edges, neighbours(edges, [seed]), seed, depth)


def one_hop_flow(edges: DataFrame, seed: str) -> DataFrame:
    """line: distinct direct callers and callees."""
    callers = edges.where(F.col("callee_qn") == seed).select(F.concat(F.lit("[Caller] called by "), "caller_qn").alias("line"))
    callees = edges.where(F.col("caller_qn") == seed).select(F.concat(F.lit("[Callee] calls "), "callee_qn").alias("line"))
    return callers.unionByName(callees).distinct()


def direct_callees(edges: DataFrame, seed: str) -> DataFrame:
    return edges.where(F.col("caller_qn") == seed).select("callee_qn").distinct()


#: Callers in one row of reverse_edges, or so.
CALLERS = 10_000


def reverse_edges(edges: DataFrame) -> DataFrame:
    """callee_qn, page, callers (sorted, distinct), n (callers of the callee in all). A callee with very many callers has its
    callers dealt to several pages by their hash, so no list grows without bound."""
    rows = edges.select("callee_qn", "caller_qn").distinct()
    n = rows.groupBy("callee_qn").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("callee_qn", "__c")
    page = F.pmod(F.xxhash64("caller_qn"), F.ceil(F.col("n") / CALLERS)).alias("page")
    paged = rows.join(n, F.col("callee_qn") == F.col("__c")).select("callee_qn", "caller_qn", "n", page)
    return paged.groupBy("callee_qn", "page").agg(F.array_sort(F.collect_list("caller_qn")).alias("callers"), F.any_value("n").alias("n"))


def with_called_by(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chunks with called_by, derived from the edges; for the chunks that are shown (all callers of one are one value)."""
    back = edges.join(chunks.select(F.col("qualified_name").alias("callee_qn")).distinct(), "callee_qn", "left_semi")
    back = back.groupBy(F.col("callee_qn").alias("__qn")).agg(F.array_sort(F.collect_set("caller_qn")).alias("called_by"))
    return chunks.drop("called_by").join(back, F.col("qualified_name") == F.col("__qn"), "left").drop("__qn")


def question_flow(edges: DataFrame, seed: str, names: list[str], n_callees: int = 5) -> tuple[DataFrame, DataFrame]:
    """line: the seed's flow of two hops and each name's of one; callee_qn: the seed's first callees. All first hops are one pass."""
    near = neighbours(edges, [seed, *names])
    lines = _flow(edges, near, seed, 2).select("line") if seed else near.select(F.lit("").alias("line")).limit(0)
    for name in names:
        lines = lines.unionByName(_flow(edges, near, name, 1).select("line"))
    callees = near.where((F.col("side") == "Callee") & (F.col("at") == seed)).select(F.col("qn").alias("callee_qn"))
    return lines, callees.orderBy("callee_qn").limit(n_callees)


def raw_edges(chunks: DataFrame) -> DataFrame:
    """Edges as chunks store them, unresolved: caller_qn, callee_qn (a name), direction."""
    out = chunks.select(F.col("qualified_name").alias("caller_qn"), F.explode("calls").alias("callee_qn"), F.lit("forward").alias("direction"))
    back = chunks.select(F.explode("called_by").alias("caller_qn"), F.col("qualified_name").alias("callee_qn"), F.lit("reverse").alias("direction"))
    return out.unionByName(back)


def call_chain(chain: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a chain (chain_id, chain: array of names): text, a line a known node, indented by its place in the chain."""
    steps = chain.select("chain_id", F.posexplode("chain").alias("i", "qn"))
    known = steps.join(chunks.select("qualified_name", "name", "filepath"), F.col("qn") == F.col("qualified_name"))
    line = F.concat(F.expr("repeat('  ', i)"), F.lit("↓ "), "name", F.lit(" ("), "filepath", F.lit(")"))
    return known.groupBy("chain_id").agg(F.concat(F.lit("## Call Chain:\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))


def chunk_context(hits: DataFrame, edges: DataFrame, chunks: DataFrame, code_for: int = 3) -> DataFrame:
    """hits (qualified_name, position) with flow (lines of one and two hops) and related (callees' names that are chunks; for
    the first code_for hits). hits is a short list; all of them are expanded in one join, not one by one."""
    h = hits.select("qualified_name", "position")
    out1 = h.join(edges, F.col("qualified_name") == F.col("caller_qn")).select("qualified_name", "position", F.col("callee_qn").alias("qn"), F.lit(1).alias("depth"), F.lit("Callee").alias("side"))
    in1 = h.join(edges, F.col("qualified_name") == F.col("callee_qn")).select("qualified_name", "position", F.col("caller_qn").alias("qn"), F.lit(1).alias("depth"), F.lit("Caller").alias("side"))
    e = edges.select(F.col("caller_qn").alias("a"), F.col("callee_qn").alias("b"))
    not_seed = F.col("qn") != F.col("qualified_name")
    out2 = out1.where(not_seed).join(e, F.col("qn") == F.col("a")).where(F.col("b") != F.col("qualified_name")).select("qualified_name", "position", F.col("b").alias("qn"), F.lit(2).alias("depth"), "side")
    in2 = in1.where(not_seed).join(e, F.col("qn") == F.col("b")).where(F.col("a") != F.col("qualified_name")).select("qualified_name", "position", F.col("a").alias("qn"), F.lit(2).alias("depth"), "side")
    every = out1.unionByName(in1).unionByName(out2).unionByName(in2).groupBy("qualified_name", "position", "side", "qn").agg(F.min("depth").alias("depth"))
    flow = every.groupBy("qualified_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("["), "side", F.lit("|depth="), F.col("depth").cast("string"), F.lit("] "), "qn"))).alias("flow"))
    code = out1.where(F.col("position") < code_for).join(chunks.select(F.col("qualified_name").alias("c")), F.col("qn") == F.col("c"), "left_semi")
    code = code.groupBy("qualified_name").agg(F.array_sort(F.collect_set("qn")).alias("related"))
    return h.join(flow, "qualified_name", "left").join(code, "qualified_name", "left").select("qualified_name", "position", F.coalesce("flow", F.array().cast("array<string>")).alias("flow"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def callee_expansion(hits: DataFrame, edges: DataFrame, chunks: DataFrame, first: int = 5) -> DataFrame:
    """Names of chunks called by the first hits and not among the hits."""
    callees = hits.where(F.col("position") < first).join(edges, F.col("qualified_name") == F.col("caller_qn")).select("callee_qn").distinct()
    fresh = callees.join(hits.select(F.col("qualified_name").alias("callee_qn")), "callee_qn", "left_anti")
    return chunks.join(fresh, F.col("qualified_name") == F.col("callee_qn"), "left_semi")

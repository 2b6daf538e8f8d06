"""Search: BM25, exact vector top-k, rank fusion, promotion of exact hits, reranking, the hybrid plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import query_tokens, tokens
from siltstone.operators.index import SearchIndex
from siltstone.operators.lookup import by_file_names, exact_or_suffix, with_rows_of

RRF_K = 60
OVERFETCH, RERANK_SLICE = 4, 20


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf. Repeats are summed inside each row before anything is shuffled (a row is one document)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a norm is zero or the lengths differ."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot / length)


def vector_top(chunks: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest by cosine among rows that pass `where` (a filter before the limit, so it reaches the scan). Exact: each
    task keeps its k best and only those meet."""
    rows = chunks if where is None else chunks.where(where)
    vector = F.array(*[F.lit(float(x)) for x in query])
    out = rows.select(*[c for c in rows.columns if c != vector_col], cosine(F.col(vector_col), vector).alias("score")).where("score IS NOT NULL")
    return out.orderBy(F.desc("score"), id_col).limit(k)


def ranked(top: DataFrame, id_col: str, source: int) -> DataFrame:
    """id, rank from 0 in order of score, list. `top` is a limited list."""
    return top.select(F.col(id_col).alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1).alias("rank"), F.lit(source).alias("list"))


def fuse(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (id, rank, list): id, score, first_seen; order: score, then first_seen."""
    both = first.unionByName(second).where("id IS NOT NULL")
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("first_seen"))


def promote(fused: DataFrame, exact: DataFrame, id_col: str = "id") -> DataFrame:
    """exact first, then what is left of fused: id, position."""
    rest = fused.join(exact.select(F.col(id_col).alias("id")), "id", "left_anti")
    ahead = exact.select(F.col(id_col).alias("id"), F.lit(0).alias("g"), F.lit(0.0).alias("s"), F.row_number().over(Window.orderBy(id_col)).cast("long").alias("f"))
    rest = rest.select("id", F.lit(1).alias("g"), (-F.col("score")).alias("s"), F.col("first_seen").cast("long").alias("f"))
    return ahead.unionByName(rest).select("id", (F.row_number().over(Window.orderBy("g", "s", "f", "id")) - 1).alias("position"), (F.col("g") == 0).alias("exact"))


Scorer = Callable[[Column, str], Column]


def overlap_score(text: Column, query: str) -> Column:
    """The default pair scorer, in place of a model: the share of distinct query tokens that the text holds."""
    wanted = sorted(set(query_tokens(query)))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in wanted]))) / F.lit(float(len(wanted)))


def rerank(rows: DataFrame, query: str, k: int, text_col: str, id_col: str, scorer: Scorer = overlap_score) -> DataFrame:
    """The k best of a candidate list by a pair scorer."""
    return rows.withColumn("rerank_score", scorer(F.col(text_col), query)).orderBy(F.desc("rerank_score"), id_col).limit(k)


def hybrid_search(
    index: SearchIndex,
    chunks: DataFrame,
    query: str,
    query_vector: list[float],
    top_k: int = 5,
    names: list[str] | None = None,
    files: list[str] | None = None,
    scorer: Scorer = overlap_score,
    exact_vectors: bool = True,
) -> DataFrame:
    """Exact names, vector and BM25 lists, fusion, promotion, rerank. index: of the chunks, with filepath among its filters; it
    gives the lists without the chunks' texts. chunks: qualified_name, name, content. Gives qualified_name, position, exact.
    Lists hold at most 4 * top_k rows, so all windows are small; the slate is found first, so that only its own
    chunks' texts are read."""
    want = OVERFETCH * top_k
    near = index.vector_top(query_vector, want, where=by_file_names(F.col("filepath"), files) if files else None, exact=exact_vectors)
    fused = fuse(ranked(near, "id", 0), ranked(index.bm25_top(query, want), "id", 1))
    exact = exact_or_suffix(chunks, names or []).select(F.col("qualified_name").alias("id")).orderBy("id").limit(RERANK_SLICE)
    slate = promote(fused, exact).orderBy("position").limit(RERANK_SLICE)
    scored = with_rows_of(slate.withColumnRenamed("id", "qualified_name"), chunks.select("qualified_name", "content")).withColumnRenamed("qualified_name", "id")
    scored = scored.withColumn("s", scorer(F.col("content"), query))
    order = Window.orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("position")), F.desc("s"), "id")
    return scored.select(F.col("id").alias("qualified_name"), (F.row_number().over(order) - 1).alias("position"), "exact").where(F.col("position") < top_k)

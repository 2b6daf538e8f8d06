"""The registered queries of the engine's own operators, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import errors, text
from siltstone.operators import context, graph, lookup, resolve, search, store
from siltstone.plans.registry import ORACLES as ORACLES
from siltstone.plans.registry import QUERIES as QUERIES
from siltstone.plans.registry import query
from siltstone.sources.parsing.table import with_code_behind

QUESTION = "the of que die and m7.py d12"
NAMES = ["d12", "u30", "src1.en.d40"]
FILES = ["m7.py", "m12.py"]
VECTOR = [((i * 7) % 11 - 5) / 5.0 for i in range(64)]
_SQL_VECTOR = "[" + ",".join(f"CAST({x} AS DOUBLE)" for x in VECTOR) + "]"
_TOKENS = "list_filter(regexp_split_to_array(lower(translate(coalesce({0}, ''), '_.()[]{{}}=:,;\"''/', '               ')), '\\s+'), lambda x: x <> '')"


def _names(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- tokens and BM25 -------------------------------------------------------------------------------------------------
_DF = f"t AS (SELECT doc_id, {_TOKENS.format('text')} AS toks FROM documents), d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t) x GROUP BY term), s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), m AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mean_idf, count(*) AS n_terms FROM d, s)"
_Q = ", ".join(f"('{x}')" for x in text.query_tokens(QUESTION))
_SCORES = f"""WITH {_DF}, q AS (SELECT term FROM (VALUES {_Q}) v(term)),
f AS (SELECT doc_id, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, q),
i AS (SELECT term, CASE WHEN df IS NULL THEN 0.0 WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf, avgdl
  FROM (SELECT DISTINCT term FROM q) u LEFT JOIN d USING (term), s, m),
r AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f JOIN i USING (term) GROUP BY doc_id)"""


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(t):
    tf = search.term_frequencies(t.documents, "doc_id", "text")
    return tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens FROM documents")
def tokenize_count(t):
    return t.documents.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_DF} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, n_terms, round(mean_idf, 6) AS mean_idf FROM s, m")
def bm25_stats(t):
    return t.document_index.table("stats").select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


@query(f"{_SCORES} SELECT doc_id, round(score, 6) AS score FROM r")
def bm25_scores(t):
    return t.document_index.bm25_all(QUESTION).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"{_SCORES} SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def bm25_topk(t):
    return t.document_index.bm25_top(QUESTION, 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# --- vectors, fusion, hybrid search ----------------------------------------------------------------------------------
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_SQL_VECTOR})"


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(t):
    return t.vector_index.vector_top(VECTOR, 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT qualified_name, round({_COS}, 6) AS score FROM vectors WHERE language = 'python' ORDER BY {_COS} DESC, qualified_name LIMIT 10", "vectors")
def vector_topk_language(t):
    return t.chunk_index.vector_top(VECTOR, 10, F.col("language") == "python").select(F.col("id").alias("qualified_name"), F.round("score", 6).alias("score"))


@query(f"SELECT qualified_name, round({_COS}, 6) AS score FROM vectors WHERE filepath ILIKE '%m7.py%' OR filepath ILIKE '%m12.py%' ORDER BY {_COS} DESC, qualified_name LIMIT 10", "vectors")
def vector_topk_path(t):
    near = t.chunk_index.vector_top(VECTOR, 10, lookup.by_file_names(F.col("filepath"), FILES))
    return near.select(F.col("id").alias("qualified_name"), F.round("score", 6).alias("score"))


@query()
def vector_topk_cells(t):
    """The nearest of the cells nearest to the question; what share of the true ones it finds is measured when the index is written."""
    return t.vector_index.vector_top(VECTOR, 10, exact=False).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_DF} SELECT n AS n_docs, n_terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest(toks) FROM t)) AS n_postings, (SELECT count(*) FROM embeddings) AS n_vectors FROM s, m")
def search_index(t):
    """Write the indexes, if this session has not yet, and say what they hold."""
    t.chunk_index.ready()
    words, vectors = t.document_index, t.vector_index.table("vectors").agg(F.count(F.lit(1)).alias("n_vectors"))
    held = words.table("postings").agg(F.count(F.lit(1)).alias("n_postings"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(words.table("stats").select("n_docs", "n_terms")).join(one(held), "one").join(one(vectors), "one").drop("one")


_LISTS = f"""{_SCORES}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS rank, 0 AS list FROM embeddings),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, 1 AS list FROM r),
u AS (SELECT * FROM v WHERE rank < 20 UNION ALL SELECT * FROM b WHERE rank < 20),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min(list * 1000000 + rank) AS first_seen FROM u GROUP BY id)"""


def _fused(t):
    near = t.vector_index.vector_top(VECTOR, 20)
    return search.fuse(search.ranked(near, "id", 0), search.ranked(t.document_index.bm25_top(QUESTION, 20), "id", 1))


@query(f"{_LISTS} SELECT id, round(CAST(score AS DOUBLE), 8) AS score, CAST(first_seen AS BIGINT) AS first_seen FROM fused")
def rrf_fuse(t):
    return _fused(t).select("id", F.round("score", 8).alias("score"), F.col("first_seen").cast("long").alias("first_seen"))


@query(
    f"{_LISTS}, e AS (SELECT doc_id AS id FROM documents WHERE doc_id IN (3, 5)), p AS (SELECT id, 0 AS g, 0.0 AS s, id AS f FROM e UNION ALL SELECT id, 1, -score, first_seen FROM fused WHERE id NOT IN (SELECT id FROM e)) SELECT id, row_number() OVER (ORDER BY g, s, f, id) - 1 AS position, g = 0 AS exact FROM p"
)
def promote_exact(t):
    exact = t.documents.where(F.col("doc_id").isin(3, 5)).select(F.col("doc_id").alias("id"))
    out = search.promote(_fused(t), exact)
    return out.select("id", F.col("position").cast("long").alias("position"), "exact")


def _overlap(question: str) -> str:
    wanted = sorted(set(text.query_tokens(question)))
    return f"len(list_intersect(list_distinct({_TOKENS.format('content')}), [{', '.join(repr(x) for x in wanted)}])) / {float(len(wanted))}"


_OVERLAP = _overlap(QUESTION)


def _hybrid_sql(question: str, names: list[str], files: list[str], top_k: int, select: str) -> str:
    """SQL of the hybrid search over `vectors`; select: from ranked (qualified_name, position, exact)."""
    terms = ", ".join(f"('{x}')" for x in text.query_tokens(question))
    scores = _SCORES.replace(_Q, terms).replace("FROM documents", "FROM vectors").replace(_TOKENS.format("text"), _TOKENS.format("content")).replace("doc_id", "qualified_name")
    by_file = " OR ".join(f"filepath ILIKE '%{f}%'" for f in files) or "true"
    by_name = " OR ".join([f"name IN {_names(names)}", *[f"qualified_name LIKE '%.{n}'" for n in names]]) if names else "false"
    k = 4 * top_k
    return f"""{scores},
v AS (SELECT qualified_name AS id, row_number() OVER (ORDER BY {_COS} DESC, qualified_name) - 1 AS rank, 0 AS list FROM vectors WHERE {by_file}),
b AS (SELECT qualified_name AS id, row_number() OVER (ORDER BY score DESC, qualified_name) - 1 AS rank, 1 AS list FROM r),
u AS (SELECT * FROM v WHERE rank < {k} UNION ALL SELECT * FROM b WHERE rank < {k}),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min(list * 1000000 + rank) AS first_seen FROM u GROUP BY id),
e AS (SELECT qualified_name AS id FROM vectors WHERE {by_name} ORDER BY 1 LIMIT 20),
p AS (SELECT id, 0 AS g, 0.0 AS s, row_number() OVER (ORDER BY id) AS f FROM e UNION ALL SELECT id, 1, -score, first_seen FROM fused WHERE id NOT IN (SELECT id FROM e)),
slate AS (SELECT id, row_number() OVER (ORDER BY g, s, f, id) - 1 AS position, g = 0 AS exact FROM p ORDER BY 2 LIMIT 20),
ranked AS (SELECT id AS qualified_name, row_number() OVER (ORDER BY exact DESC, CASE WHEN exact THEN position END NULLS FIRST, {_overlap(question)} DESC, id) - 1 AS position, exact FROM slate JOIN vectors ON id = vectors.qualified_name)
{select} WHERE position < {top_k}"""


@query(_hybrid_sql(QUESTION, NAMES, FILES, 5, "SELECT * FROM ranked"), "vectors")
def hybrid_search(t):
    out = search.hybrid_search(t.chunk_index, t.vectors, QUESTION, VECTOR, 5, NAMES, FILES)
    return out.select("qualified_name", F.col("position").cast("long").alias("position"), "exact")


@query(f"SELECT qualified_name, round({_OVERLAP}, 6) AS rerank_score FROM chunks ORDER BY {_OVERLAP} DESC, qualified_name LIMIT 10", "chunks")
def rerank(t):
    return search.rerank(t.chunks, QUESTION, 10, "content", "qualified_name").select("qualified_name", F.round("rerank_score", 6).alias("rerank_score"))


# --- lookups ---------------------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT qualified_name, name FROM chunks WHERE name IN {_names(NAMES)} OR qualified_name IN {_names(NAMES)}", "chunks")
def exact_names(t):
    return lookup.exact_names(t.chunks, NAMES).select("qualified_name", "name").distinct()


@query("SELECT qualified_name, name FROM chunks WHERE name IN ('d12', 'u30') OR qualified_name LIKE '%.d12' OR qualified_name LIKE '%.u30'", "chunks")
def exact_suffix(t):
    return lookup.exact_or_suffix(t.chunks, ["d12", "u30"]).select("qualified_name", "name")


@query("SELECT qualified_name, name FROM chunks WHERE lower(name) IN ('d12', 'u30') OR qualified_name IN ('D12', 'u30') OR qualified_name LIKE '%.D12' OR qualified_name LIKE '%.u30'", "chunks")
def find_by_name(t):
    return lookup.find_by_name(t.chunks, ["D12", "u30"]).select("qualified_name", "name")


@query("SELECT qualified_name, filepath, start_line FROM chunks WHERE filepath ILIKE '%M7.py%' ORDER BY filepath, start_line, qualified_name LIMIT 10", "chunks")
def path_search(t):
    return lookup.by_path(t.chunks, "M7.py", 10).select("qualified_name", "filepath", "start_line")


@query(
    "SELECT * FROM (SELECT qualified_name, filepath FROM chunks WHERE filepath ILIKE '%m7.py%' ORDER BY filepath, start_line, qualified_name LIMIT 20) UNION ALL SELECT * FROM (SELECT qualified_name, filepath FROM chunks WHERE filepath ILIKE '%m7%' ORDER BY filepath, start_line, qualified_name LIMIT 20)",
    "chunks",
)
def multi_file_search(t):
    return lookup.by_paths(t.chunks, ["m7.py", "m7"], 20).select("qualified_name", "filepath")


@query("SELECT qualified_name, name, type FROM chunks WHERE contains(lower(filepath), 'en/m1')", "chunks")
def read_file(t):
    return lookup.read_file(t.chunks, "EN/M1").select("qualified_name", "name", "type")


@query("SELECT qualified_name, content FROM chunks WHERE qualified_name IN (SELECT 'src' || (doc_id % 20) || '.en.d' || doc_id FROM documents WHERE doc_id IN (1, 2, 3, 4, 5, 6, 7, 8))", "chunks")
def retrieve_names(t):
    return lookup.by_qualified_names(t.chunks, [f"src{i % 20}.en.d{i}" for i in range(1, 9)]).select("qualified_name", "content")


@query("SELECT qualified_name, '[' || qualified_name || '] (' || filepath || ':' || start_line || ')' || chr(10) || content AS snippet FROM chunks WHERE qualified_name = (SELECT min(qualified_name) FROM chunks)", "chunks")
def code_snippet(t):
    first = t.chunks.agg(F.min("qualified_name")).first()[0]
    return lookup.snippet(t.chunks, first)


@query("SELECT qualified_name FROM chunks WHERE language = 'python'", "chunks")
def language_filter(t):
    return t.chunks.where(F.col("language") == "python").select("qualified_name")


@query("SELECT qualified_name FROM chunks WHERE qualified_name NOT IN (SELECT qualified_name FROM chunks WHERE type = 'file')", "chunks")
def exclude_seen(t):
    return lookup.without(t.chunks, t.chunks.where(F.col("type") == "file")).select("qualified_name")


@query("SELECT count(*) AS n FROM chunks", "chunks")
def count_chunks(t):
    return t.chunks.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT qualified_name, name, type, filepath, start_line FROM chunks ORDER BY qualified_name", "chunks")
def scan_ordered(t):
    return store.scrolled(t.chunks).select("qualified_name", "name", "type", "filepath", "start_line")


@query("SELECT c.qualified_name, name, type, content, CASE WHEN doc_id % 4 <> 0 THEN content END AS summary, filepath, start_line, language, module_path, 'd ' || content AS docstring, k.calls, b.called_by FROM chunks c LEFT JOIN (SELECT caller_qn, list_sort(list(called_name)) AS calls FROM calls GROUP BY 1) k ON k.caller_qn = c.qualified_name LEFT JOIN (SELECT callee_qn, list_sort(list(DISTINCT caller_qn)) AS called_by FROM doc_edges GROUP BY 1) b ON b.callee_qn = c.qualified_name", "calls", "doc_edges")
def docs_scan(t):
    calls = t.calls.groupBy("caller_qn").agg(F.array_sort(F.collect_list("called_name")).alias("calls"))
    rows = graph.with_called_by(_documented(t), t.doc_edges).join(calls, F.col("qualified_name") == F.col("caller_qn"), "left")
    return store.doc_order(rows)


@query("SELECT DISTINCT filepath FROM chunks WHERE language = 'cpp' ORDER BY filepath", "chunks")
def referenced_files(t):
    return t.chunks.where(F.col("language") == "cpp").select("filepath").distinct().orderBy("filepath")


# --- text extraction -------------------------------------------------------------------------------------------------
#: A name between two word boundaries is a whole run of word characters; RE2's boundaries know ASCII alone, so SQL takes the runs.
_RUNS = "regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+')"


@query(
    f"""SELECT item_id, list_sort(list_distinct(list_filter({_RUNS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]{{2,}}') AND lower(w) NOT IN {_names([w for w in text.NAME_STOP_WORDS])}))) AS names FROM benchmark"""
)
def extract_identifiers(t):
    return t.benchmark.select("item_id", F.array_sort(text.identifiers(F.col("text"))).alias("names"))


@query(
    f"""SELECT doc_id, list_sort(list_distinct(list_filter({_RUNS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]{{2,}}') AND lower(w) NOT IN {_names([w for w in text.NAME_STOP_WORDS])}))) AS names FROM documents"""
)
def document_identifiers(t):
    """The same rule over long texts in four languages."""
    return t.documents.select("doc_id", F.array_sort(text.identifiers(F.col("text"))).alias("names"))


@query(
    "WITH q AS (SELECT conv_id, turn, concat('see app', conv_id, '.py and Main', turn, '.xaml.cs or v', turn, '.xaml, a-b.py') AS q FROM conversations) SELECT conv_id, turn, regexp_extract_all(q, '\\b[\\w-]+\\.py\\b') || regexp_extract_all(q, '\\b[\\w-]+\\.cs\\b') || regexp_extract_all(q, '\\b[\\w-]+\\.xaml\\b') AS files FROM q"
)
def extract_filenames(t):
    q = t.conversations.select("conv_id", "turn", F.expr("concat('see app', conv_id, '.py and Main', turn, '.xaml.cs or v', turn, '.xaml, a-b.py')").alias("q"))
    return q.select("conv_id", "turn", text.file_names(F.col("q")).alias("files"))


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages""")
def extract_links(t):
    return t.pages.select("page_id", text.attribute_values(F.col("html"), "href").alias("links"))


@query("""SELECT page_id, list_sort(list_distinct(regexp_extract_all(src, '#include\\s*[<"]([^>"]+)[>"]', 1))) AS includes FROM (SELECT page_id, concat('#include <v', page_id % 5, '>', chr(10), '#include "', url, '"', chr(10), '#include <v', page_id % 5, '>') AS src FROM pages)""")
def extract_includes(t):
    src = F.expr("""concat('#include <v', page_id % 5, '>', chr(10), '#include "', url, '"', chr(10), '#include <v', page_id % 5, '>')""")
    return t.pages.select("page_id", F.array_sort(text.includes(src)).alias("includes"))


_WORDS = "SELECT doc_id, unnest(string_split(regexp_replace(text, '[^!-~]+', ' ', 'g'), ' ')) AS w FROM documents"


@query(
    f"""SELECT w AS name, count(*) AS n, bool_or(length(w) BETWEEN 2 AND 50 AND regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_.]*') AND NOT regexp_full_match(w, '[_.]+') AND w NOT IN {_names(list(text.RESERVED_WORDS))}) AS valid FROM ({_WORDS}) GROUP BY w"""
)
def name_valid(t):
    w = t.documents.select(F.explode(F.split(F.regexp_replace("text", "[^!-~]+", " "), " ")).alias("name"))
    return w.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n", text.valid_name(F.col("name")).alias("valid"))


_PATHS = "SELECT doc_id, concat('/repo/', source, '/', CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END, '/', CASE doc_id % 5 WHEN 0 THEN 'build' WHEN 1 THEN '.git' ELSE 'lib' END, '/', CASE doc_id % 3 WHEN 0 THEN '.x' ELSE 'x' END, CAST(doc_id AS STRING), '.py') AS p FROM documents"


def _paths(t):
    return t.spark.sql(_PATHS.replace("FROM documents", "FROM {documents}"), documents=t.documents)


@query(f"""SELECT doc_id, len(list_filter(string_split(p, '/')[3:], lambda x: x IN {_names(list(text.IGNORED_DIRS))} OR x LIKE '.%')) > 0 AS skipped FROM ({_PATHS})""")
def skip_paths(t):
    return _paths(t).select("doc_id", text.skipped_path(F.col("p"), "/repo").alias("skipped"))


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split(p, '/'), lambda x, i: i = 1 OR x <> string_split(p, '/')[i - 1]), '/') AS path FROM ({_PATHS})""")
def norm_path(t):
    return _paths(t).select("doc_id", text.normal_path(F.col("p")).alias("path"))


@query("SELECT qualified_name, CASE WHEN language = 'python' THEN replace(regexp_replace(filepath, '\\.[^./]*$', ''), '/', '.') ELSE regexp_replace(filepath, '/[^/]*$', '') END AS module FROM chunks", "chunks")
def module_path(t):
    return t.chunks.select("qualified_name", text.module_path(F.col("filepath"), F.col("language")).alias("module"))


_CS = "SELECT doc_id, concat(source, '/', 'F', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.cs' WHEN 1 THEN '.py' ELSE '.h' END) AS p, CASE WHEN doc_id % 2 = 0 THEN concat('using X;', chr(10), 'namespace N.', lang, ' {', text) ELSE text END AS c FROM documents"


@query(
    f"""SELECT doc_id, CASE WHEN p LIKE '%.py' THEN replace(regexp_replace(p, '\\.[^./]*$', ''), '/', '.') || '.py' WHEN p LIKE '%.cs' AND regexp_extract(c, 'namespace\\s+([A-Za-z0-9_.]+)', 1) <> '' THEN regexp_extract(c, 'namespace\\s+([A-Za-z0-9_.]+)', 1) || '.' || regexp_extract(p, '[^/]*$') ELSE regexp_extract(p, '[^/]*$') END AS qn FROM ({_CS})"""
)
def file_qn(t):
    rows = t.spark.sql(_CS.replace(" {'", " {{'").replace("FROM documents", "FROM {documents}"), documents=t.documents)
    return rows.select("doc_id", text.file_qualified_name(F.col("p"), F.col("c")).alias("qn"))


@query("SELECT qualified_name, 'Name: ' || name || chr(10) || 'Type: ' || type || chr(10) || 'Summary: ' || content || chr(10) || 'Path: ' || filepath AS embed FROM chunks", "chunks")
def embed_text(t):
    return t.chunks.select("qualified_name", text.embed_text(F.col("name"), F.col("type"), F.col("content"), F.col("filepath")).alias("embed"))


@query(
    f"""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations) SELECT conv_id, turn, CASE WHEN length(s) < 80 THEN '{text.SHORT_CODE}' || regexp_replace(s, '\\s+', ' ', 'g') || '`' END AS summary FROM x"""
)
def short_summary(t):
    return t.conversations.select("conv_id", "turn", text.short_summary(F.col("text")).alias("summary"))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '... (truncated)' ELSE text END AS code FROM documents")
def summary_input(t):
    return t.documents.select("doc_id", text.summary_input(F.col("text")).alias("code"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '{', '&#123;'), '}', '&#125;'), '<', '&lt;'), '>', '&gt;') AS mdx FROM documents")
def doc_escape(t):
    return t.documents.select("doc_id", text.escape_mdx(F.col("text")).alias("mdx"))


@query(
    "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(doc_id % 3 AS INT) AS a, CAST(doc_id % 7 AS INT) AS b FROM documents) SELECT doc_id, regexp_replace(CASE WHEN least(b, len(l)) >= greatest(1, a) THEN array_to_string(l[greatest(1, a):least(b, len(l))], chr(10)) ELSE '' END, '\\s+$', '') AS code FROM x"
)
def source_lines(t):
    return t.documents.select("doc_id", text.source_lines(F.col("text"), (F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 7).cast("int")).alias("code"))


@query(
    "WITH x AS (SELECT conv_id, turn, concat(text, CASE turn % 4 WHEN 0 THEN ' .cs file' WHEN 1 THEN ' Exception here' ELSE '' END) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN contains(q, '.cs') OR contains(q, '.xaml') OR contains(q, 'ViewModel') OR contains(q, 'Binding') THEN 'csharp' ELSE 'python' END AS language, regexp_matches(lower(q), 'traceback|exception|error at') AS has_traceback FROM x"
)
def route_fallback(t):
    q = F.expr("concat(text, CASE turn % 4 WHEN 0 THEN ' .cs file' WHEN 1 THEN ' Exception here' ELSE '' END)")
    return t.conversations.select("conv_id", "turn", text.routed_language(q).alias("language"), text.has_traceback(q).alias("has_traceback"))


@query(
    "WITH x AS (SELECT event_id, concat('please help ', error_text, CASE WHEN event_id % 3 = 0 THEN concat(chr(10), chr(10), 'thanks') ELSE '' END) AS q FROM traces) SELECT event_id, CASE WHEN regexp_extract(q, '(?s)(Traceback.*?)(?:\\n\\n|\\z)', 1) <> '' THEN regexp_extract(q, '(?s)(Traceback.*?)(?:\\n\\n|\\z)', 1) ELSE q END AS block FROM x",
    "traces",
)
def traceback_block(t):
    q = F.expr("concat('please help ', error_text, CASE WHEN event_id % 3 = 0 THEN concat(chr(10), chr(10), 'thanks') ELSE '' END)")
    return t.traces.select("event_id", text.traceback_block(q).alias("block"))


@query(f"SELECT conv_id, turn, replace(replace(q, '<thinking>', '{text.THINKING}'), '</thinking>', '{text.THOUGHT}') AS shown FROM (SELECT conv_id, turn, concat('<thinking>', text, '</thinking> so ', text, CASE WHEN turn % 2 = 0 THEN ' <thinking> a < b' ELSE '' END) AS q FROM conversations)")
def answer_shown(t):
    q = F.expr("concat('<thinking>', text, '</thinking> so ', text, CASE WHEN turn % 2 = 0 THEN ' <thinking> a < b' ELSE '' END)")
    return t.conversations.select("conv_id", "turn", text.thinking_tags(q).alias("shown"))


@query("""SELECT event_id, list_sort(list_distinct(regexp_extract_all(error_text, 'File "([^"]+)"', 1) || regexp_extract_all(error_text, 'in ([^:]+\\.cs):line', 1))) AS files FROM traces""", "traces")
def query_files(t):
    return t.traces.select("event_id", text.traceback_files(F.col("error_text")).alias("files"))


@query("SELECT conv_id, turn, CASE WHEN length(k) < 5 THEN text ELSE k END AS search_text FROM (SELECT conv_id, turn, text, array_to_string(string_split(text, ' ')[1:turn % 3 + 1], ' ') AS k FROM conversations)")
def search_query_rule(t):
    k = F.expr("slice(split(text, ' '), 1, CAST(turn % 3 + 1 AS INT))")
    return t.conversations.select("conv_id", "turn", text.search_text(k, F.col("text")).alias("search_text"))


# --- graph -----------------------------------------------------------------------------------------------------------
_SEED = "'1'"


def _bfs(depth: int, reverse: bool = False, seed: str = _SEED, edges: str = "call_edges") -> str:
    a, b = ("callee_qn", "caller_qn") if reverse else ("caller_qn", "callee_qn")
    return f"""WITH RECURSIVE r AS (SELECT {b} AS qn, 1 AS depth FROM {edges} WHERE {a} = {seed}
UNION SELECT e.{b}, r.depth + 1 FROM r JOIN {edges} e ON e.{a} = r.qn WHERE r.depth < {depth} AND e.{b} <> {seed} AND r.qn <> {seed})
SELECT qn, min(depth) AS depth FROM r GROUP BY qn"""


@query(_bfs(3), "call_edges")
def callees_recursive(t):
    return graph.reachable(t.call_edges, "1", 3)


@query(_bfs(3, True), "call_edges")
def callers_recursive(t):
    return graph.reachable(t.call_edges, "1", 3, reverse=True)


@query(
    f"""WITH RECURSIVE b AS (SELECT caller_qn AS qn, 1 AS d FROM call_edges WHERE callee_qn = '7'
UNION SELECT e.caller_qn, b.d + 1 FROM b JOIN call_edges e ON e.callee_qn = b.qn WHERE b.d < 6),
k AS (SELECT qn, min(d) AS d FROM b GROUP BY qn),
p AS (SELECT callee_qn AS node, [caller_qn, callee_qn] AS path FROM call_edges WHERE caller_qn = {_SEED}
UNION ALL SELECT e.callee_qn, list_append(p.path, e.callee_qn) FROM p JOIN k ON k.qn = p.node AND k.d + len(p.path) - 1 <= 6 JOIN call_edges e ON e.caller_qn = p.node WHERE len(p.path) <= 6 AND NOT list_contains(p.path, e.callee_qn) AND p.node <> '7')
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM p WHERE node = '7'""",
    "call_edges",
)
def call_paths(t):
    """All simple paths of up to 6 edges, the operator's own depth."""
    return graph.call_paths(t.call_edges, "1", "7").select(F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


_FLOW = f"SELECT 'Caller' AS side, depth, qn, '[Caller|depth=' || depth || '] ' || qn AS line FROM ({_bfs(2, True)}) UNION ALL SELECT 'Callee', depth, qn, '[Callee|depth=' || depth || '] ' || qn FROM ({_bfs(2)})"


@query(_FLOW, "call_edges")
def exec_flow(t):
    return graph.execution_flow(t.call_edges, "1", 2)


@query(f"SELECT DISTINCT '[Caller] called by ' || caller_qn AS line FROM call_edges WHERE callee_qn = {_SEED} UNION SELECT '[Callee] calls ' || callee_qn FROM call_edges WHERE caller_qn = {_SEED}", "call_edges")
def exec_flow_1hop(t):
    return graph.one_hop_flow(t.call_edges, "1")


@query(f"SELECT DISTINCT callee_qn FROM call_edges WHERE caller_qn = {_SEED}", "call_edges")
def direct_callees(t):
    return graph.direct_callees(t.call_edges, "1")


@query("SELECT callee_qn, CAST(0 AS BIGINT) AS page, list_sort(list(DISTINCT caller_qn)) AS callers, count(DISTINCT caller_qn) AS n FROM call_edges GROUP BY callee_qn", "call_edges")
def reverse_edges(t):
    """No callee of these tables has more callers than one page takes."""
    return graph.reverse_edges(t.call_edges)


@query("SELECT c.qualified_name, r.called_by FROM chunks c LEFT JOIN (SELECT callee_qn, list_sort(list(DISTINCT caller_qn)) AS called_by FROM doc_edges GROUP BY callee_qn) r ON r.callee_qn = c.qualified_name", "chunks", "doc_edges")
def called_by(t):
    return graph.with_called_by(t.chunks, t.doc_edges).select("qualified_name", "called_by")


@query("SELECT caller_qn, callee_qn, direction FROM (SELECT caller_qn, called_name AS callee_qn, 'forward' AS direction FROM calls UNION ALL SELECT e.caller_qn, e.callee_qn, 'reverse' FROM doc_edges e JOIN chunks c ON c.qualified_name = e.callee_qn)", "chunks", "calls", "doc_edges")
def raw_graph(t):
    calls = t.calls.groupBy("caller_qn").agg(F.collect_list("called_name").alias("calls"))
    rows = t.chunks.join(calls, F.col("qualified_name") == F.col("caller_qn"))
    return graph.raw_edges(graph.with_called_by(rows.select("qualified_name", "calls"), t.doc_edges))


@query(
    "WITH k AS (SELECT conv_id AS chain_id, generate_subscripts AS i, qn FROM (SELECT conv_id, unnest(range(0, 4)) AS generate_subscripts, unnest(['src0.en.d0', 'nowhere', concat('src', conv_id % 20, '.en.d', conv_id), concat('src', (conv_id + 1) % 20, '.en.d', conv_id + 1)]) AS qn FROM (SELECT DISTINCT conv_id FROM conversations))) SELECT chain_id, '## Call Chain:' || chr(10) || chr(10) || string_agg(repeat('  ', i) || '↓ ' || name || ' (' || filepath || ')', chr(10) ORDER BY i) AS text FROM k JOIN chunks ON qualified_name = qn GROUP BY chain_id",
    "chunks",
)
def call_chain(t):
    chain = t.conversations.select(F.col("conv_id").alias("chain_id")).distinct()
    chain = chain.withColumn("chain", F.expr("array('src0.en.d0', 'nowhere', concat('src', chain_id % 20, '.en.d', chain_id), concat('src', (chain_id + 1) % 20, '.en.d', chain_id + 1))"))
    return graph.call_chain(chain, t.chunks)


_HITS = "hits AS (SELECT qualified_name, row_number() OVER (ORDER BY qualified_name) - 1 AS position FROM (SELECT qualified_name FROM chunks WHERE type = 'function' ORDER BY qualified_name LIMIT 8))"


def _hits(t):
    top = t.chunks.where(F.col("type") == "function").orderBy("qualified_name").limit(8)
    return search.ranked(top.select("qualified_name", F.lit(0.0).alias("score")), "qualified_name", 0).select(F.col("id").alias("qualified_name"), F.col("rank").alias("position"))


@query(
    f"""WITH {_HITS}, a1 AS (SELECT h.qualified_name, 'Callee' AS side, callee_qn AS qn, 1 AS depth FROM hits h JOIN doc_edges ON caller_qn = h.qualified_name UNION ALL SELECT h.qualified_name, 'Caller', caller_qn, 1 FROM hits h JOIN doc_edges ON callee_qn = h.qualified_name),
a2 AS (SELECT a.qualified_name, side, CASE side WHEN 'Callee' THEN e.callee_qn ELSE e.caller_qn END AS qn, 2 AS depth FROM a1 a JOIN doc_edges e ON a.qn = CASE side WHEN 'Callee' THEN e.caller_qn ELSE e.callee_qn END WHERE a.qn <> a.qualified_name),
f AS (SELECT qualified_name, side, qn, min(depth) AS depth FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 WHERE qn <> qualified_name) GROUP BY ALL),
flow AS (SELECT qualified_name, list_sort(list('[' || side || '|depth=' || depth || '] ' || qn)) AS flow FROM f GROUP BY 1),
code AS (SELECT a.qualified_name, list_sort(list(DISTINCT a.qn)) AS related FROM a1 a JOIN hits h USING (qualified_name) JOIN chunks c ON c.qualified_name = a.qn WHERE side = 'Callee' AND position < 3 GROUP BY 1)
SELECT h.qualified_name, position, coalesce(flow, []) AS flow, coalesce(related, []) AS related FROM hits h LEFT JOIN flow USING (qualified_name) LEFT JOIN code USING (qualified_name)""",
    "chunks",
    "doc_edges",
)
def graph_context(t):
    out = graph.chunk_context(_hits(t), t.doc_edges, t.chunks)
    return out.withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_HITS} SELECT DISTINCT c.qualified_name, c.filepath FROM hits h JOIN doc_edges e ON e.caller_qn = h.qualified_name JOIN chunks c ON c.qualified_name = e.callee_qn WHERE h.position < 5 AND c.qualified_name NOT IN (SELECT qualified_name FROM hits)", "chunks", "doc_edges")
def callee_expansion(t):
    return graph.callee_expansion(_hits(t), t.doc_edges, t.chunks).select("qualified_name", "filepath")


@query("SELECT DISTINCT c.qualified_name, c.content FROM doc_edges e JOIN chunks c ON c.qualified_name = e.callee_qn WHERE e.caller_qn = 'src0.en.d0' OR e.caller_qn = (SELECT min(qualified_name) FROM chunks)", "chunks", "doc_edges")
def related_code(t):
    first = t.chunks.agg(F.min("qualified_name")).first()[0]
    seeds = t.doc_edges.where(F.col("caller_qn").isin("src0.en.d0", first))
    return t.chunks.join(seeds, F.col("qualified_name") == F.col("callee_qn"), "left_semi").select("qualified_name", "content")


_ASKED = "who calls Part or d7 and what"
_HOP = "SELECT '[Caller|depth=1] ' || caller_qn AS line FROM named_edges WHERE callee_qn IN ('who', 'calls', 'Part') UNION ALL SELECT '[Callee|depth=1] ' || callee_qn FROM named_edges WHERE caller_qn IN ('who', 'calls', 'Part')"


def _named_flow(side: str) -> str:
    a, b = ("callee_qn", "caller_qn") if side == "Caller" else ("caller_qn", "callee_qn")
    return f"SELECT '[{side}|depth=' || min(depth) || '] ' || qn AS line FROM (SELECT {b} AS qn, 1 AS depth FROM named_edges WHERE {a} = 'who' UNION SELECT y.{b}, 2 FROM named_edges x JOIN named_edges y ON y.{a} = x.{b} WHERE x.{a} = 'who' AND x.{b} <> 'who' AND y.{b} <> 'who') GROUP BY qn"


@query(
    f"""SELECT 'line' AS kind, line AS value FROM ({_named_flow('Caller')} UNION ALL {_named_flow('Callee')} UNION ALL {_HOP}) UNION ALL
SELECT 'code', c.qualified_name || ': ' || c.content FROM chunks c WHERE 'who' || c.qualified_name IN (SELECT 'who' || callee_qn FROM (SELECT DISTINCT callee_qn FROM named_edges WHERE caller_qn = 'who' ORDER BY 1 LIMIT 5))""",
    "named_edges",
)
def graph_question(t):
    """The whole tool: a seed and names that are nodes, their flows, and the code of the seed's first callees."""
    from siltstone.session import CodeEngine

    lines, code = CodeEngine(t.spark, "", chunks=t.chunks, edges=t.named_edges).query_knowledge_graph(_ASKED, "who")
    return lines.select(F.lit("line").alias("kind"), F.col("line").alias("value")).unionByName(code.select(F.lit("code").alias("kind"), F.concat("qualified_name", F.lit(": "), "content").alias("value")))


# --- name resolution -------------------------------------------------------------------------------------------------
_INDEX = "idx AS (SELECT name, count(*) AS n, arg_min(qualified_name, ord) AS first_qn FROM chunks WHERE type IN ('function', 'method') GROUP BY name)"
_PY = f"""{_INDEX}, al AS (SELECT owner_qn, alias, min(target_qn) AS target_qn FROM imports GROUP BY 1, 2),
py AS (SELECT k.caller_qn, k.call_pos, k.called_name, coalesce(c.qualified_name, al.target_qn, idx.first_qn) AS target_qn, CASE WHEN c.qualified_name IS NOT NULL THEN 1 WHEN al.target_qn IS NOT NULL THEN 2 WHEN idx.first_qn IS NOT NULL THEN 3 ELSE 0 END AS stage
FROM calls k LEFT JOIN chunks c ON c.qualified_name = k.module_path || '.' || k.called_name LEFT JOIN al ON al.owner_qn = k.caller_qn AND al.alias = k.called_name LEFT JOIN idx ON idx.name = k.called_name AND idx.n = 1 WHERE k.language = 'python')"""
_NS = "regexp_replace({0}, '\\.[^.]*$', '')"
_CSHARP = f"""cs AS (SELECT k.caller_qn, k.call_pos, k.called_name, CASE WHEN c.qualified_name IS NOT NULL THEN c.qualified_name WHEN idx.n = 1 THEN idx.first_qn ELSE coalesce(nr.qn, idx.first_qn) END AS target_qn,
 CASE WHEN c.qualified_name IS NOT NULL THEN 1 WHEN idx.n = 1 THEN 2 WHEN nr.qn IS NOT NULL THEN 3 WHEN idx.first_qn IS NOT NULL THEN 4 ELSE 0 END AS stage
FROM calls k LEFT JOIN chunks c ON c.qualified_name = {_NS.format('k.caller_qn')} || '.' || k.called_name LEFT JOIN idx ON idx.name = k.called_name
LEFT JOIN (SELECT name, {_NS.format('qualified_name')} AS ns, arg_min(qualified_name, ord) AS qn FROM chunks WHERE type IN ('function', 'method') GROUP BY 1, 2) nr ON nr.name = k.called_name AND nr.ns = {_NS.format('k.caller_qn')} WHERE k.language = 'c_sharp')"""
_BOUND = "concat(content, ' {Binding Path=d', CAST((doc_id * 3) % 401 AS STRING), '.Text} {Binding u', CAST(doc_id - doc_id % 3 AS STRING), '}')"
_XAML = f"""vw AS (SELECT qualified_name AS caller_qn, replace(name, '.xaml', '') AS view, regexp_extract_all({_BOUND}, '\\{{Binding\\s+(?:Path=)?([a-zA-Z0-9_.]+)', 1) AS found FROM chunks WHERE language = 'xaml'),
bd AS (SELECT caller_qn, view, unnest(found) AS b, unnest(range(0, len(found))) AS pos FROM vw), pr AS (SELECT name AS property, qualified_name AS target, ord FROM chunks WHERE type = 'property'),
xm AS (SELECT caller_qn, string_split(b, '.')[1] AS property, pos, coalesce(arg_min(target, ord) FILTER (WHERE contains(target, view || 'Model')), arg_min(target, ord)) AS target_qn FROM bd JOIN pr ON pr.property = string_split(b, '.')[1] GROUP BY caller_qn, b, pos, view)"""


def _bound(t):
    return t.chunks.withColumn("content", F.expr(_BOUND))


@query(f"WITH {_PY} SELECT * FROM py", "calls", "imports")
def resolve_python(t):
    return resolve.resolve_python(t.calls, t.imports, t.chunks).select("caller_qn", "call_pos", "called_name", "target_qn", "stage")


@query(f"WITH {_INDEX}, {_CSHARP} SELECT * FROM cs", "calls")
def resolve_csharp(t):
    return resolve.resolve_csharp(t.calls, t.chunks).select("caller_qn", "call_pos", "called_name", "target_qn", "stage")


@query(f"WITH {_XAML} SELECT * FROM xm", "chunks")
def resolve_bindings(t):
    return resolve.resolve_bindings(_bound(t)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_PY}, {_CSHARP}, {_XAML} SELECT DISTINCT caller_qn, target_qn AS callee_qn FROM (SELECT caller_qn, target_qn FROM py UNION ALL SELECT caller_qn, target_qn FROM cs UNION ALL SELECT caller_qn, target_qn FROM xm) WHERE target_qn IS NOT NULL", "calls", "imports")
def graph_build(t):
    return resolve.build_edges(t.calls, t.imports, _bound(t))


@query("SELECT name, count(*) AS n, arg_min(qualified_name, ord) AS first_qn FROM chunks WHERE type IN ('function', 'method') GROUP BY name", "chunks")
def name_index(t):
    return resolve.name_index(t.chunks)


# --- store and change detection --------------------------------------------------------------------------------------
@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def file_md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"))


_DIFF = "SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN n.md5 IS NULL THEN 'deleted' WHEN o.md5 IS NULL THEN 'new' WHEN o.md5 <> n.md5 THEN 'changed' ELSE 'same' END AS status, coalesce(n.md5, o.md5) AS md5 FROM file_state_old o FULL JOIN file_state_new n ON o.rel_path = n.rel_path"


@query(_DIFF, "file_state_old", "file_state_new")
def diff_files(t):
    return store.changed_files(t.file_state_old, t.file_state_new)


@query(f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status", "file_state_old", "file_state_new")
def change_counts(t):
    return store.changed_files(t.file_state_old, t.file_state_new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rel_path FROM file_state_old EXCEPT SELECT rel_path FROM file_state_new", "file_state_old", "file_state_new")
def deleted_files(t):
    return store.deleted_files(t.file_state_old, t.file_state_new)


@query(
    "SELECT id, qualified_name, name, content FROM (SELECT coalesce(o.id, n.id) AS id, n.qualified_name, n.name, n.content FROM (SELECT qualified_name, 'new' || name AS name, content || '!' AS content, 'n' || doc_id AS id FROM chunks WHERE language <> 'cpp') n LEFT JOIN (SELECT 'o' || doc_id AS id, qualified_name FROM chunks WHERE type <> 'file') o ON o.qualified_name = n.qualified_name UNION ALL SELECT 'o' || doc_id, qualified_name, name, content FROM chunks WHERE type <> 'file' AND language = 'cpp')",
    "chunks",
)
def upsert_last_wins(t):
    old = t.chunks.where("type <> 'file'").select(F.concat(F.lit("o"), "doc_id").alias("id"), "qualified_name", "name", "content")
    new = t.chunks.where("language <> 'cpp'").select(F.concat(F.lit("n"), "doc_id").alias("id"), "qualified_name", F.concat(F.lit("new"), "name").alias("name"), F.concat("content", F.lit("!")).alias("content"))
    return store.upsert(old, new)


@query(
    "WITH x AS (SELECT *, CASE WHEN type = 'class' THEN '' ELSE module_path || '.' || name END AS qn FROM chunks), k AS (SELECT *, coalesce(nullif(qn, ''), filepath || '_' || name || '_' || start_line) AS key FROM x) SELECT key, min(ord) AS place, arg_max(doc_id, ord) AS doc_id FROM k GROUP BY key",
    "chunks",
)
def dedup_chunks(t):
    rows = t.chunks.withColumn("qualified_name", F.when(F.col("type") == "class", "").otherwise(F.concat_ws(".", "module_path", "name")))
    return store.dedup_batch(rows, "ord").select("key", "place", "doc_id")


@query("SELECT caller_qn, callee_qn FROM call_edges WHERE caller_qn < '5' UNION SELECT caller_qn, callee_qn FROM call_edges WHERE caller_qn > '3'", "call_edges")
def insert_edges_ignore(t):
    return store.insert_new_edges(t.call_edges.where("caller_qn < '5'"), t.call_edges.where("caller_qn > '3'"))


@query("SELECT DISTINCT e.* FROM call_edges e JOIN part a ON CAST(a.p_partkey AS VARCHAR) = e.caller_qn AND a.p_size > 20 JOIN part b ON CAST(b.p_partkey AS VARCHAR) = e.callee_qn AND b.p_size > 20", "call_edges")
def checked_edges(t):
    nodes = t.part.where("p_size > 20").select(F.col("p_partkey").cast("string").alias("qualified_name"))
    return store.checked_edges(t.call_edges, nodes)


@query("SELECT doc_id, list_filter(string_split(text, '.') || ['__vm_context__:a b', repeat('x', 200), repeat('x', 201)], lambda c: starts_with(c, '__vm_context__:') OR (length(c) <= 200 AND NOT contains(c, ' ') AND NOT contains(c, '#'))) AS calls FROM documents")
def filter_calls(t):
    calls = F.concat(F.split("text", r"\."), F.array(F.lit("__vm_context__:a b"), F.lit("x" * 200), F.lit("x" * 201)))
    return t.documents.select("doc_id", text.storable_calls(calls).alias("calls"))


# --- errors ----------------------------------------------------------------------------------------------------------
_ERR = """frames AS (SELECT event_id, error_text, CASE WHEN contains(error_text, 'Traceback (most recent call last):') THEN 'python' ELSE 'csharp' END AS language,
 CASE WHEN contains(error_text, 'Traceback (most recent call last):') THEN regexp_extract_all(error_text, 'File "([^"]+)",\\s*line\\s*(\\d+),\\s*in\\s*(\\S+)') ELSE regexp_extract_all(error_text, 'at\\s+([^\\s]+)\\s+in\\s+([^:]+):line\\s+(\\d+)') END AS m FROM traces),
one AS (SELECT event_id, language, error_text, unnest(m) AS f, unnest(range(0, len(m))) AS pos, len(m) AS depth FROM frames),
err AS (SELECT event_id, pos, depth, language, CASE language WHEN 'python' THEN regexp_extract(f, 'File "([^"]+)"', 1) ELSE regexp_extract(f, 'in\\s+([^:]+):line', 1) END AS filepath,
 CAST(CASE language WHEN 'python' THEN regexp_extract(f, 'line\\s*(\\d+)', 1) ELSE regexp_extract(f, 'line\\s+(\\d+)', 1) END AS INT) AS line_number,
 CASE language WHEN 'python' THEN regexp_extract(f, 'in\\s*(\\S+)$', 1) ELSE replace(regexp_extract(f, '\\.([^.\\s]+)\\s+in', 1), '()', '') END AS function_name,
 CASE language WHEN 'python' THEN trim(string_split(error_text, chr(10))[list_position(list_transform(string_split(error_text, chr(10)), lambda x: contains(x, f)), true) + 1]) ELSE '' END AS code_snippet,
 CASE language WHEN 'python' THEN 'ValueError' ELSE 'NullReferenceException' END AS error_type, CASE language WHEN 'python' THEN 'v' ELSE 'n' END || event_id AS error_message FROM one)"""


@query(f"WITH {_ERR} SELECT event_id, pos, language, filepath, line_number, function_name, code_snippet, error_type, error_message FROM err", "traces")
def parse_traces(t):
    rows = t.traces.select("event_id", F.posexplode(errors.frames(F.col("error_text"))).alias("pos", "f"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), "f.language", "f.filepath", "f.line_number", "f.function_name", "f.code_snippet", "f.error_type", "f.error_message")


@query(
    "SELECT event_id, CASE WHEN contains(x, 'Traceback (most recent call last):') THEN 'python' WHEN contains(x, 'at System.') OR contains(x, 'at Microsoft.') OR contains(x, 'System.Exception:') OR contains(x, '   at ') OR contains(x, '.cs:line') OR contains(x, '.cs''') THEN 'csharp' ELSE 'python' END AS language FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type ELSE error_text END AS x FROM traces JOIN events USING (event_id))",
    "traces",
)
def detect_trace_lang(t):
    rows = t.traces.join(t.events.select("event_id", "event_type"), "event_id")
    return rows.select("event_id", errors.trace_language(F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("error_text"))).alias("language"))


_TYPES = sorted({**errors.PYTHON_LEVELS, **errors.CSHARP_LEVELS, "Strange": ""})
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**errors.CSHARP_LEVELS, **errors.PYTHON_LEVELS}.items())


@query(f"SELECT e AS error_type, CASE e {_CASE} ELSE 'Level2' END AS level, count(*) AS n FROM (SELECT [{', '.join(repr(x) for x in _TYPES)}][CAST(event_id % {len(_TYPES)} + 1 AS INT)] AS e FROM events) GROUP BY e")
def severity(t):
    e = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    return t.events.select(e.alias("error_type")).select("error_type", errors.severity(F.col("error_type")).alias("level")).groupBy("error_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ERR} SELECT error_type, count(DISTINCT event_id) AS n_errors, count(*) AS n_frames FROM err GROUP BY error_type", "traces")
def error_counts(t):
    d = errors.diagnosed(t.traces)
    return d.groupBy(F.col("location.error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("n_errors"), F.sum("depth").alias("n_frames"))


@query(f"WITH {_ERR} SELECT event_id, true AS success, max(depth) AS depth, arg_max(filepath, pos) AS filepath, arg_max(line_number, pos) AS line_number FROM err GROUP BY event_id", "traces")
def quick_check(t):
    return errors.diagnosed(t.traces).select("event_id", "success", F.col("depth").cast("long").alias("depth"), "location.filepath", "location.line_number")


@query(
    f"""WITH {_ERR} SELECT event_id, CASE arg_max(error_type, pos) {_CASE} END AS severity, arg_max(function_name, pos) AS location, CASE WHEN max(depth) > 1 THEN arg_min(function_name, pos) END AS root_cause,
string_agg(repeat('  ', CAST(pos AS BIGINT)) || '→ ' || function_name || ' (' || filepath || ':' || line_number || ')', chr(10) ORDER BY pos) AS chain, arg_max(filepath || ' ' || function_name, pos) AS search_text, arg_max(error_type || ' ' || function_name, pos) AS similar_text FROM err GROUP BY event_id""",
    "traces",
)
def diagnose(t):
    return errors.diagnosed(t.traces).select("event_id", "severity", F.col("location.function_name").alias("location"), F.col("root_cause.function_name").alias("root_cause"), "chain", "search_text", "similar_text")


@query(f"WITH {_ERR} SELECT filepath, count(DISTINCT event_id) AS n FROM err GROUP BY filepath", "traces")
def related_files(t):
    return errors.diagnosed(t.traces).select("event_id", F.explode("related_files").alias("filepath")).groupBy("filepath").agg(F.count(F.lit(1)).alias("n"))


_BROKEN = "CASE WHEN event_id % 10 = 3 THEN concat('all is well ', error_text) WHEN event_id % 10 = 7 THEN NULL ELSE error_text END"


@query(
    f"""WITH {_ERR.replace("FROM traces)", f"FROM (SELECT event_id, regexp_replace({_BROKEN}, '^all is well .*', 'all is well', 's') AS error_text FROM traces) x)", 1)}, a AS (SELECT event_id, max(depth) AS depth, any_value(error_type) AS error_type,
string_agg(repeat('  ', CAST(pos AS BIGINT)) || '→ ' || function_name || ' (' || filepath || ':' || line_number || ')', chr(10) ORDER BY pos) AS chain FROM err GROUP BY event_id)
SELECT f.event_id // 10 AS batch, f.event_id, a.depth IS NOT NULL AS success, a.error_type, CASE a.error_type {_CASE} END AS severity, CASE WHEN f.error_text IS NOT NULL THEN coalesce(a.depth, 0) END AS depth, CASE WHEN a.depth IS NULL THEN 'no frames' END AS failure, left(coalesce(a.chain, f.error_text, ''), 200) AS summary FROM frames f LEFT JOIN a USING (event_id)""",
    "traces",
)
def batch_analyze(t):
    """Every trace, in batches of ten, with texts among them that hold no frame and texts that are missing."""
    rows = t.traces.select("event_id", F.regexp_replace(F.expr(_BROKEN), "(?s)^all is well .*", "all is well").alias("error_text"))
    return errors.batch(rows, "event_id").select(F.floor(F.col("event_id") / errors.BATCH).cast("long").alias("batch"), "*")


@query(f"SELECT {len(errors.PYTHON_LEVELS)} AS python_types, {len(errors.CSHARP_LEVELS)} AS csharp_types, count(*) AS index_size, count(*) > 0 AS ready FROM chunks", "chunks")
def stats_row(t):
    return t.chunks.agg(F.lit(len(errors.PYTHON_LEVELS)).alias("python_types"), F.lit(len(errors.CSHARP_LEVELS)).alias("csharp_types"), F.count(F.lit(1)).alias("index_size"), (F.count(F.lit(1)) > 0).alias("ready"))


_SIMILAR = 'Traceback (most recent call last):\n  File "of.py", line 3, in la\nValueError: una'


@query(_hybrid_sql("ValueError la", ["ValueError"], [], 3, "SELECT ranked.qualified_name, filepath, start_line, position FROM ranked JOIN vectors USING (qualified_name)"), "vectors")
def similar_errors(t):
    """The engine's hybrid search by an error's type and function."""
    out = t.engine(embedder=lambda _: [VECTOR]).similar_errors(_SIMILAR)
    return out.withColumn("position", F.col("position").cast("long"))


# --- contexts and documents ------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(length(text) // 3) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM conversations) WHERE running <= 300")
def token_budget(t):
    return context.within_budget(t.conversations, ["conv_id"], ["turn", "text"], "text", 300).select("conv_id", "turn", "running")


_NL = "chr(10)"


@query(
    f"""WITH x AS (SELECT filepath, qualified_name, start_line, language, type, content, row_number() OVER (PARTITION BY filepath ORDER BY start_line, qualified_name) AS i FROM chunks)
SELECT filepath, string_agg({_NL} || '    <file index="' || i || '" path="' || filepath || '" start_line="' || start_line || '" language="' || language || '" type="' || type || '">' || {_NL} || '<![CDATA[' || {_NL} || content || {_NL} || ']]>' || {_NL} || '    </file>' || {_NL}, '' ORDER BY i) AS xml FROM x GROUP BY filepath""",
    "chunks",
)
def context_xml(t):
    from pyspark.sql.window import Window

    rows = t.chunks.withColumn("i", F.row_number().over(Window.partitionBy("filepath").orderBy("start_line", "qualified_name")))
    return context.joined(rows, ["filepath"], ["i"], context.xml_item(F.col("i")), "", "xml")


@query(
    f"""WITH e AS (SELECT caller_qn, list_sort(list(callee_qn)) AS calls FROM doc_edges GROUP BY 1), b AS (SELECT callee_qn, list_sort(list(caller_qn)) AS called_by FROM doc_edges GROUP BY 1)
SELECT qualified_name, {_NL} || '## ' || qualified_name || {_NL} || '**File**: `' || filepath || ':' || start_line || '`' || {_NL} || '**Type**: ' || type || {_NL} || {_NL} || '### Code:' || {_NL} || '```' || language || {_NL} || content || {_NL} || '```' || {_NL} || {_NL} || '### Relationships:' || {_NL} || '- **Calls**: ' || coalesce(array_to_string(calls, ', '), 'None') || {_NL} || '- **Called by**: ' || coalesce(array_to_string(called_by, ', '), 'None') || {_NL} || '- **Imports**: None' || {_NL} || {_NL} || '---' || {_NL} AS md
FROM chunks LEFT JOIN e ON e.caller_qn = qualified_name LEFT JOIN b ON b.callee_qn = qualified_name""",
    "chunks",
    "doc_edges",
)
def context_md(t):
    calls = t.doc_edges.groupBy("caller_qn").agg(F.array_sort(F.collect_list("callee_qn")).alias("calls"))
    rows = graph.with_called_by(t.chunks, t.doc_edges).join(calls, F.col("qualified_name") == F.col("caller_qn"), "left")
    rows = rows.withColumn("docstring", F.lit(None).cast("string")).withColumn("imports", F.array().cast("array<string>"))
    return rows.select("qualified_name", context.markdown_item().alias("md"))


def _documented(t):
    return t.chunks.withColumn("summary", F.when(F.col("doc_id") % 4 != 0, F.col("content"))).withColumn("docstring", F.concat(F.lit("d "), "content"))


@query("SELECT filepath, count(*) FILTER (WHERE type <> 'file') AS n_elements, arg_max(CASE WHEN doc_id % 4 <> 0 THEN content ELSE 'd ' || content END, qualified_name) FILTER (WHERE type = 'file') AS file_summary FROM chunks GROUP BY filepath", "chunks")
def doc_groups(t):
    return context.file_groups(_documented(t))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '{{', '&#123;'), '}}', '&#125;'), '<', '&lt;'), '>', '&gt;')"
_DESC = _ESC.format("split_part(CASE WHEN doc_id % 4 <> 0 THEN content ELSE 'd ' || content END, chr(10), 1)")


@query(
    f"""SELECT filepath, string_agg('| ' || CASE WHEN contains(type, 'class') THEN '📦' WHEN contains(type, 'property') THEN '🔧' WHEN contains(type, 'method') THEN '⚡' ELSE '🔹' END || ' `' || type || '` | [**' || name || '**](#' || lower(name) || ') | ' || CASE WHEN {_DESC} = '' THEN '-' ELSE {_DESC} END || ' |', chr(10) ORDER BY start_line, qualified_name) AS contents FROM chunks WHERE type <> 'file' GROUP BY filepath""",
    "chunks",
)
def doc_contents_table(t):
    rows = _documented(t).where("type <> 'file'")
    return context.joined(rows, ["filepath"], ["start_line", "qualified_name"], context.contents_line(), "\n", "contents")


_SUM, _DOC = "CASE WHEN doc_id % 4 <> 0 THEN content END", "'d ' || content"
_BODY = f"""'### ' || name || {_NL} || {_NL} || '{context.TYPE_BADGE}' || type || '</span> {context.NAME_BADGE}' || {_ESC.format('qualified_name')} || '</span>' || {_NL} || {_NL} || coalesce({_ESC.format(_SUM)} || {_NL} || {_NL}, '') || '**Docstring:**' || {_NL} || {_ESC.format('(' + _DOC + ')')} || {_NL} || {_NL} || '```' || language || {_NL} || content || {_NL} || '```' || {_NL} || {_NL} || '<br/>' || {_NL} || {_NL}"""
_LINE = f"'| ' || CASE WHEN contains(type, 'class') THEN '📦' WHEN contains(type, 'property') THEN '🔧' WHEN contains(type, 'method') THEN '⚡' ELSE '🔹' END || ' `' || type || '` | [**' || name || '**](#' || lower(name) || ') | ' || CASE WHEN {_DESC} = '' THEN '-' ELSE {_DESC} END || ' |'"


@query(
    f"""WITH g AS (SELECT filepath, regexp_extract(filepath, '[^/]*$') AS n, regexp_replace(filepath, '/[^/]*$', '') AS folder, arg_max(CASE WHEN doc_id % 4 <> 0 THEN content ELSE 'd ' || content END, qualified_name) FILTER (WHERE type = 'file') AS s,
 string_agg({_LINE}, chr(10) ORDER BY start_line, qualified_name) FILTER (WHERE type <> 'file') AS t, string_agg({_BODY}, '' ORDER BY start_line, qualified_name) FILTER (WHERE type <> 'file') AS b FROM chunks GROUP BY filepath)
SELECT filepath, folder, '---' || {_NL} || 'title: "' || n || '"' || {_NL} || 'sidebar_label: "' || n || '"' || {_NL} || '---' || {_NL} || {_NL} || '# 📄 ' || n || {_NL} || {_NL} || '{context.MODULE_BADGE}' || regexp_extract(folder, '[^/]*$') || '</span>' || {_NL} || {_NL} || coalesce(':::info 📝 File Overview' || {_NL} || {_ESC.format('s')} || {_NL} || ':::' || {_NL} || {_NL}, '') || '---' || {_NL} || {_NL}
 || coalesce('## 🗂️ Contents Summary' || {_NL} || {_NL} || '| Type | Name | Description |' || {_NL} || '|---|---|---|' || {_NL} || t || {_NL} || {_NL} || '---' || {_NL} || {_NL}, '') || '## 💻 Code Details' || {_NL} || {_NL} || coalesce(b, '') AS doc_md FROM g""",
    "chunks",
)
def doc_pages(t):
    return context.file_pages(_documented(t))


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY module_path, type IN ('class', 'method', 'function', 'view', 'file') ORDER BY qualified_name) AS rk, type IN ('class', 'method', 'function', 'view', 'file') AS core FROM chunks)
SELECT module_path AS folder, count(*) AS n_chunks, list_sort(list(DISTINCT regexp_extract(filepath, '[^/]*$'))) AS files, coalesce(list('- ' || type || ' [' || name || ']' ORDER BY qualified_name) FILTER (WHERE core AND rk <= 40), []) AS elements, replace(module_path, '/', '.') AS qualified_name FROM c GROUP BY module_path""",
    "chunks",
)
def folder_groups(t):
    return context.folder_groups(t.chunks)


@query(
    f"""WITH g AS (SELECT module_path AS folder, CASE WHEN count(*) % 2 = 0 THEN max(name) END AS s FROM chunks GROUP BY module_path)
SELECT folder, '---' || {_NL} || 'title: "📁 ' || folder || '"' || {_NL} || 'sidebar_position: 1' || {_NL} || '---' || {_NL} || {_NL} || '# 📁 `' || folder || '` Module' || {_NL} || {_NL} || ':::tip 📁 Folder Overview' || {_NL} || '**' || coalesce(s, '{context.NO_SUMMARY}') || '**' || {_NL} || ':::' || {_NL} || {_NL} || '---' || {_NL} || {_NL} || '{context.FOLDER_END.strip()}' || {_NL} AS doc_md FROM g""",
    "chunks",
)
def folder_pages(t):
    rows = t.chunks.groupBy(F.col("module_path").alias("filepath")).agg(F.when(F.count(F.lit(1)) % 2 == 0, F.max("name")).alias("summary"))
    return context.folder_pages(rows.withColumn("type", F.lit("folder")).withColumn("docstring", F.lit(None).cast("string")))


@query("SELECT filepath, string_agg('  ㄴ [' || type || '] ' || name || ' - ' || content, chr(10) ORDER BY start_line, qualified_name) AS toc FROM chunks WHERE type <> 'file' GROUP BY filepath", "chunks")
def file_toc(t):
    return context.file_tocs(t.chunks.withColumn("summary", F.col("content")))


_TOC = "(SELECT filepath, string_agg('  ㄴ [' || type || '] ' || name || ' - ' || content, chr(10) ORDER BY start_line, qualified_name) AS toc FROM chunks WHERE type <> 'file' GROUP BY filepath)"


@query(
    f"""SELECT c.qualified_name, 'about ' || coalesce(regexp_extract(c.filepath, '[^/]*$') || ':' || chr(10) || toc, c.content) AS summary, CASE WHEN doc_id % 2 = 0 THEN 'File: x' || chr(10) || 'Path: y' || chr(10) || 'Summary: ' || 'about ' || coalesce(regexp_extract(c.filepath, '[^/]*$') || ':' || chr(10) || toc, c.content) ELSE content END AS content
FROM (SELECT * REPLACE (CASE WHEN type = 'file' AND doc_id % 2 = 0 THEN 'File: x' || chr(10) || 'Path: y' || chr(10) || 'Summary: ' ELSE content END AS content) FROM chunks) c LEFT JOIN {_TOC} t ON t.filepath = c.filepath WHERE type = 'file'""",
    "chunks",
)
def file_chunk(t):
    """File rows summarised by their contents tables; a header takes the summary in."""
    head = F.concat(F.lit("File: x\nPath: y\nSummary: "))
    rows = t.chunks.withColumn("summary", F.col("content")).withColumn("docstring", F.col("summary"))
    rows = rows.withColumn("content", F.when((F.col("type") == "file") & (F.col("doc_id") % 2 == 0), head).otherwise(F.col("content")))
    return context.with_file_summaries(rows, lambda c: F.concat(F.lit("about "), c)).where("type = 'file'").select("qualified_name", "summary", "content")


@query("SELECT row_number() OVER (ORDER BY qualified_name) - 1 AS position, right(filepath, 30) AS file, left(language, 5) AS lang, type, name, CAST(start_line AS VARCHAR) AS line FROM chunks ORDER BY qualified_name LIMIT 15", "chunks")
def evidence_panel(t):
    top = t.chunks.orderBy("qualified_name").limit(15)
    from pyspark.sql.window import Window

    return context.evidence(top.withColumn("position", (F.row_number().over(Window.orderBy("qualified_name")) - 1).cast("long")))


@query("SELECT concat('v', page_id, '.xaml') AS path, html AS text, b.text AS code_behind FROM pages p LEFT JOIN benchmark b ON b.item_id = p.page_id")
def view_codebehind(t):
    views = t.pages.select(F.concat(F.lit("v"), "page_id", F.lit(".xaml")).alias("path"), F.col("html").alias("text"))
    return with_code_behind(views.unionByName(t.benchmark.select(F.concat(F.lit("v"), "item_id", F.lit(".xaml.cs")).alias("path"), "text")))


from siltstone.plans import assistant_queries, parsing_queries  # noqa: E402, F401

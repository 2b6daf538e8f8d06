"""Views that give the driver's tables the shape which the operators need. The same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.index import SearchIndex, estimated_bytes
from siltstone.scratch import scratch_path

#: name: (SQL, views and tables that it reads)
VIEWS: dict[str, str] = {
    "chunks": """SELECT concat(source, '.', lang, '.d', CAST(doc_id AS STRING)) AS qualified_name,
  CASE WHEN doc_id % 3 = 0 THEN concat('u', CAST(doc_id AS STRING)) ELSE concat('d', CAST(doc_id % 401 AS STRING)) END AS name,
  CASE doc_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'class' WHEN 2 THEN 'function' WHEN 3 THEN 'method' ELSE 'property' END AS type,
  text AS content, concat(source, '/', lang, '/m', CAST(doc_id % 50 AS STRING), '.py') AS filepath,
  CAST(doc_id % 97 + 1 AS INT) AS start_line,
  CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'c_sharp' WHEN 'fr' THEN 'cpp' ELSE 'xaml' END AS language,
  concat(source, '.', lang) AS module_path, doc_id, doc_id AS ord
FROM documents""",
    "calls": """SELECT c.qualified_name AS caller_qn, c.language, c.module_path, c.doc_id, k.k AS call_pos,
  CASE k.k WHEN 0 THEN concat('u', CAST(c.doc_id - c.doc_id % 3 AS STRING))
           WHEN 1 THEN concat('d', CAST((c.doc_id * 7 + 13) % 401 AS STRING))
           ELSE concat('d', CAST(c.doc_id - 20 AS STRING)) END AS called_name
FROM chunks c CROSS JOIN (VALUES (0), (1), (2)) AS k(k)""",
    "imports": """SELECT c.qualified_name AS owner_qn, concat('d', CAST((c.doc_id * 7 + 13) % 401 AS STRING)) AS alias, t.qualified_name AS target_qn
FROM chunks c JOIN chunks t ON t.doc_id = c.doc_id - 1""",
    "call_edges": """SELECT DISTINCT CAST(caller AS STRING) AS caller_qn, CAST(callee AS STRING) AS callee_qn FROM (
  SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee
  FROM lineitem) t WHERE callee IS NOT NULL""",
    "doc_edges": """SELECT a.qualified_name AS caller_qn, b.qualified_name AS callee_qn FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id + 1
UNION SELECT a.qualified_name, b.qualified_name FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id + 7
UNION SELECT qualified_name, qualified_name FROM chunks WHERE type = 'class'""",
    "named_edges": """SELECT CASE caller_qn WHEN '1' THEN 'who' WHEN '2' THEN 'Part' ELSE concat('n', caller_qn) END AS caller_qn, CASE callee_qn WHEN '1' THEN 'who' WHEN '2' THEN 'Part' ELSE concat('n', callee_qn) END AS callee_qn FROM call_edges
UNION SELECT 'who', qualified_name FROM chunks WHERE doc_id < 9""",
    "file_state_old": """SELECT concat(source, '/', CAST(doc_id AS STRING)) AS rel_path,
  CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, 'x')) ELSE md5(text) END AS md5 FROM documents WHERE doc_id % 10 <> 0""",
    "file_state_new": """SELECT concat(source, '/', CAST(doc_id AS STRING)) AS rel_path, md5(text) AS md5 FROM documents WHERE doc_id % 11 <> 0""",
    "traces": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('Traceback (most recent call last):', chr(10), '  File "app', CAST(user_id AS STRING), '.py", line ', CAST(event_id % 90 + 1 AS STRING), ', in main', chr(10), '    run()', chr(10), '  File "lib.py", line 7, in fn', CAST(user_id AS STRING), chr(10), '    raise', chr(10), 'ValueError: v', CAST(event_id AS STRING))
  ELSE concat('System.NullReferenceException: n', CAST(event_id AS STRING), chr(10), '   at N.C', CAST(user_id AS STRING), '.Load() in /src/C.cs:line ', CAST(event_id % 90 + 1 AS STRING)) END AS error_text
FROM events""",
    "vectors": """SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id""",
}
NEEDS = {"named_edges": ["chunks", "call_edges"], "calls": ["chunks"], "imports": ["chunks"], "doc_edges": ["chunks"], "vectors": ["chunks"]}


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB with the views as common table expressions."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS.get(n, ()), n) if x not in wanted]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE') :]}" if ctes else body
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body


class Tables:
    """Tables and views of a folder as DataFrames."""

    #: Search indexes by application, folder and name: made once, as at ingest, and read by every query.
    _indexes: dict[tuple[str, str, str], SearchIndex] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _indexed(self, name: str, make) -> SearchIndex:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in self._indexes:
            self._indexes[key] = make(scratch_path(self.spark, f"index-{name}"))
        return self._indexes[key]

    @property
    def vectors(self) -> DataFrame:
        """The view of that name. Where the session's limit keeps the vectors from being broadcast they are hashed, so that texts
        are never sorted."""
        rows = self.embeddings.select("vec_id", "embedding")
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        rows = rows.hint("shuffle_hash") if estimated_bytes(rows) > most else rows
        return self.chunks.join(rows, F.col("doc_id") == F.col("vec_id")).drop("vec_id")

    @property
    def document_index(self) -> SearchIndex:
        """Of all documents' words."""
        return self._indexed("documents", lambda folder: SearchIndex.build(self.documents, folder, "doc_id", "text"))

    @property
    def chunk_index(self) -> SearchIndex:
        """Of the words and vectors of the chunks that have a vector."""
        return self._indexed("vectors", lambda folder: SearchIndex.build(self.vectors, folder, "qualified_name", "content", "embedding", ("filepath", "language")))

    @property
    def vector_index(self) -> SearchIndex:
        """Of all vectors."""
        return self._indexed("embeddings", lambda folder: SearchIndex.build(self.embeddings.withColumn("none", F.lit("")), folder, "vec_id", "none", "embedding"))

    def engine(self, **options):
        """The engine over the chunks with vectors and the edges between documents; its embedder gives the queries' vector."""
        from siltstone.session import CodeEngine

        return CodeEngine(self.spark, "", chunks=self.vectors, edges=self.doc_edges, index=self.chunk_index, **options)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql, parts = VIEWS[name], {}
        for t in ("documents", "lineitem", "events", "embeddings", "chunks", "call_edges"):
            for word in ("FROM", "JOIN"):
                if f"{word} {t}" in sql:
                    sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
                    parts[t] = getattr(self, t)
        return self.spark.sql(sql, **parts)

"""The engine: one object over a store of chunks and edges."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import errors, text
from siltstone.functions.embed import Embedder, Summarizer, embedding, hashing_embedder, summary
from siltstone.operators import context, graph, lookup, resolve, search
from siltstone.operators.index import SearchIndex
from siltstone.operators.store import ChunkStore, changed_files, dedup_batch, doc_order, scrolled
from siltstone.plans.prompts import ROUTER, prompt
from siltstone.scratch import scratch_path
from siltstone.sources import files
from siltstone.sources.parsing.table import parse_source, with_code_behind

KINDS = ("bug", "flow", "search", "mvvm", "general", "existence", "file_summary", "error")
#: Takes the router's prompt and a question, gives JSON.
Classifier = Callable[[str, str], str]


@dataclass
class Route:
    """What is known of a question."""

    kind: str = "general"
    filenames: list[str] = field(default_factory=list)
    target: str | None = None
    keywords: list[str] = field(default_factory=list)
    language: str = "python"
    has_traceback: bool = False


class CodeEngine:
    """Over a folder, or over given chunks and edges, which then are only read."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        embedder: Embedder = hashing_embedder,
        summarizer: Summarizer | None = None,
        scorer=search.overlap_score,
        classifier: Classifier | None = None,
        chunks: DataFrame | None = None,
        edges: DataFrame | None = None,
        index: SearchIndex | None = None,
    ):
        self.spark, self.store = spark, ChunkStore(spark, folder)
        self.embedder, self.summarizer, self.scorer, self.classifier = embedder, summarizer, scorer, classifier
        self._chunks, self._edges, self._index, self._indexed = chunks, edges, index, None

    # --- ingest ------------------------------------------------------------------------------------------------------
    def ingest(self, root: str, force: bool = False, drop_deleted: bool = False) -> dict[str, int]:
        """Parse new and changed files below root, write their chunks, resolve the edges that this may change, save the state. Gives
        counts by status."""
        found = files.scan(self.spark, root, with_code_behind=True)
        diff = changed_files(self.store.table("file_state"), files.file_state(found), force)
        diff = self.store.staged(diff, "diff")
        counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        todo = diff.where(F.col("status").isin("new", "changed")).select("rel_path")
        changed = []
        if counts.get("new", 0) + counts.get("changed", 0):
            chosen = found.join(todo, "rel_path", "left_semi").select(F.col("rel_path").alias("path"), files.decoded(F.col("content")).alias("text"))
            changed.append(self.add_chunks(self.parsed(chosen)))
        if drop_deleted and counts.get("deleted", 0):
            changed.append(self.store.delete_files(diff.where("status = 'deleted'").select(text.normal_path(F.col("rel_path")).alias("filepath"))))
        for c in changed:
            self.resolve_changed(c)
        self.store.save_state(diff.where("status <> 'deleted'").select("rel_path", "md5"))
        return counts

    def parsed(self, sources: DataFrame) -> DataFrame:
        """Chunks of files (path, text) with folder chunks, summaries and vectors; one row a key."""
        rows = parse_source(with_code_behind(sources)).drop("status")
        summarized = lambda c: summary(c, self.summarizer)
        rows = rows.withColumn("summary", summarized(F.col("content"))).withColumn("docstring", F.col("summary"))
        rows = context.with_file_summaries(self.store.staged(rows, "parsed"), summarized)
        folders = context.folder_groups(rows).select(
            "qualified_name", F.element_at(F.split("folder", "/"), -1).alias("name"), F.lit("folder").alias("type"), F.array_join("elements", "\n").alias("content"), F.lit(None).cast("string").alias("summary"),
            F.col("folder").alias("filepath"), F.lit(0).alias("start_line"), F.lit("architecture").alias("language"), F.col("folder").alias("module_path"),
        )
        rows = rows.unionByName(folders, allowMissingColumns=True)
        rows = dedup_batch(rows.withColumn("__at", F.monotonically_increasing_id()), "__at").drop("key", "place", "__at")
        vector = embedding(text.embed_text(F.col("name"), F.col("type"), F.col("summary"), F.col("filepath")), self.embedder)
        return rows.withColumn("embedding", vector)

    def add_chunks(self, chunks: DataFrame) -> DataFrame:
        """Gives what changed: qualified_name, name."""
        return self.store.upsert_chunks(chunks)

    def _calls(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        calls = chunks.select(F.col("qualified_name").alias("caller_qn"), "language", "module_path", F.explode("calls").alias("called_name"))
        imports = chunks.select(F.col("qualified_name").alias("owner_qn"), F.explode("imports").alias("alias", "target_qn"))
        views = chunks.where(F.col("language").isin("xaml", "html")).select(F.col("qualified_name").alias("caller_qn"), "content")
        return calls, imports, views

    def resolve_changed(self, changed: DataFrame) -> None:
        """Resolve again the calls of changed chunks and of those that use their names; all other edges stay."""
        chunks = self.chunks().withColumn("ord", F.col("qualified_name"))
        calls, imports, views = self._calls(chunks)
        callers = self.store.staged(resolve.affected_callers(calls, imports, views, changed), "callers")
        own = lambda df, key: df.join(callers.select(F.col("caller_qn").alias(key)), key, "left_semi")
        named = chunks.where(~F.col("language").isin("xaml", "html"))
        seen = own(chunks.where(F.col("language").isin("xaml", "html")), "qualified_name")
        edges = resolve.build_edges(own(calls, "caller_qn"), own(imports, "owner_qn"), named.unionByName(seen), chunks)
        self.store.replace_edges(callers, edges)

    def rebuild_edges(self) -> None:
        """Resolve all calls of the stored chunks."""
        chunks = self.chunks().withColumn("ord", F.col("qualified_name"))
        calls, imports, _ = self._calls(chunks)
        self.store.write("call_edges", resolve.build_edges(calls, imports, chunks))

    def index(self) -> SearchIndex:
        """The search index of the chunks as they are: written once a version of the store, and read by every question."""
        if self._index is None or (self._chunks is None and self._indexed != self.store.version("code_chunks")):
            self._indexed = None if self._chunks is not None else self.store.version("code_chunks")
            folder = scratch_path(self.spark, "index") if self._chunks is not None else f"{self.store.folder}/index/{self._indexed:012d}"
            self._index = SearchIndex(self.spark, folder)
            if not self._index.ready():
                SearchIndex.build(self.chunks(), folder, "qualified_name", "content", "embedding", ("filepath", "language"))
        return self._index

    # --- tables ------------------------------------------------------------------------------------------------------
    def chunks(self) -> DataFrame:
        return self.store.table("code_chunks") if self._chunks is None else self._chunks

    def edges(self) -> DataFrame:
        return self.store.table("call_edges") if self._edges is None else self._edges

    def scroll(self) -> DataFrame:
        return scrolled(self.chunks())

    def with_relations(self, rows: DataFrame | None = None) -> DataFrame:
        """Chunks (all, or the rows given) with called_by derived from the edges."""
        return graph.with_called_by(self.chunks() if rows is None else rows, self.edges())

    # --- search ------------------------------------------------------------------------------------------------------
    def _vector(self, query: str) -> list[float]:
        return [float(x) for x in self.embedder([query])[0]]

    def search(self, query: str, top_k: int = 5) -> DataFrame:
        """Hybrid search: qualified_name, position, exact, and the chunk's columns."""
        asked = self.spark.createDataFrame([(query,)], "q string").select(text.identifiers(F.col("q")).alias("n"), text.file_names(F.col("q")).alias("f")).first()
        hits = search.hybrid_search(self.index(), self.chunks(), query, self._vector(query), top_k, list(asked["n"]), list(asked["f"]), self.scorer)
        return lookup.with_rows_of(hits, self.chunks().drop("embedding")).orderBy("position")

    def search_by_language(self, query: str, language: str, top_k: int = 10) -> DataFrame:
        near = self.index().vector_top(self._vector(query), top_k, F.col("language") == language)
        near = near.select(F.col("id").alias("qualified_name"), "score", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("position"))
        return lookup.with_rows_of(near, self.chunks().drop("embedding")).orderBy("position")

    def search_with_context(self, query: str, top_k: int = 5) -> DataFrame:
        """Hits with flow lines and, for the first three, callees that are known."""
        return graph.chunk_context(self.search(query, top_k).select("qualified_name", "position"), self.edges(), self.chunks())

    def route(self, query: str, kind: str = "general", target: str | None = None) -> Route:
        """What the classifier says of a question; without one, or if its answer is no such JSON, the rules: a plain question in a
        language told by its words."""
        r = self.spark.createDataFrame([(query,)], "q string").select(text.routed_language(F.col("q")).alias("l"), text.has_traceback(F.col("q")).alias("t"), text.file_names(F.col("q")).alias("f")).first()
        if self.classifier is not None:
            try:
                said = json.loads(self.classifier(ROUTER, query).replace("```json", "").replace("```", "").strip())
                return Route(str(said["type"]), list(said.get("filenames") or []), said.get("target_name"), [str(k) for k in said.get("keywords") or []], said.get("language") or "python", r["t"])
            except (ValueError, KeyError, TypeError, AttributeError):
                return Route("general", [], None, [], r["l"], False)
        return Route(kind, list(r["f"]), target, [], r["l"], r["t"])

    def retrieve(self, query: str, route: Route) -> DataFrame:
        """Hits by the first strategy that fits: target, several files, one file, traceback, language, plain search."""
        if route.target:
            return self.search(query, 10)
        if len(route.filenames) > 1:
            return lookup.by_paths(self.chunks(), route.filenames, 20)
        if route.filenames:
            return lookup.by_path(self.chunks(), route.filenames[0], 1000).limit(50)
        if route.has_traceback:
            named = [f for p in text.TRACE_FILE_PATTERNS for f in re.findall(p, query)]
            return lookup.by_paths(self.chunks(), sorted(set(named)), 50) if named else self.search(query, 5)
        if route.language in ("csharp", "xaml"):
            return self.search_by_language(query, {"csharp": "c_sharp"}.get(route.language, route.language), 10)
        words = " ".join(route.keywords)
        return self.search(words if len(words) >= 5 else query, 5)

    def expanded(self, hits: DataFrame) -> DataFrame:
        """Chunks called by the first five hits and not among them."""
        return graph.callee_expansion(hits, self.edges(), self.chunks())

    def build_prompt(self, query: str, hits: DataFrame, route: Route) -> str:
        """Template of the route with the hits as XML; what is collected is the context of one answer."""
        order = ["position"] if "position" in hits.columns else ["filepath", "start_line", "qualified_name"]
        rows = hits.withColumn("i", F.row_number().over(Window.orderBy(*order))).withColumn("one", F.lit(1))
        body = context.joined(rows, ["one"], ["i"], context.xml_item(F.col("i")), "", "xml").first()
        block = self.spark.createDataFrame([(query,)], "q string").select(text.traceback_block(F.col("q"))).first()[0]
        return prompt(route.kind, query, "<context>\n" + (body["xml"] if body else "") + "</context>", route.target or (route.filenames or [None])[0], block, route.language)

    # --- tools -------------------------------------------------------------------------------------------------------
    def semantic_search(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search(query, top_k)

    def get_code_snippet(self, qualified_name: str) -> DataFrame:
        return lookup.snippet(self.chunks(), qualified_name)

    def find_by_name(self, names: list[str]) -> DataFrame:
        return lookup.find_by_name(self.chunks(), names)

    def read_file(self, filename: str) -> DataFrame:
        return lookup.read_file(self.chunks(), filename)

    def query_knowledge_graph(self, question: str, seed: str = "") -> tuple[DataFrame, DataFrame]:
        """Flow lines of the seed (two hops) and of the first three names of the question (one hop); up to five callees' chunks."""
        names = re.findall(r"\b[A-Z][a-zA-Z0-9]+|[a-z][a-z0-9_]+[a-z0-9]\b", question)[:3]
        lines, callees = graph.question_flow(self.edges(), seed, names)
        code = lookup.with_rows_of(callees.withColumnRenamed("callee_qn", "qualified_name"), self.chunks())
        return lines, code

    def tools(self) -> dict[str, dict]:
        """Registry for an agent: name to description, parameters and function."""
        spec = lambda f, about, **p: {"description": about, "parameters": p, "function": f}
        return {
            "semantic_search": spec(self.semantic_search, "Hybrid search over code", query="string", top_k="integer"),
            "get_code_snippet": spec(self.get_code_snippet, "Code of one qualified name", qualified_name="string"),
            "find_by_name": spec(self.find_by_name, "Chunks by exact name", names="array"),
            "query_knowledge_graph": spec(self.query_knowledge_graph, "Callers and callees", question="string", seed="string"),
            "read_file": spec(self.read_file, "Chunks of a file", filename="string"),
        }

    # --- errors and documents ----------------------------------------------------------------------------------------
    def diagnose(self, error_text: str, strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """The parsed error, and related code by a search for its file and function."""
        out = errors.diagnosed(self.spark.createDataFrame([(error_text,)], "error_text string"), strict=strict)
        row = out.select("success", "search_text").first()
        return out, self.search(row["search_text"], 10) if row["success"] else None

    def similar_errors(self, error_text: str, top_k: int = 3) -> DataFrame:
        found = errors.diagnosed(self.spark.createDataFrame([(error_text,)], "error_text string")).first()["similar_text"]
        return self.search(found or error_text, top_k).select("qualified_name", "filepath", "start_line", "position")

    def batch_diagnose(self, texts: list[str]) -> DataFrame:
        """Up to ten error texts, each with its own success flag."""
        if len(texts) > errors.BATCH:
            raise ValueError(f"at most {errors.BATCH} texts")
        rows = [(i, t) for i, t in enumerate(texts)]
        return errors.batch(self.spark.createDataFrame(rows, "item long, error_text string"), "item")

    def stats(self) -> dict:
        n = self.store.count()
        return {"python_types": sorted(errors.PYTHON_LEVELS), "csharp_types": sorted(errors.CSHARP_LEVELS), "index_size": n, "ready": n > 0}

    def write_docs(self, folder: str, project: str = "API", root: str = "") -> int:
        """Write the first page, one page a file and an index page a folder below folder. The tasks write, each its own pages,
        through pyarrow's file systems (local or mounted paths, hdfs, s3); one that runs again writes the same files."""
        pages = context.doc_files(doc_order(self.chunks()), project, root)
        target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

        def put(batches):
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(target)
            for batch in batches:
                for path, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    full = f"{top.rstrip('/')}/{path.lstrip('/')}"
                    system.create_dir(full.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(full) as out:
                        out.write(page.encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        return pages.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def tool_line(name: str, arguments: dict, about: str) -> str:
    """A line of an agent's log."""
    first = next(iter(arguments.values()), "")
    shown = ", ".join(str(x) for x in first[:3]) if isinstance(first, list) else str(first)[:40]
    return f"{TOOL_ICONS.get(name, '⚙️')} **{name}**({shown}): {about}"


#: Fixed values.
TOOL_ICONS = {"semantic_search": "🔍", "get_code_snippet": "📄", "find_by_name": "🎯", "query_knowledge_graph": "🕸️", "read_file": "📂"}

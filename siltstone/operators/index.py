"""The stored search index: postings for BM25, unit vectors in cells for nearest neighbours. It is written at ingest; a question
then reads the postings of its own terms and one row of statistics, and the vectors of the nearest cells (or all of them).

Tables in one folder:
  lists     term, ids, dls, tfs: postings in lists, sorted by term in range partitions, so a question's terms are found by the
            files' own statistics, and a term of very many documents is cut into several files; as rows (term, id, dl, tf) they
            are the table `postings`
  docs      id, dl
  stats     n_docs, avgdl, n_terms, mean_idf
  vectors   cell, id, unit (a vector of length 1), and the columns that questions filter by; one folder a cell
  cells     cell, centre, probes (how many cells to read)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import query_tokens, tokens
from siltstone.scratch import bound_batches, hadoop_path

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Vectors that the cells' centres are fitted on; questions on which the recall of cells is measured, and what it must be.
SAMPLE, ASKED, RECALL, TOP = 20_000, 100, 0.95, 10
MOST_CELLS = 1024
#: Bytes, as Spark estimates them, up to which a table is dealt out anew before it is indexed.
SMALL = 1 << 30
#: Postings of one file and of the task that sorts it, or so, whatever the size of the input; a list holds the 8,192nd part at most.
POSTINGS = 1 << 20
#: Tokens of the documents whose postings are put into lists together.
TOKENS = 1 << 20


def estimated_bytes(rows: DataFrame) -> int:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def idf_of(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def with_units(rows: DataFrame) -> DataFrame:
    """rows with their vector v as unit: at length 1, in doubles; without those that have no length, or a null in them. One pass
    over whole batches; squares are added in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, lengths = v.flatten(), pc.list_value_length(v).to_numpy(zero_copy_only=False)
            if b.num_rows and not v.null_count and not flat.null_count and (lengths == lengths[0]).all() and lengths[0]:
                blocks = [flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)]
            else:
                blocks = [np.array([x], dtype=np.float64) if x and None not in x else np.zeros((1, 1)) for x in v.to_pylist()]
            norms = [np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) for x in blocks]
            keep = [~(norm <= 0) for norm in norms]
            units = [u for x, norm, k in zip(blocks, norms, keep, strict=True) for u in x[k] / norm[k, None]]
            rest = b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.list_(pa.float64())) if n == "v" else rest.column(n) for n in b.schema.names], ["unit" if n == "v" else n for n in b.schema.names])

    bound_batches(rows.sparkSession)
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.mapInArrow(run, T.StructType([T.StructField("unit" if f.name == "v" else f.name, f.dataType) for f in rows.schema]))


def dot(vector: Column, query: list[float]) -> Column:
    """Products with a question's numbers, added in order; short ones unrolled, which Spark compiles."""
    if len(query) <= 128:
        return reduce(lambda s, x: s + x, (F.get(vector, F.lit(i)) * F.lit(float(q)) for i, q in enumerate(query)), F.lit(0.0))
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(q)) for q in query]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for i in range(k):
            own = x[near == i]
            if len(own):
                mean = own.mean(axis=0)
                c[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._stats = None

    def table(self, name: str) -> DataFrame:
        if name != "postings":
            return self.spark.read.parquet(f"{self.folder}/{name}")
        each = F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"), F.col("tfs").alias("tf"))
        return self.table("lists").select("term", F.inline(each).alias("id", "dl", "tf")).withColumn("tf", F.col("tf").cast("long"))

    def ready(self) -> bool:
        """Has the index been written whole, and with lists? The statistics are written last."""
        paths = [hadoop_path(self.spark, f"{self.folder}/{name}/_SUCCESS") for name in ("lists", "stats")]
        return all(system.exists(path) for system, path in paths)

    # --- writing -----------------------------------------------------------------------------------------------------
    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str, text_col: str, vector_col: str | None = None, filters: tuple[str, ...] = ()) -> SearchIndex:
        out = cls(docs.sparkSession, folder)
        # A small table may be one row group, which one task would tokenize; a large one has many and is not shuffled.
        if estimated_bytes(docs) < SMALL:
            docs = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, id_col)  # by key: dealt out in turn, texts would be sorted
        if vector_col:
            out._write_vectors(docs.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *filters), filters)
        out._write_words(docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")))
        return out

    def _write_words(self, rows: DataFrame) -> None:
        """Each task counts the terms of some thousand documents together and gives their postings in lists, so that far fewer rows
        are moved and sorted than there are postings."""
        bound_batches(self.spark)
        id_type, most = rows.schema["id"].dataType.simpleString(), max(1, POSTINGS >> 13)
        kept = f"id {id_type}, dl int, term string, first {id_type}, ids array<{id_type}>, dls array<int>, tfs array<int>"

        def lists(ids: pa.Array, t: pa.ListArray) -> pa.RecordBatch:
            terms, dls = t.flatten().dictionary_encode(), pc.list_value_length(t)
            at = terms.indices.to_numpy().astype(np.int64) * len(t) + pc.list_parent_indices(t).to_numpy()
            at, tfs = np.unique(at, return_counts=True)  # by term, then by document
            code, row = at // max(len(t), 1), at % max(len(t), 1)
            begins = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(code)) + 1])[: len(code)]
            place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
            cuts = np.flatnonzero(place % most == 0)
            ends, row = pa.array(np.append(cuts, len(code)).astype(np.int32)), pa.array(row)
            found = [terms.dictionary.take(pa.array(code[cuts])), ids.take(row.take(pa.array(cuts)))]
            found += [pa.ListArray.from_arrays(ends, x) for x in (ids.take(row), dls.take(row), pa.array(tfs.astype(np.int32)))]
            return pa.RecordBatch.from_arrays([pa.nulls(len(cuts), ids.type), pa.nulls(len(cuts), pa.int32()), *found], ["id", "dl", "term", "first", "ids", "dls", "tfs"])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for b in batches:
                ids, dl = b.column("id"), pc.list_value_length(b.column("t"))
                none = [pa.nulls(len(ids), kind) for kind in (pa.string(), ids.type, pa.list_(ids.type), pa.list_(pa.int32()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids, dl, *none], ["id", "dl", "term", "first", "ids", "dls", "tfs"])
                held, size = [*held, b], size + len(b.column("t").flatten())
                if size >= TOKENS:
                    yield lists(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("id", "t")))
                    held, size = [], 0
            if size:
                yield lists(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("id", "t")))

        rows.select("id", "t").mapInArrow(counted, kept).write.mode("overwrite").parquet(f"{self.folder}/counted")
        counted_rows = self.table("counted")
        counted_rows.where("term IS NULL").select("id", "dl").write.mode("overwrite").parquet(f"{self.folder}/docs")
        held = counted_rows.agg(F.count(F.when(F.col("term").isNull(), 1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum(F.when(F.col("term").isNotNull(), F.size("tfs"))).alias("n")).first()
        found = counted_rows.where("term IS NOT NULL").select("term", "first", "ids", "dls", "tfs").repartitionByRange(max(1, -(-(held["n"] or 1) // POSTINGS)), "term", "first")
        found.sortWithinPartitions("term", "first").drop("first").write.mode("overwrite").parquet(f"{self.folder}/lists")
        system, counted_path = hadoop_path(self.spark, f"{self.folder}/counted")
        system.delete(counted_path, True)
        n = F.lit(held["n_docs"])
        df = self.table("lists").groupBy("term").agg(F.sum(F.size("tfs")).alias("df"))
        stats = df.agg(n.alias("n_docs"), F.lit(held["avgdl"]).cast("double").alias("avgdl"), F.count(F.lit(1)).alias("n_terms"), F.avg(idf_of(n, F.col("df"))).alias("mean_idf"))
        stats.write.mode("overwrite").parquet(f"{self.folder}/stats")

    def _write_vectors(self, rows: DataFrame, filters: tuple[str, ...]) -> None:
        # Written once: the count, the sample and the placing read them, not the rows' own plan (a join, say) three times.
        with_units(rows).write.mode("overwrite").parquet(f"{self.folder}/units")
        rows = self.table("units")
        n = rows.count()
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        sample = sorted((str(r["id"]), r["unit"]) for r in rows.select("id", "unit").where(draw < SAMPLE / max(n, 1)).limit(2 * SAMPLE).toLocalIterator())  # bounded by SAMPLE
        x = np.array([v for _, v in sample], dtype=np.float64).reshape(len(sample), len(sample[0][1]) if sample else 0)
        centres = _centres(x.copy(), max(1, min(MOST_CELLS, int(math.sqrt(n)), len(x)))) if len(x) else np.zeros((1, 1))
        shared = self.spark.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most

        @F.pandas_udf("int")
        def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(np.argmax(np.array(b.tolist()) @ shared.value.T, axis=1).astype(np.int32) if len(b) else [], dtype="int32")

        placed = rows.select(cell("unit").alias("cell"), "id", "unit", *filters).repartition("cell").write.mode("overwrite")
        (placed.partitionBy("cell") if n else placed).parquet(f"{self.folder}/vectors")  # no rows, no folders: then the file tells the columns
        system, units = hadoop_path(self.spark, f"{self.folder}/units")
        system.delete(units, True)
        probes = self._probes(centres, x[:: max(1, len(x) // ASKED)][:ASKED])
        cells = pd.DataFrame({"cell": range(len(centres)), "centre": [c.tolist() for c in centres], "probes": probes})
        self.spark.createDataFrame(cells, "cell int, centre array<double>, probes int").write.mode("overwrite").parquet(f"{self.folder}/cells")

    def _probes(self, centres: np.ndarray, asked: np.ndarray) -> int:
        """The least number of nearest cells that hold RECALL of the true nearest TOP of the questions asked: one pass over all
        vectors, in which each task keeps its TOP a question."""
        if not len(asked):
            return 1
        shared = self.spark.sparkContext.broadcast(asked)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score, cell = np.full((len(shared.value), TOP), -2.0), np.full((len(shared.value), TOP), -1)
            for b in batches:
                if len(b):
                    s = np.hstack([score, shared.value @ np.array(b["unit"].tolist()).T])
                    c = np.hstack([cell, np.tile(b["cell"].to_numpy(), (len(s), 1))])
                    keep = np.argsort(-s, axis=1, kind="stable")[:, :TOP]
                    score, cell = np.take_along_axis(s, keep, 1), np.take_along_axis(c, keep, 1)
            q, i = np.nonzero(cell >= 0)
            yield pd.DataFrame({"q": q, "score": score[q, i], "cell": cell[q, i]})

        found = self.table("vectors").select("unit", "cell").mapInPandas(best, "q int, score double, cell int").groupBy("q")
        near = found.agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "cell")), asc=False), 1, TOP).alias("b"))
        order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
        ranks = np.concatenate([[order[q, x["cell"]] for x in b] for q, b in near.toLocalIterator()])  # ASKED rows
        return int(np.quantile(ranks, RECALL, method="higher")) + 1

    # --- asking ------------------------------------------------------------------------------------------------------
    @property
    def stats(self):
        if self._stats is None:
            self._stats = self.table("stats").first()
        return self._stats

    def bm25(self, query: str) -> DataFrame:
        """id, score of the documents that hold a term of the query (repeated terms count again)."""
        terms = query_tokens(query)
        distinct = sorted(set(terms))
        rows = self.table("postings").where(F.col("term").isin(*distinct)) if distinct else self.table("postings").limit(0)
        lists = self.table("lists").where(F.col("term").isin(*distinct)) if distinct else self.table("lists").limit(0)
        df = lists.agg(*[F.coalesce(F.sum(F.when(F.col("term") == q, F.size("tfs"))), F.lit(0)).alias(f"df{i}") for i, q in enumerate(distinct)] or [F.lit(0)]).first()  # one row
        n, mean = self.stats["n_docs"], self.stats["mean_idf"]
        found = rows.groupBy("id").agg(F.max("dl").alias("dl"), *[F.coalesce(F.max(F.when(F.col("term") == q, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, q in enumerate(distinct)])
        score = F.lit(0.0)
        for q in terms:
            i = distinct.index(q)
            held = df[i]
            raw = math.log(n - held + 0.5) - math.log(held + 0.5)
            weight = 0.0 if not held else EPSILON * mean if raw < 0 else raw
            f = F.col(f"tf{i}")
            score = score + F.lit(weight) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(self.stats["avgdl"])))
        return found.select("id", score.alias("score"))

    def bm25_all(self, query: str) -> DataFrame:
        """id, score of all documents."""
        found = self.bm25(query).withColumnRenamed("id", "f")
        return self.table("docs").join(found, F.col("id") == F.col("f"), "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def bm25_top(self, query: str, k: int) -> DataFrame:
        """The k best ids; documents without a term may fill the list. Ties go to the smaller id."""
        found = self.bm25(query)
        if found.where("score > 0").limit(k).count() < k:
            found = self.bm25_all(query)
        return found.orderBy(F.desc("score"), "id").limit(k)

    def vector_top(self, query: list[float], k: int, where: Column | None = None, exact: bool = True) -> DataFrame:
        """The k nearest by cosine among rows that pass `where`: of all rows, or of the cells nearest to the query."""
        rows = self.table("vectors")
        length = math.sqrt(sum(float(x) ** 2 for x in query))
        if not length:
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        asked = [float(x) / length for x in query]
        if not exact:
            cells = [c for c in self.table("cells").toLocalIterator() if len(c["centre"]) == len(asked)]  # MOST_CELLS rows at most
            if not cells:
                return rows.select("id", F.lit(0.0).alias("score")).limit(0)
            near = np.argsort(-(np.array([c["centre"] for c in cells]) @ np.array(asked)), kind="stable")[: cells[0]["probes"]]
            rows = rows.where(F.col("cell").isin(*[cells[i]["cell"] for i in near]))
        rows = rows if where is None else rows.where(where)
        return rows.where(F.size("unit") == len(asked)).select("id", dot(F.col("unit"), asked).alias("score")).orderBy(F.desc("score"), "id").limit(k)

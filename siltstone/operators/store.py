"""The chunk store: keyed last-wins writes over Parquet, edges, state of files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import storable_calls
from siltstone.schemas import CALL_EDGES, CODE_CHUNKS, FILE_STATE
from siltstone.scratch import hadoop_path, scratch_path


def last_wins(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row with the greatest version of each key. max_by aggregates before the shuffle, so a key with many versions
    sends one row a task."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.`{c}`").alias(c) for c in others]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "qualified_name", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """old with the rows of new put over it by key; columns in `keep` stay as they were."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    out = last_wins(both, [key], ["__v"]).drop("__v")
    held = [c for c in keep if c in old.columns]
    if not held:
        return out
    was = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in held])
    out = out.join(was, F.col(key) == F.col("__k"), "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in held else F.col(c) for c in old.columns])


def dedup_batch(rows: DataFrame, order: str) -> DataFrame:
    """Last row a key (qualified name, else path_name_line), with `place`, the order of the key's first row."""
    key = F.coalesce(F.nullif(F.col("qualified_name"), F.lit("")), F.concat_ws("_", "filepath", "name", F.col("start_line").cast("string")))
    keyed = rows.withColumn("__key", key)
    others = rows.columns
    out = keyed.groupBy("__key").agg(F.max_by(F.struct(*others), order).alias("__last"), F.min(order).alias("place"))
    return out.select(F.col("__key").alias("key"), "place", *[F.col(f"__last.`{c}`").alias(c) for c in others])


def insert_new_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those distinct edges of new that it lacks."""
    return old.unionByName(new.dropDuplicates(["caller_qn", "callee_qn"]).join(old, ["caller_qn", "callee_qn"], "left_anti"))


def checked_edges(edges: DataFrame, nodes: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Distinct edges whose ends are both known nodes."""
    ids = nodes.select(F.col(key).alias("__n")).distinct()
    out = edges.dropDuplicates(["caller_qn", "callee_qn"])
    return out.join(ids, F.col("caller_qn") == F.col("__n"), "left_semi").join(ids, F.col("callee_qn") == F.col("__n"), "left_semi")


def changed_files(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """rel_path, status (new, changed, same, deleted), md5: one full outer join."""
    o, n = old.select("rel_path", F.col("md5").alias("__old")), new.select("rel_path", F.col("md5").alias("__new"))
    status = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "new").when((F.col("__old") != F.col("__new")) | F.lit(force), "changed").otherwise("same")
    return o.join(n, "rel_path", "full_outer").select("rel_path", status.alias("status"), F.coalesce("__new", "__old").alias("md5"))


def _required(field) -> Column:
    """A stored column; a missing line is 0, other missing values of columns that must have one are an error."""
    value = F.col(field.name).cast(field.dataType)
    if field.nullable:
        return value
    if field.name == "start_line":
        return F.coalesce(value, F.lit(0))
    return F.when(value.isNull(), F.raise_error(F.lit(f"{field.name} is missing"))).otherwise(value)


class ChunkStore:
    """Tables in one folder: code_chunks, call_edges, file_state. A table is cut into buckets by the hash of its key; a write
    makes new files for the buckets that it touches, and nothing else is read or written. What files a table consists of is a
    manifest, a small file that is written beside and then renamed, so a reader sees the old table or the new one, whole,
    and a crash at any moment leaves the old one. Manifests are numbered; the last KEEP and their files stay for running readers."""

    SCHEMAS = {"code_chunks": CODE_CHUNKS, "call_edges": CALL_EDGES, "file_state": FILE_STATE}
    KEYS = {"code_chunks": "qualified_name", "call_edges": "caller_qn", "file_state": "rel_path"}
    KEEP = 3

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # --- manifests ---------------------------------------------------------------------------------------------------
    def create(self) -> None:
        """Tables that are not there yet, empty."""
        for name in self.SCHEMAS:
            if not self._numbers(name):
                self.clear(name)

    def recreate(self) -> None:
        self.clear(*self.SCHEMAS)

    def _listed(self, name: str) -> list[str]:
        system, path = hadoop_path(self.spark, f"{self.folder}/{name}")
        return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(f[9:-5]) for f in self._listed(name) if f.startswith("manifest-") and f.endswith(".json"))

    def version(self, name: str) -> int:
        """Number of the table's last write; 0 before the first."""
        return max(self._numbers(name), default=0)

    def _manifest(self, name: str, number: int | None = None) -> dict:
        number = self.version(name) if number is None else number
        if not number:
            return {"buckets": self.buckets, "files": {}}
        system, path = hadoop_path(self.spark, f"{self.folder}/{name}/manifest-{number:012d}.json")
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        number = self.version(name) + 1
        system, ready = hadoop_path(self.spark, f"{self.folder}/{name}/.manifest-{uuid.uuid4().hex}")
        out = system.create(ready, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, target = hadoop_path(self.spark, f"{self.folder}/{name}/manifest-{number:012d}.json")
        if not system.rename(ready, target):
            raise RuntimeError(f"another writer has changed {name}")
        kept = self._numbers(name)[-self.KEEP :]
        used = {f.split("/")[0] for k in kept for f in self._manifest(name, k)["files"].values()}
        for f in self._listed(name):
            old = f.startswith("manifest-") and int(f[9:-5]) not in kept
            if old or (f.startswith("d-") and f not in used):
                system.delete(hadoop_path(self.spark, f"{self.folder}/{name}/{f}")[1], True)

    # --- reading and writing -----------------------------------------------------------------------------------------
    def table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """The current table, or some of its buckets; empty if there is none."""
        files = self._manifest(name)["files"]
        paths = [f"{self.folder}/{name}/{f}" for b, f in files.items() if touched is None or int(b) in touched]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*paths)

    def _bucket(self, name: str, column: str | None = None):
        return F.pmod(F.xxhash64(column or self.KEYS[name]), F.lit(self._manifest(name)["buckets"])).cast("int")

    def touched(self, name: str, keys: DataFrame, column: str | None = None) -> list[int]:
        """Buckets of the keys."""
        return sorted(keys.agg(F.collect_set(self._bucket(name, column))).first()[0])  # one number a bucket at most

    def write(self, name: str, df: DataFrame, touched: list[int] | None = None) -> None:
        """df takes the place of the table, or of the buckets touched."""
        manifest = self._manifest(name)
        data = f"d-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.SCHEMAS[name].fields], self._bucket(name).alias("b"))
        # Sorted by key, so that a question for some keys skips most of a file.
        rows.repartition("b").sortWithinPartitions("b", self.KEYS[name]).write.partitionBy("b").parquet(f"{self.folder}/{name}/{data}")
        made = {f[2:]: f"{data}/{f}" for f in self._listed(f"{name}/{data}") if f.startswith("b=")}
        stay = {} if touched is None else {b: f for b, f in manifest["files"].items() if int(b) not in touched}
        self._commit(name, {"buckets": manifest["buckets"], "files": stay | made})

    def clear(self, *names: str) -> None:
        for n in names or self.SCHEMAS:
            self.write(n, self.spark.createDataFrame([], self.SCHEMAS[n]))

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """Rows written once, so that what made them is not run again."""
        path = f"{scratch_path(self.spark, name)}/rows"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def upsert_chunks(self, chunks: DataFrame) -> DataFrame:
        """Put chunks over those of the same key. Gives what changed: qualified_name, name, of the rows before and after."""
        rows = chunks.withColumn("calls", storable_calls(F.col("calls"))) if "calls" in chunks.columns else chunks
        for f in CODE_CHUNKS.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows = self.staged(rows.select(*[_required(f).alias(f.name) for f in CODE_CHUNKS.fields]), "chunks")
        touched = self.touched("code_chunks", rows)
        old = self.table("code_chunks", touched)
        was = old.join(rows.select("qualified_name"), "qualified_name", "left_semi")
        changed = self.staged(was.select("qualified_name", "name").unionByName(rows.select("qualified_name", "name")).distinct(), "changed")
        self.write("code_chunks", upsert(old, rows), touched)
        return changed

    def upsert_chunk(self, chunk: DataFrame) -> bool:
        """upsert_chunks of one row; False if it could not be written."""
        try:
            self.upsert_chunks(chunk)
        except Exception:  # the caller goes on with its other chunks
            return False
        return True

    def delete_files(self, paths: DataFrame) -> DataFrame:
        """Drop the chunks of deleted files (filepath). Gives what changed: qualified_name, name."""
        gone = self.table("code_chunks").join(paths.select("filepath").distinct(), "filepath", "left_semi").select("qualified_name", "name")
        gone = self.staged(gone, "gone")
        touched = self.touched("code_chunks", gone)
        rest = self.table("code_chunks", touched).join(gone.select("qualified_name"), "qualified_name", "left_anti")
        self.write("code_chunks", rest, touched)
        return gone

    def add_edges(self, edges: DataFrame) -> None:
        new = self.staged(edges.select("caller_qn", "callee_qn"), "edges")
        touched = self.touched("call_edges", new)
        self.write("call_edges", insert_new_edges(self.table("call_edges", touched), new), touched)

    def add_checked_edges(self, edges: DataFrame) -> None:
        """Only edges whose ends are both stored chunks."""
        self.add_edges(checked_edges(edges, self.table("code_chunks")))

    def replace_edges(self, callers: DataFrame, edges: DataFrame) -> None:
        """The edges of these callers (caller_qn) become `edges`."""
        touched = self.touched("call_edges", callers)
        rest = self.table("call_edges", touched).join(callers, "caller_qn", "left_anti")
        self.write("call_edges", rest.unionByName(edges.select("caller_qn", "callee_qn")), touched)

    def save_state(self, state: DataFrame) -> None:
        self.write("file_state", state.select("rel_path", "md5"))

    def scroll(self) -> DataFrame:
        """All chunks by name, without summary and embedding."""
        return scrolled(self.table("code_chunks"))

    def count(self) -> int:
        try:
            return self.table("code_chunks").count()
        except Exception:
            return -1


def scrolled(chunks: DataFrame) -> DataFrame:
    return chunks.drop("summary", "embedding").orderBy("qualified_name")


def doc_order(chunks: DataFrame) -> DataFrame:
    """What documents are made of, in their order."""
    columns = ("qualified_name", "name", "type", "content", "summary", "filepath", "start_line", "language", "module_path", "docstring", "calls", "called_by")
    return chunks.select(*[c for c in columns if c in chunks.columns]).orderBy("filepath", "start_line", "qualified_name")


def deleted_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return changed_files(old, new).where("status = 'deleted'").select("rel_path")

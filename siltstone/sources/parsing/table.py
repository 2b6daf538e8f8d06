"""The parsers over a DataFrame of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.schemas import PARSED
from siltstone.scratch import bound_batches
from siltstone.sources.parsing import brace_code, markup, python_code
from siltstone.sources.parsing.common import LANGUAGES, Chunk


def parse(path: str, text: str, root: str = "", code_behind: str | None = None) -> list[Chunk]:
    """Chunks of one file by its extension; none for unknown ones and for empty files."""
    language = LANGUAGES.get(os.path.splitext(path)[1].lower())
    if not language or not text:
        return []
    if language == "xaml":
        return markup.parse(path, text, code_behind)
    return {"python": python_code.parse, "c_sharp": brace_code.parse_csharp, "cpp": brace_code.parse_cpp}[language](path, text, root)


def with_code_behind(files: DataFrame) -> DataFrame:
    """files (path, text) without .xaml.cs, which become the column code_behind of their markup."""
    behind = files.where(F.lower("path").endswith(".xaml.cs")).select(F.col("path").alias("__b"), F.col("text").alias("code_behind"))
    rest = files.where(~F.lower("path").endswith(".xaml.cs"))
    return rest.join(behind, F.concat("path", F.lit(".cs")) == F.col("__b"), "left").drop("__b")


def parse_source(files: DataFrame, root: str = "") -> DataFrame:
    """Chunks of files (path, text; code_behind if there is one). A file that fails gives one row with a status.
    A Python worker holds one batch of files and their chunks, so the batches are bounded."""
    bound_batches(files.sparkSession)
    if "code_behind" not in files.columns:
        files = files.withColumn("code_behind", F.lit(None).cast("string"))

    fields = T._parse_datatype_string(PARSED).fields
    texts, names = pa.list_(pa.string()), [f.name for f in fields]
    kinds = [{"int": pa.int32(), "array<string>": texts, "map<string,string>": pa.map_(pa.string(), pa.string())}.get(f.dataType.simpleString(), pa.string()) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[Chunk] = []
            for path, text, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += parse(path, text or "", root, behind)
                except Exception as e:  # one bad file must not end the job; its status says so
                    rows.append(Chunk(path, path, "file", text or "", path, 1, "", "", status=f"failed: {type(e).__name__}"))
            columns = [[getattr(c, n) for c in rows] for n in names]
            columns = [[list(x.items()) for x in c] if pa.types.is_map(k) else c for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "text", "code_behind").mapInArrow(run, PARSED)

"""Source files: scan, pruning, hashes, decoding, change detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import skipped_path

#: Fixed values.
EXTENSIONS = (".py", ".cs", ".xaml", ".cpp", ".h", ".hpp", ".c")
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")


def supported(path: Column) -> Column:
    """Files that are parsed; code-behind of markup is read with its markup."""
    lower = F.lower(path)
    test = F.lit(False)
    for e in EXTENSIONS:
        test = test | lower.endswith(e)
    return test & ~lower.endswith(".xaml.cs")


def scan(spark: SparkSession, root: str, with_code_behind: bool = False) -> DataFrame:
    """path, rel_path, content of the files below root that are not ignored or hidden. The rules on paths are plain
    filters, which Spark applies before it opens a file."""
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = base.rstrip("/")
    clean = F.regexp_replace("path", "^file:/+", "file:/")
    start = prefix.replace("file:///", "file:/")
    rel = F.substr(clean, F.lit(len(start) + 2))
    kept = files.where(~skipped_path(F.concat(F.lit("/r/"), rel), "/r"))
    wanted = supported(rel) | F.lower(rel).endswith(".xaml.cs") if with_code_behind else supported(rel)
    return kept.where(wanted).select("path", rel.alias("rel_path"), "content")


def decode(content: bytes | None) -> str:
    """The first encoding that fits; else an empty text."""
    for e in ENCODINGS if content is not None else ():
        try:
            return bytes(content).decode(e)
        except UnicodeDecodeError:
            continue
    return ""


def decoded(content: Column) -> Column:
    """UTF-8 inside the JVM; Python only for what is not."""

    @F.pandas_udf("string")
    def slow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(decode)

    fast = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else F.lit(None)
    plain = F.regexp_replace(fast, "^﻿", "")
    return F.coalesce(plain, slow(F.when(fast.isNull(), content)))


def file_state(files: DataFrame) -> DataFrame:
    """rel_path, md5 of a scan."""
    return files.select("rel_path", F.md5("content").alias("md5"))

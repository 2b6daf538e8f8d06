"""Lookups of chunks by name, path and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_segment(qn: Column) -> Column:
    """Text after the last dot; null without a dot."""
    return F.when(qn.contains("."), F.substring_index(qn, ".", -1))


def exact_or_suffix(chunks: DataFrame, names: list[str]) -> DataFrame:
    """Chunks whose name is one of names or whose qualified name ends in a dot and one of them. Names without dots make
    the suffix an equality, which a list test in the scan answers without a join."""
    plain = [n for n in names if "." not in n]
    dotted = [n for n in names if "." in n]
    test = F.col("name").isin(*names) | last_segment(F.col("qualified_name")).isin(*plain) if names else F.lit(False)
    for n in dotted:
        test = test | F.col("qualified_name").endswith("." + n)
    return chunks.where(F.coalesce(test, F.lit(False)))


def exact_names(chunks: DataFrame, names: list[str]) -> DataFrame:
    """Chunks whose name or qualified name is in names."""
    return chunks.where(F.col("name").isin(*names) | F.col("qualified_name").isin(*names)) if names else chunks.limit(0)


def find_by_name(chunks: DataFrame, names: list[str]) -> DataFrame:
    """As exact_or_suffix, or the qualified name itself, or the name without regard to case."""
    lower = [n.lower() for n in names]
    test = F.col("name").isin(*names) | F.col("qualified_name").isin(*names) | F.lower("name").isin(*lower)
    for n in names:
        test = test | F.col("qualified_name").endswith("." + n)
    return chunks.where(test).dropDuplicates(["qualified_name"]) if names else chunks.limit(0)


def path_like(path: Column, keyword: str) -> Column:
    """Contains, without regard to case; % and _ of the keyword are wildcards."""
    return path.ilike(f"%{keyword}%")


def by_file_names(path: Column, names: list[str]) -> Column:
    test = F.lit(False)
    for n in names:
        test = test | path_like(path, n)
    return test


def by_path(chunks: DataFrame, keyword: str, top_k: int = 10) -> DataFrame:
    return chunks.where(path_like(F.col("filepath"), keyword)).orderBy("filepath", "start_line", "qualified_name").limit(top_k)


def by_paths(chunks: DataFrame, keywords: list[str], top_k: int = 20) -> DataFrame:
    """One list after another, without removal of repeats."""
    out = chunks.limit(0)
    for k in keywords:
        out = out.unionByName(by_path(chunks, k, top_k))
    return out


def read_file(chunks: DataFrame, filename: str) -> DataFrame:
    """Chunks whose path holds the name, without regard to case; one a qualified name."""
    return chunks.where(F.lower("filepath").contains(filename.lower())).dropDuplicates(["qualified_name"])


def by_qualified_names(chunks: DataFrame, names: list[str]) -> DataFrame:
    return chunks.where(F.col("qualified_name").isin(*names)).limit(len(names) + 5) if names else chunks.limit(0)


def snippet(chunks: DataFrame, qualified_name: str) -> DataFrame:
    """One row: the formatted code of a chunk."""
    text = F.concat(F.lit("["), F.col("qualified_name"), F.lit("] ("), F.col("filepath"), F.lit(":"), F.col("start_line").cast("string"), F.lit(")\n"), F.col("content"))
    return chunks.where(F.col("qualified_name") == qualified_name).limit(1).select("qualified_name", text.alias("snippet"))


def without(rows: DataFrame, seen: DataFrame, key: str = "qualified_name") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def with_rows_of(found: DataFrame, chunks: DataFrame, key: str = "qualified_name") -> DataFrame:
    """A short list (some tens of rows with a key) with the columns of the chunks it names. The list is made first; its keys then are
    a filter of the scan, which skips what cannot hold them, and the other chunks' texts are not read."""
    rows = list(found.toLocalIterator())
    here = found.sparkSession.createDataFrame(rows, found.schema)
    return chunks.where(F.col(key).isin(*[r[key] for r in rows])).join(F.broadcast(here), key)

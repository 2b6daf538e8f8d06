"""What several operators need: the shared folder, word splitting, and code shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import bound_batches, hadoop_path, scratch_path

#: Bytes `\x20 \x09-\x0D`: what separates words in most operators here.
SPACES = "\t\n\x0b\x0c\r"
#: Rows (of at most some tens of bytes) up to which a counted side may be broadcast.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again. This cuts the lineage; unlike
    checkpoint() the copy is columnar, so that later reads can skip columns. A lost executor costs nothing.
    forget() deletes the copy, else the end of the application does."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}/rows"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of DataFrames made by stored() which nothing reads any more."""
    for df in tables:
        system, path = hadoop_path(df.sparkSession, df.stored_path)
        system.delete(path.getParent(), True)
        system.cancelDeleteOnExit(path.getParent())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few; else Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def large(df: DataFrame, rows: int) -> DataFrame:
    """df, to be joined by shuffle with a side of that many counted rows unless they are few, whatever size Spark takes df for:
    it goes by the bytes of files, which rows made by an explode, or well compressed, exceed many times."""
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever they run (Spark's file server sends the zip), and bound the
    size of the batches that they get."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="siltstone-code-"), "siltstone.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(target)
    context._siltstone_shipped = True


def words(text: Column) -> Column:
    """array<string> of `[^\\x20\\x09-\\x0D]+` in text; empty for null. One blank as pattern takes Java's fast split."""
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names do no harm."""
    return df.select(*[df[n] for n in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Token ids of documents in compact files.

Documents are range-partitioned by id and sorted; each task encodes its documents with the tokenizers library
and cuts them into segments of about SEGMENT ids (whole documents). A segment's byte image (see `pack_segment`)
holds the ids in patched frame-of-reference blocks with an index of block starts. Spark's Parquet writer is the
container of the images, because only Spark's writers reach every store: one row a segment with its place in
the order (part, at) beside the image.

The library splits text into pieces before it merges bytes, and pieces do not influence each other; so a piece
is encoded once by the library and its ids are kept in a bounded cache. Texts with characters outside the
checked range, or with a special string, go through the library whole.

Defined cases: null and empty texts are one end id; null ids come first and stay null; documents with equal ids are
ordered by text (null first);
an empty table writes no segment; very long texts make a segment of their own; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import pfor
from siltstone.llm.shared import only_columns, ship
from siltstone.scratch import scratch_path

SEGMENT = 1 << 19
CACHE_PIECES = 1_200_000
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я", "0-9²³¹¼-¾"
#: Characters whose classes are spelled out below; they are those of the public pattern of byte-level BPE vocabularies.
PLAIN = re.compile("[\t\n\x0b\x0c\r -~\xa1-ɏΑ-ΡΣ-ωА-я‐-‧‰-›€]*")
#: That pattern for such texts; only contractions and marks begin alike, and they stand in its order.
PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[{_DIGITS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")


class Encoder:
    """ids of texts as bytes (little-endian u32), equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.cache = cache_pieces, {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        cache, pieces = self.cache, PIECES.findall(text)
        found = list(map(cache.get, pieces))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            missing = list({pieces[i] for i in at})
            new = {p: array("I", e.ids).tobytes() for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False), strict=True)}
            if len(cache) + len(new) <= self.limit:
                cache.update(new)
            for i in at:
                found[i] = new[pieces[i]]
        return b"".join(found)


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: its pieces stay known from task to task."""
    return Encoder(path)


def pack_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """`TOK1`, u32 number of documents, a bit a document that says whether its id is null, i64 document ids (0 for null), u32 id
    counts, then the ids as coded by pfor."""
    null = np.array([d is None for d in doc_ids], bool)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([b"TOK1", struct.pack("<I", len(doc_ids)), np.packbits(null).tobytes(), known.tobytes(), np.array(counts, "<u4").tobytes(), pfor.encode(ids)])


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are null, id counts, ids."""
    if data[:4] != b"TOK1":
        raise ValueError("not a TOK1 segment")
    (n,) = struct.unpack_from("<I", data, 4)
    at = 8 + -(-n // 8)
    null = np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=n).astype(bool)
    return np.frombuffer(data, "<i8", n, at), null, np.frombuffer(data, "<u4", n, at + 8 * n), pfor.decode(data[at + 12 * n :])


def write_tokens(df: DataFrame, tokenizer_path: str, target: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment: int = SEGMENT) -> None:
    """Write the segments of all rows."""
    spark = df.sparkSession
    ship(spark)
    rows = only_columns(df, id_col, text_col).toDF("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Rows of one id (or of none) are cut by the beginnings of their texts, and equal ones by their place in the input: any number
    # of them may lie in several parts, in the order of the sort.
    keys = [F.col("doc_id"), F.left("text", F.lit(32)), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        docs, counts, held, size, done, number = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, counts, held, size, done, number
            image = pack_segment(docs, counts, np.frombuffer(b"".join(held), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], ["part", "segment", "at", "n_ids", "image"])
            docs, counts, held, done, size, number = [], [], [], done + size, 0, number + 1
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder(text.as_py()) + end
                docs.append(doc)
                counts.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment:
                    yield flush()
        if docs:
            yield flush()

    rows.mapInArrow(encode, "part int, segment int, at long, n_ids long, image binary").write.parquet(target)


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    ship(spark)
    files = spark.read.parquet(source)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, null, counts, ids = unpack_segment(image.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(docs, mask=null), pa.array(at + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("part", "at", "image").mapInArrow(decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row a part; parts are at most the number of shuffle partitions of the writing job.
    out = docs.join(F.broadcast(offsets), docs["part"] == offsets["p"])
    return out.select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write to the shared folder and read back; the files go when the application ends (write_tokens() writes where the caller says)."""
    target = f"{scratch_path(df.sparkSession, 'tokens')}/files"
    write_tokens(df, tokenizer_path, target)
    return read_tokens(df.sparkSession, target)

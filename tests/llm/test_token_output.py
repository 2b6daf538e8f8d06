import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import pfor
from siltstone.llm import token_output as op
from tests.llm.fixtures import REAL, awkward, empty, megabyte

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = st.lists(st.sampled_from(list("astmdrvle'' \n\t\r059!?.,éßñΩя漢１\x1c\x85​‐€²") + ["<|endoftext|>", "'re", " '"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.sampled_from([64, 256, 1024]), st.sampled_from([0, 50, 90, 100]))
def test_round_trip(values, block, percentile):
    data = pfor.encode(np.array(values, np.uint32), block, percentile)
    assert pfor.decode(data).tolist() == values
    assert pfor.decode(data, 1, 2).tolist() == values[block : 2 * block]


def test_exceptions_are_patched():
    v = np.arange(5000, dtype=np.uint32) % 16
    v[::50] = 2**32 - 1
    data = pfor.encode(v)
    assert (pfor.decode(data) == v).all() and len(data) < 5000


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_ids_equal_the_library(text):
    encoder = op.encoder_of(PATH)
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_full_cache_changes_nothing():
    small = op.Encoder(PATH, cache_pieces=3)
    for t in ("one two three four", "four five one", "one one two"):
        assert np.frombuffer(small(t), "<u4").tolist() == small.library.encode(t, add_special_tokens=False).ids


def check(df):
    library = op.encoder_of(PATH).library
    got = sorted((tuple(r) for r in op.token_files(df, PATH).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=lambda r: r[0])
    at, want = 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_files(spark, monkeypatch):
    check(spark.read.parquet(f"{REAL}/documents.parquet"))
    check(awkward(spark).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 2, F.col("doc_id"))))
    assert op.token_files(empty(spark), PATH).count() == 0
    monkeypatch.setattr(op, "SEGMENT", 100)
    check(awkward(spark).withColumn("doc_id", F.col("doc_id") * 7 % 5))


def test_long_texts_and_one_id_for_all(spark):
    """A text of a megabyte; and rows without an id, or with one and the same, in several parts."""
    rows = [(1, megabyte()), (2, "short")] + [(None, f"text {i % 40}") for i in range(300)] + [(7, "the same")] * 300 + [(7, f"other {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df)

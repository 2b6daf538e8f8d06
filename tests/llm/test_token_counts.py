import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import token_counts as op
from siltstone.llm.bpe_machine import Transducer
from tests.llm.fixtures import REAL, awkward, empty
from tests.llm.test_token_output import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = op.Counter(*op.compiled(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=40)), max_size=12))
def test_counts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert COUNTER(texts) == library(texts)


def test_chunks_compose():
    """Texts cut at every place relative to the chunks."""
    base = "  don't   we'll\n\n 'tis 12  ok?!\t\t x"
    texts = ["y" * k + base * 40 for k in range(0, op.CHUNK, 13)] + [base * 4000]
    assert COUNTER(texts) == library(texts)


def test_pieces_longer_than_chunks():
    """Chunks without a piece's beginning are composed one after another."""
    rnd = random.Random(2)
    texts = ["a" * 5000, " " * 9000, "-" * 3000 + "x", "ab" * 4000 + " end", "".join(rnd.choice("abcdefgh") for _ in range(40000)), "".join(rnd.choice("中文字日本語漢") for _ in range(9000))]
    assert COUNTER(texts) == library(texts)
    assert [COUNTER([t])[0] for t in texts] == library(texts)


def test_a_megabyte():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(1, 12))) for _ in range(160_000))
    assert len(text) > 1 << 20
    assert COUNTER([text, None, text[:99]]) == library([text, "", text[:99]])


def test_small_machine_and_lanes(monkeypatch):
    """States compiled on demand are dropped, and texts are taken in small parts."""
    monkeypatch.setattr(op, "LANES", 50)
    monkeypatch.setattr("siltstone.llm.bpe_machine.MAX_STATES", 0)
    machine = Transducer(COUNTER.machine.vocabulary)
    machine.freeze()
    small = op.Counter(machine, COUNTER.classes, ["<|endoftext|>"])
    texts = ["one two three", None, "", "four five six seven eight", "one <|endoftext|> two"] * 3
    assert small(texts) == library(texts)
    assert len(machine.signatures) < 60


def test_merges_alone_make_the_counts():
    """A vocabulary of our own, against merging by hand."""
    rnd = random.Random(8)
    made, merges = [bytes([c]) for c in b"abc"], []
    while len(merges) < 40:
        pair = (rnd.choice(made), rnd.choice(made))
        if pair[0] + pair[1] not in made and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            made.append(pair[0] + pair[1])
    machine = Transducer.compiled(merges)
    for _ in range(400):
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 40)))
        parts = [bytes([c]) for c in text]
        for a, b in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        assert machine.run(0, text)[1] == len(parts)


def test_real_and_awkward_rows(spark):
    for df in (spark.read.parquet(f"{REAL}/documents.parquet"), awkward(spark).withColumn("n_tokens", F.lit("clash"))):
        rows = op.token_counts(df, PATH).collect()
        assert len(rows) == df.count()
        assert [r.n_tokens for r in rows] == library([r.text for r in rows])
        assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)
    assert op.token_counts(empty(spark), PATH).count() == 0

"""Small tables with the awkward cases, shared by the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
REAL = "/root/testdata/sf0.001"


def awkward(spark, with_clash: bool = True):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, a clashing column."""
    rnd = random.Random(5)
    vocab = [a + b for a in "kptmnsrl" for b in ("a", "en", "ous", "ti", "É", "ß")]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (3, base + " tail", "en", "a", None),
        (4, None, "en", "a", 0),
        (5, "", None, None, 0),
        (6, " \t\n\x0b ", "de", "b", 5),
        (7, "one", "de", None, 3),
        (8, "One", "de", "c", 3),
        (9, prose(3000), None, "c", 0),
        (10, prose(60) + "\n" + prose(5) + "\n" + base[:400], "en", "a", 9),
        (11, "x y\nx y\n\nx y", "en", "a", 1),
        (12, "!!! 123 ???    ", "fr", "d", 1),
        (13, prose(60), "fr", "d", 1),
        (13, prose(60), "fr", "d", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if with_clash:
        from pyspark.sql import functions as F

        for name in ("size", "key", "rep", "tokens", "hash", "shard", "target", "stratum"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def megabyte(seed=11, repeats=0):
    """A text of more than a million characters in words of three to nine letters."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(3, 9))) for _ in range(5000)]
    text = " ".join(rnd.choice(vocab) for _ in range(170_000))
    assert len(text) > 1 << 20
    return text

"""Language identification by the nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character 1- to 3-grams of its letters. Each language has
several centroids (spherical k-means on its training vectors); a text gets the language of the centroid with
the highest cosine. A text whose cosine is below what training texts of its length reach is rejected.

Fitting reads a bounded sample: SAMPLE_PER_LANG training rows a language or so, chosen by a hash of the id
(the share is set from exact counts over all rows). Every language is learned, however many there are: its vectors
meet in one task, which clusters them, and its centroids (64 KB) are a row of a stored table. The driver and the
workers hold the centroids of PART languages at a time (16 MB); with more languages than that, texts are compared part
by part, and what was found so far is written between the parts. Memory is bounded by PART; the driver moreover
holds the languages' names. Prediction is a scan of the whole texts without a shuffle, one scan a part.

Defined cases: null text or a text without a letter gets `und`, score 0 and is rejected; with no training rows
everything gets `und`; ties go to the first language by code point; rows are never dropped or merged; extra
columns pass through unless they bear the output's names, which they lose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import forget, only_columns, ship, small, stored

DIM = 4096
SAMPLE_PER_LANG = 600
CLUSTERS = 4
#: Languages compared at once.
PART = 256
#: Texts compared at once; always as many (filled up with zeros), so that a text's score does not depend on its neighbours.
BLOCK = 64
#: A rejected text lies below this share of the lowest cosines (LOW_QUANTILE) of training texts as long; in texts of
#: under 2 ** SHORT_BIN letters, whose cosines vary more, below SHORT_SHARE of them.
REJECT_SHARE, LOW_QUANTILE = 0.6, 0.005
SHORT_BIN, SHORT_SHARE = 5, 0.3
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class Part:
    """Languages that are compared at once."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (sum of clusters, DIM)
    owner: np.ndarray  # language of each centroid
    floors: np.ndarray  # rejection limit by log2 of the number of letters


@dataclass
class Model:
    """Parts are loaded from the table (lang, centroids) when they are needed."""

    languages: list[str]
    idf: np.ndarray
    floors: np.ndarray
    table: DataFrame | None = None

    def parts(self) -> Iterator[Part]:
        for at in range(0, len(self.languages), PART):
            own = self.languages[at : at + PART]
            rows = sorted(self.table.where(F.col("lang").between(own[0], own[-1])).collect(), key=lambda r: r["lang"])  # PART rows
            found = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIM) for r in rows]
            owner = np.repeat(np.arange(len(rows)), [len(c) for c in found])
            yield Part([r["lang"] for r in rows], self.idf, np.concatenate(found), owner, self.floors)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1-, 2- and 3-grams; None if there is no letter. Long texts are taken in pieces,
    so that memory stays bounded."""
    letters = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    if not letters:
        return None
    out = np.zeros(DIM)
    step = 1 << 16
    for at in range(0, len(letters), step):
        part = letters[max(0, at - 2) : at + step] if at else " " + letters[: at + step]
        part += " " if at + step >= len(letters) else ""
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        one = (c[2:] if at else c) * np.uint64(0x9E3779B97F4A7C15)
        two = c[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + c[:-1] * np.uint64(0x165667B19E3779F9)
        three = two[1:] * np.uint64(0x27D4EB2F165667C5) + c[:-2] * np.uint64(0x85EBCA77C2B2AE63)
        for ids in (one, two[1:] if at else two, three):
            out += np.bincount(((ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64), minlength=DIM)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _length_bin(n_letters: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n_letters, 1)).astype(int), 0, 15)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the first row and then from the row least like the chosen ones."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(np.max(x @ x[chosen].T, axis=1))))
    c = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[near == i].mean(axis=0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _packed_counts(texts: pd.Series) -> pd.Series:
    packed = []
    for t in texts:
        v = gram_counts(t)
        packed.append(None if v is None else (i := np.flatnonzero(v)).astype(np.uint16).tobytes() + v[i].astype(np.float32).tobytes())
    return pd.Series(packed, dtype=object)


def _dense(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), DIM), np.float32)
    for row, b in zip(out, packed, strict=True):
        n = len(b) // 6
        row[np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.float32, n, 2 * n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of gram counts."""
    return _unit(np.log1p(counts) * idf)


def _idf(sample: DataFrame) -> np.ndarray:
    """From the number of sampled texts that hold each gram: one sum a task, then one row a task to the driver."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                df[np.frombuffer(packed, np.uint16, len(packed) // 6)] += 1
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([total], pa.int64())], ["df", "total"])

    df, total = np.zeros(DIM), 0
    for r in sample.select("v").coalesce(64).mapInArrow(held, "df binary, total long").collect():  # 64 rows at most
        df += np.frombuffer(r["df"], np.int64)
        total += r["total"]
    return np.log((1 + total) / (1 + df)) + 1


def _clustered(idf: np.ndarray, most: int):
    """One language's rows (lang, id, v) to its centroids, and the cosine and length of each of its texts."""

    def run(rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows.column("id").to_pylist(), rows.column("v").to_pylist(), strict=True))[:most]
        x = _dense([v for _, v in order])
        v = weighted(x, idf)
        c = k_means(v, CLUSTERS)
        sizes = _length_bin(x.sum(axis=1) / 3)
        cosines = np.max(v @ c.T, axis=1).astype(float)
        return pa.table(
            {
                "lang": pa.array([rows.column("lang")[0].as_py()], pa.string()),
                "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary()),
                "cosines": pa.array([cosines.tolist()], pa.list_(pa.float64())),
                "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
            }
        )

    return run


def _floors(clusters: DataFrame) -> np.ndarray:
    """Rejection limits by length, from the cosines of all sampled texts: one row."""
    rows = clusters.select(F.explode(F.arrays_zip("cosines", "sizes")).alias("x")).select("x.cosines", "x.sizes")
    low = lambda test: F.percentile(F.when(test, F.col("cosines")), F.lit(LOW_QUANTILE))
    own = [F.col("sizes") == b for b in range(16)]
    r = rows.agg(
        F.min("cosines").alias("least"),
        *[f for b in range(16) for f in (low(F.col("sizes") <= b).alias(f"upto{b}"), low(own[b]).alias(f"own{b}"), F.count(F.when(own[b], 1)).alias(f"n{b}"))],
    ).first()
    found = [r[f"own{b}"] if r[f"n{b}"] >= 50 else r["least"] if r[f"upto{b}"] is None else r[f"upto{b}"] for b in range(16)]
    return np.where(np.arange(16) < SHORT_BIN, SHORT_SHARE, REJECT_SHARE) * np.array(found)


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Model from rows with a language; see the module's text for the bound of the sample."""
    ship(training.sparkSession)
    rows = only_columns(training, id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("counted"), "n"), "language-counts")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("draw", draw).join(small(counts, counts.count()), F.col("lang") == F.col("counted")).where(F.col("draw") < per_lang / F.col("n"))
    sample = drawn.select("lang", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.pandas_udf(_packed_counts, "binary")("text").alias("v"))
    stored_sample = stored(sample, "language-sample")
    sample = stored_sample.where("v IS NOT NULL")  # only now: a filter would take the function below the join, to all rows
    idf = _idf(sample)
    # A group is one language's sample: per_lang rows or so by the share above, of 6 bytes a gram.
    clusters = stored(sample.groupBy("lang").applyInArrow(_clustered(idf, 2 * per_lang), "lang string, centroids binary, cosines array<double>, sizes array<int>"), "language-centroids")
    languages = sorted(r["lang"] for r in clusters.select("lang").collect())  # names alone
    forget(counts, stored_sample)
    if not languages:
        return Model([], np.ones(DIM), np.zeros(16))
    return Model(languages, idf, _floors(clusters), clusters.select("lang", "centroids"))


def nearest(part: Part, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """Language, score and rejection limit of each text (`und`, 0, 1 without a letter)."""
    out = [("und", 0.0, 1.0)] * len(texts)
    block = np.zeros((BLOCK, DIM), np.float32)
    for at in range(0, len(texts), BLOCK):
        counts = [(i, c) for i in range(at, min(at + BLOCK, len(texts))) if (c := gram_counts(texts[i])) is not None]
        block[:] = 0
        for row, (_, c) in zip(block, counts, strict=False):
            row[:] = weighted(c, part.idf)
        cosines = block @ part.centroids.T
        for (i, c), cosine in zip(counts, cosines, strict=False):
            best = int(np.argmax(cosine))
            out[i] = (part.languages[part.owner[best]], float(min(1.0, max(0.0, cosine[best]))), float(part.floors[_length_bin(np.array(c.sum() / 3))]))
    return out


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, score and rejection of each text, on the driver."""
    best = [("und", -1.0, 1.0)] * len(texts)
    for part in model.parts():
        best = [new if new[1] > old[1] else old for old, new in zip(best, nearest(part, texts), strict=True)]
    return [(lang, max(0.0, score), score < floor) for lang, score, floor in best]


def _nearest_column(df: DataFrame, part: Part, text: Column) -> Column:
    """struct<lang_pred, score, floor> of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(part)  # PART languages of 64 KB

    @F.pandas_udf("lang_pred string, score double, floor double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(nearest(shared.value, texts.tolist()), columns=["lang_pred", "score", "floor"])

    # Else a filter on the result would have every text compared twice, in twice as many Python workers.
    return run.asNondeterministic()(text)


def language_id(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected."""
    ship(df.sparkSession)
    out = df.drop("lang_pred", "score", "rejected")
    keep = [F.col(f"`{c}`") for c in out.columns]
    best, before = None, None
    for part in model.parts():
        if best is not None:  # one part is compared; what it found is written before the next one is loaded
            out = stored(out.select(*keep, best.alias("__best")), "language-part")
            if before is not None:
                forget(before)
            before = out
        out = out.withColumn("__new", _nearest_column(df, part, F.col(f"`{text_col}`")))
        new = F.col("__new")
        best = new if best is None else F.when(new["score"] > F.col("__best")["score"], new).otherwise(F.col("__best"))
    if best is None:
        return out.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    out = out.select(*keep, best.alias("__best"))
    return out.select(*keep, "__best.lang_pred", "__best.score", (F.col("__best.score") < F.col("__best.floor")).alias("rejected"))

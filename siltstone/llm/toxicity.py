"""A toxicity classifier that is trained not to react to whom a sentence mentions.

Logistic regression on the presence of words and of their first four and five letters (inflected forms share
them; so does a group's name with an insult that begins alike, and that is what the penalty undoes). Each labelled
training text has a counterfactual. A text that holds identity terms has each of them swapped for another one of its
list. Into a text that holds none, a term drawn by the text's hash is inserted, and the counterfactual has the next term of the
list instead, or none. The loss adds PENALTY times the mean squared difference of the two scores (before the
sigmoid; over the pairs that differ in any feature of the model), so weights that a neutral mention alone would move are
pushed to zero.

Fitting reads a bounded sample: about SAMPLE_ROWS labelled rows, chosen by a hash of the id, with the share
set from the exact count of labels. Hashed features, not texts, go to the driver (about 4 KB a row). Features are those
whose shares in toxic and other texts differ by STRENGTH standard errors; their number is bounded by the sample alone.
Scoring reads every whole text once, without a shuffle; its cache of words is bounded.

Defined cases: null and empty texts are scored by the bias alone; labels that are null are ignored; a
document labelled twice counts once, as toxic if any label says so; without labels every score is 0;
repeated rows give repeated rows; extra columns pass through unless they bear the output's names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import forget, only_columns, ship, stored

SAMPLE_ROWS = 14_000
BITS = 20
STRENGTH, LEAST_TEXTS = 3.0, 3
PENALTY, RIDGE, ROUNDS = 2.0, 2e-5, 400
CACHE_WORDS = 400_000
#: Lists of identity terms in four languages; a swap stays inside a list. Callers give their own for other languages.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("moroccan", "pathan", "korean", "nigerian", "mexican", "turkish", "polish"),
    ("moroccans", "pathans", "koreans", "nigerians", "mexicans", "turks", "poles"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "katholisch"),
    ("marokkaner", "türken", "polen", "koreaner", "afrikaner"),
    ("frauen", "männer"),
    ("flüchtlinge", "ausländer", "einwanderer", "einheimische"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("musulman", "chrétien", "juif", "hindou", "catholique"),
    ("marocains", "turcs", "polonais", "coréens", "africains"),
    ("femmes", "hommes"),
    ("réfugiés", "étrangers", "immigrés", "autochtones"),
    ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel"),
    ("musulmán", "cristiano", "judío", "hindú", "católico"),
    ("marroquíes", "turcos", "polacos", "coreanos", "africanos"),
    ("mujeres", "hombres"),
    ("refugiados", "extranjeros", "inmigrantes", "nativos"),
    ("homosexual", "lesbiana", "bisexual", "heterosexual"),
)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its first four and five letters."""
    forms = {"w" + word, "4" + word[:4], "5" + word[:5]}
    return tuple(sorted({xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in forms}))


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(found: set[str], lists=IDENTITY_TERMS) -> set[str] | None:
    """The words with each identity term replaced by the next one of its list; None if there is none."""
    out = set(found)
    for terms in lists:
        present = [t for t in terms if t in found]
        out -= set(present)
        out |= {terms[(terms.index(t) + 1) % len(terms)] for t in present}
    return None if out == found and not any(t in found for terms in lists for t in terms) else out


def inserted(found: set[str], lists=IDENTITY_TERMS) -> tuple[set[str], set[str]] | None:
    """A text without identity terms with one that its words' hash draws, and with the next one of the list or with none."""
    lists = [terms for terms in lists if terms]
    if not lists:
        return None
    draw = xxhash.xxh32_intdigest(" ".join(sorted(found)).encode("utf-8", "surrogatepass"))
    terms = lists[draw % len(lists)]
    at = draw // len(lists) % len(terms)
    alone = draw >> 31 or len(terms) == 1
    return found | {terms[at]}, found if alone else found | {terms[(at + 1) % len(terms)]}


def counterfactual(found: set[str], lists=IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Features that only the text, and that only its counterfactual has."""
    other = swapped(found, lists)
    pair = (found, other) if other is not None else inserted(found, lists) or (found, found)
    own, other = (_features(x) for x in pair)
    return np.setdiff1d(own, other), np.setdiff1d(other, own)


def _features(found: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((h for w in found for h in word_features(w)), dtype=np.int32))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    #: Counterfactual pairs, and those of them that differ in a feature of the model: on these the penalty acts.
    pairs: int = 0
    acting: int = 0


def train(rows: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY) -> Model:
    """Fit on hashed features; pairs hold those which only a text, and which only its counterfactual has."""
    if not len(rows) or not toxic.any():
        return Model({}, -30.0)
    if toxic.all():
        return Model({}, 30.0)
    n = 1 << BITS
    seen = {c: np.zeros(n) for c in (True, False)}
    for r, y in zip(rows, toxic, strict=True):
        seen[bool(y)][r] += 1
    p, q = seen[True] / toxic.sum(), seen[False] / (~toxic).sum()
    both = (seen[True] + seen[False]) / len(rows)
    strength = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / toxic.sum() + 1 / (~toxic).sum()) + 1e-12)
    strength[(seen[True] + seen[False]) < LEAST_TEXTS] = 0
    chosen = np.flatnonzero(strength > STRENGTH)
    column = np.full(n, -1, np.int32)
    column[chosen] = np.arange(len(chosen))

    def sparse(sets):
        cols = [c[c >= 0] for c in (column[s] for s in sets)]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int32), *cols])

    n_pairs, acts = len(pairs), lambda p: (column[p[0]] >= 0).any() or (column[p[1]] >= 0).any()
    pairs = [p for p in pairs if acts(p)]
    x, a, b = sparse(rows), sparse([u for u, _ in pairs]), sparse([v for _, v in pairs])
    dot = lambda s, w, m: np.bincount(s[0], w[s[1]], minlength=m)
    back = lambda s, g: np.bincount(s[1], g[s[0]], minlength=len(chosen))
    w, bias, y = np.zeros(len(chosen)), np.log(toxic.mean() / (1 - toxic.mean())), toxic.astype(float)
    m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, ROUNDS + 1):
        z = dot(x, w, len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        grad = back(x, g) + 2 * RIDGE * w
        if pairs:
            d = dot(a, w, len(pairs)) - dot(b, w, len(pairs))
            grad += 2 * penalty / len(pairs) * (back(a, d) - back(b, d))
        full = np.append(grad, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.999 * m2 + 0.001 * full**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({int(c): float(v) for c, v in zip(chosen, w, strict=True)}, float(bias), n_pairs, len(pairs))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    lists=IDENTITY_TERMS,
    penalty: float = PENALTY,
) -> Model:
    """Model from the labelled documents."""
    ship(documents.sparkSession)
    marks = only_columns(labels, id_col, label_col).toDF("label_id", "label").where("label_id IS NOT NULL AND label IS NOT NULL")
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    marks = marks.where(draw < sample_rows / max(n, 1)).groupBy("label_id").agg((F.max("label") > 0).alias("toxic"))
    rows = only_columns(documents, id_col, text_col).toDF("id", "text")
    # About sample_rows rows of 17 bytes, by the share above: safe to broadcast at any size of the input.
    sample = rows.join(F.broadcast(marks), F.col("id") == F.col("label_id"))

    @F.pandas_udf("own binary, more binary, less binary")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = distinct_words(t)
            more, less = counterfactual(found, lists)
            out.append((_features(found).tobytes(), more.tobytes(), less.tobytes()))
        return pd.DataFrame(out, columns=["own", "more", "less"])

    got = stored(sample.select("id", "toxic", hashed("text").alias("f")).select("id", "toxic", "f.*"), "toxicity-sample")
    ids = lambda b: np.frombuffer(b, np.int32)
    numbers = sorted(((r["id"], r["toxic"], ids(r["own"]), (ids(r["more"]), ids(r["less"]))) for r in got.toLocalIterator()), key=lambda r: (r[0], r[2].tobytes()))
    forget(got)
    return train([r[2] for r in numbers], np.array([r[1] for r in numbers], dtype=bool), [r[3] for r in numbers], penalty)


class Scorer:
    """Scores texts with a bounded cache from words to the model's features."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def __call__(self, text: str | None) -> float:
        weights, cache, hit = self.model.weights, self.cache, set()
        for w in distinct_words(text):
            found = cache.get(w)
            if found is None:
                found = tuple(h for h in word_features(w) if h in weights)
                if len(cache) < CACHE_WORDS and len(w) < 60:
                    cache[w] = found
            if found:
                hit.update(found)
        z = self.model.bias + sum(weights[h] for h in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= limit)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # as many numbers as the bounded sample has features

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    out = df.drop("score", "predicted")
    return out.withColumn("score", run(F.col(text_col))).withColumn("predicted", (F.col("score") >= limit).cast("int"))

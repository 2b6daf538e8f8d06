import math
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import language_id as op
from tests.llm.fixtures import REAL, awkward, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = op.fit(docs.where(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    out = op.language_id(docs.where(held), model).select("lang", "lang_pred", "score", "rejected", "text").collect()
    right = sum(r.lang == r.lang_pred for r in out)
    assert right >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_rejects_what_is_far_from_all_centroids(spark):
    docs = spark.read.parquet(f"{REAL}/documents.parquet")
    model = op.fit(docs)
    far = spark.createDataFrame([(1, "щюжцэ йяхф " * 60), (2, "xqzvkj wwq zzxxqj " * 80)], "doc_id long, text string")
    assert all(r.rejected for r in op.language_id(far, model).collect())


LATIN = {
    "it": "Gli abitanti del paese hanno deciso che ogni famiglia avrebbe portato qualcosa da mangiare alla festa della domenica, perché nessuno voleva restare solo.",
    "nl": "De inwoners van het dorp hebben besloten dat elk gezin iets te eten zou meenemen naar het feest van zondag, omdat niemand alleen wilde blijven.",
    "fi": "Kylän asukkaat päättivät, että jokainen perhe tuo jotakin syötävää sunnuntain juhlaan, koska kukaan ei halunnut jäädä yksin kotiin.",
    "tr": "Köyün sakinleri, kimse yalnız kalmak istemediği için her ailenin pazar günkü şenliğe yiyecek bir şeyler getirmesine karar verdiler.",
    "pl": "Mieszkańcy wsi postanowili, że każda rodzina przyniesie coś do jedzenia na niedzielne święto, ponieważ nikt nie chciał zostać sam.",
    "none": "qzjw xkvb plfh tgrw zmxn qpwl vbkj hhgf dsqz wrtp mnbv xzlk jhgq pwrt zxcv qkjh",
}


def test_rejects_latin_texts_of_other_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op.fit(docs)
    got = dict(zip(LATIN, op.predict(model, [" ".join([x] * 3) for x in LATIN.values()]), strict=True))
    assert all(rejected for _, _, rejected in got.values()), got
    share = op.language_id(docs, model).where(F.length("text") >= 40).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert share <= 0.005


def test_a_thousand_languages(spark):
    """More languages than are compared at once: each is learned and found again."""
    rnd, rows = random.Random(6), []
    for lang in range(1000):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 7)
        vocab = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(12)]
        rows += [(8 * lang + i, " ".join(rnd.choice(vocab) for _ in range(60)), f"l{lang:04d}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert op.PART < 1000
    model = op.fit(df)
    assert len(model.languages) == 1000
    got = op.language_id(df, model).select("lang", "lang_pred", "rejected").collect()
    assert len(got) == 3000 and all(r.lang == r.lang_pred and not r.rejected for r in got)


def _plain(train, texts):
    """The method in plain Python: counts in dictionaries, one vector after another."""
    vectors = {lang: [np.asarray(op.gram_counts(t)) for _, t in sorted(rows)] for lang, rows in train.items()}
    every = [v for rows in vectors.values() for v in rows]
    idf = [math.log((1 + len(every)) / (1 + sum(v[g] > 0 for v in every))) + 1 for g in range(op.DIM)]

    def unit(v):
        x = [math.log1p(c) * w for c, w in zip(v, idf, strict=True)]
        n = math.sqrt(sum(c * c for c in x))
        return [c / n for c in x]

    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    centroids = []
    for lang in sorted(vectors):
        points = [unit(v) for v in vectors[lang]]
        centres = [points[0]]
        while len(centres) < min(op.CLUSTERS, len(points)):
            centres.append(min(points, key=lambda p: max(dot(p, c) for c in centres)))
        for _ in range(12):
            near = [max(range(len(centres)), key=lambda i: dot(p, centres[i])) for p in points]
            for i in range(len(centres)):
                own = [p for p, k in zip(points, near, strict=True) if k == i]
                if own:
                    mean = [sum(c) / len(own) for c in zip(*own, strict=True)]
                    size = math.sqrt(dot(mean, mean))
                    centres[i] = [c / size for c in mean]
        centroids += [(lang, c) for c in centres]
    out = []
    for t in texts:
        v = unit(op.gram_counts(t))
        lang, c = max(centroids, key=lambda x: dot(v, x[1]))
        out.append((lang, dot(v, c)))
    return out


def test_equals_the_method_in_plain_python(spark):
    docs = spark.read.parquet(f"{REAL}/documents.parquet").where("length(text) BETWEEN 80 AND 900").orderBy("doc_id").limit(48)
    rows = [r for r in docs.collect() if r.doc_id % 3]
    train = {}
    for r in rows:
        train.setdefault(r.lang, []).append((str(r.doc_id), r.text))
    texts = [r.text for r in docs.collect() if not r.doc_id % 3]
    got = op.predict(op.fit(docs.where("doc_id % 3 <> 0")), texts)
    want = _plain(train, texts)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)


def test_grams_are_counted_one_by_one():
    """Counts of a text longer than a piece equal those of its grams, hashed one at a time."""
    m = 1 << 64
    mix = lambda x: ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % m) >> 52
    text = "Ab, é" * 30000
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text).split()).lower() + " "
    c, want = [ord(x) for x in padded], np.zeros(op.DIM)
    two = lambda a, b: (b * 0xC2B2AE3D27D4EB4F + a * 0x165667B19E3779F9) % m
    for i in range(len(c)):
        want[mix(c[i] * 0x9E3779B97F4A7C15 % m)] += 1
        if i >= 1:
            want[mix(two(c[i - 1], c[i]))] += 1
        if i >= 2:
            want[mix((two(c[i - 1], c[i]) * 0x27D4EB2F165667C5 + c[i - 2] * 0x85EBCA77C2B2AE63) % m)] += 1
    assert len(text) > 1 << 16 and (op.gram_counts(text) == want).all()


def test_awkward_rows(spark):
    model = op.fit(spark.read.parquet(f"{REAL}/documents.parquet"))
    df = awkward(spark).withColumn("score", F.lit("clash"))
    rows = op.language_id(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.languages
    assert op.language_id(empty(spark), model).count() == 0
    none = op.fit(empty(spark))
    assert {r.lang_pred for r in op.language_id(df, none).collect()} == {"und"}


def test_long_texts_count_like_short_ones():
    text = "Ein Haus am See, " * 9000
    whole = op.gram_counts(text)
    op_step = len(text) > (1 << 16)
    assert op_step and whole.sum() >= 2.9 * sum(c.isalpha() for c in text)
    again = op.gram_counts("Ein Haus am See, " * 3)
    assert set(np.flatnonzero(again)) <= set(np.flatnonzero(whole))

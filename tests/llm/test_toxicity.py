import itertools

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import queries
from siltstone.llm import toxicity as op
from tests.llm.fixtures import awkward, empty


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = op.fit(docs, labels.where(~held))
    rows = op.toxicity(docs.join(labels.where(held), "doc_id"), model).select("toxic", "predicted", "score").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * (len(rows) - len(toxic))
    assert all(0 <= r.score <= 1 for r in rows)


def _biased(penalty):
    """Labels in which one group is mentioned mostly in toxic rows."""
    rnd = np.random.default_rng(4)
    texts, y = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        group = "muslim" if rnd.random() < (0.9 if toxic else 0.05) else "christian" if rnd.random() < 0.5 else ""
        insult = "idiot" if toxic and rnd.random() < 0.8 else ""
        texts.append(" ".join([group, insult, *rnd.choice(["tree", "river", "stone", "cloud"], 3)]))
        y.append(toxic)
    rows, pairs = [], []
    for t in texts:
        found = op.distinct_words(t)
        rows.append(op._features(found))
        if op.swapped(found) is not None:
            pairs.append(op.counterfactual(found))
    return op.Scorer(op.train(rows, np.array(y), pairs, penalty))


def test_counterfactual_penalty_frees_neutral_mentions():
    plain, fair = _biased(0.0), _biased(op.PENALTY)
    neutral, other = "a muslim tree by the river", "a christian tree by the river"
    assert plain(neutral) > 0.5 and abs(plain(neutral) - plain(other)) > 0.3
    assert abs(fair(neutral) - fair(other)) < 0.1 and fair(neutral) < plain(neutral)
    assert fair("muslim idiot tree") > 0.5 and fair("idiot tree") > 0.5


def _gaps(score):
    return [abs(score(a) - score(b)) for terms in op.IDENTITY_TERMS for a, b in itertools.combinations(terms, 2)]


def test_the_penalty_acts_on_the_query(spark):
    """The tables name no group; counterfactuals are inserted, and the query's own model shows their effect."""
    plain, fair = (queries.op5_model(spark, "/root/testdata/sf0.1", **o) for o in ({"penalty": 0.0}, {}))
    assert fair.pairs > 2000 and fair.acting > 20
    assert max(_gaps(op.Scorer(plain))) > 0.01
    assert max(_gaps(op.Scorer(fair))) < 0.001


def test_equals_gradient_descent_in_plain_numpy():
    """The same loss on dense arrays, its gradient written out."""
    rnd = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] + ["moroccan", "korean", "moron"]
    sets = [set(rnd.choice(words, 9, replace=False)) for _ in range(300)]
    toxic = np.array(["moron" in s or ("waa" in s and "wbb" in s) for s in sets])
    rows, pairs = [op._features(s) for s in sets], [op.counterfactual(s) for s in sets]
    model = op.train(rows, toxic, pairs)
    chosen = sorted(model.weights)
    assert 3 <= len(chosen) and model.pairs == 300 and 0 < model.acting < 300
    dense = lambda xs: np.array([[float(c in set(x.tolist())) for c in chosen] for x in xs])
    x, d = dense(rows), dense([p[0] for p in pairs]) - dense([p[1] for p in pairs])
    d = d[[bool(np.isin(p[0], chosen).any() or np.isin(p[1], chosen).any()) for p in pairs]]
    w = np.append(np.zeros(len(chosen)), np.log(toxic.mean() / (1 - toxic.mean())))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, op.ROUNDS + 1):
        miss = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - toxic) / len(x)
        g = np.append(x.T @ miss + 2 * op.RIDGE * w[:-1] + 2 * op.PENALTY * d.T @ (d @ w[:-1]) / len(d), miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.05 * m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    assert np.allclose([model.weights[c] for c in chosen], w[:-1], atol=1e-6) and abs(model.bias - w[-1]) < 1e-6
    score = op.Scorer(model)
    for s in sets[:40]:
        own = set(op._features(s).tolist())
        z = model.bias + sum(v for c, v in zip(chosen, w[:-1], strict=True) if c in own)
        assert abs(score(" ".join(s)) - 1 / (1 + np.exp(-z))) < 1e-6


def test_counterfactuals():
    more, less = op.counterfactual({"gay", "tree"})
    assert set(more) == set(op._features({"gay"})) - set(op._features({"straight", "tree"}))
    assert set(less) == set(op._features({"straight"})) - set(op._features({"gay", "tree"}))
    with_term, other = op.inserted({"tree"})
    assert "tree" in with_term & other and len(with_term) == 2 and len(other) in (1, 2) and with_term != other
    assert op.inserted({"tree"}) == op.inserted({"tree"})
    assert op.inserted({"tree"}, ()) is None and all(not len(x) for x in op.counterfactual({"tree"}, ()))


def test_long_texts(spark):
    text = "idiot " + "river stone " * 120_000
    model = op.Model({h: 1.0 for h in op.word_features("idiot")}, -1.0)
    df = spark.createDataFrame([(1, text), (2, text[6:])], "doc_id long, text string")
    assert [r.predicted for r in op.toxicity(df, model).orderBy("doc_id").collect()] == [1, 0]


def test_swaps():
    assert op.swapped({"tree"}) is None
    assert op.swapped({"gay", "tree"}) == {"straight", "tree"}
    assert op.swapped({"woman", "man"}) == {"woman", "man"}


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    out = op.toxicity(df, op.fit(df, labels)).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    none = op.fit(df, labels.limit(0))
    assert {r.predicted for r in op.toxicity(df, none).collect()} == {0}
    assert op.toxicity(empty(spark), none).count() == 0

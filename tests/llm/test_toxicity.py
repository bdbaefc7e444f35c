"""Toxicity: trees and calibration against plain versions, held-out accuracy, planted documents, edges."""

import numpy as np
import pytest
from helpers import EDGE, documents

from codexmill.llm import queries, toxicity


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    p = np.full(200, 0.5)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    tree = toxicity.grow(bins, edges, p - y, p * (1 - p))

    def gain(f, t):
        g, h, left = p - y, p * (1 - p), x[:, f] <= t
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + toxicity.RIDGE)
        return part(left) + part(~left) - part(np.ones(200, bool))

    best = max(((f, t) for f in range(3) for t in edges[f]), key=lambda c: gain(*c))
    assert (tree.feature[0], tree.threshold[0]) == best
    # rows are sent as the tree was grown
    assert np.allclose(tree.apply(x), [tree.leaves[_leaf(tree, row)] for row in x])


def _leaf(tree, row):
    node = 0
    for _ in range(toxicity.DEPTH):
        node = 2 * node + 1 + int(row[tree.feature[node]] > tree.threshold[node])
    return node - (2**toxicity.DEPTH - 1)


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    loss = lambda n: (lambda m: np.log1p(np.exp(-(2 * y - 1) * m)).mean())(toxicity.boost(x, y, n).margins(x))
    assert loss(0) > loss(5) > loss(40) and loss(40) < 0.1


def test_isotonic_is_the_monotone_least_squares_fit():
    rng = np.random.default_rng(2)
    margins = np.sort(rng.random(60))
    labels = (rng.random(60) < margins).astype(float)
    at, value = toxicity.isotonic(margins, labels)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()
    # the fit's value at i: over all beginnings up to i the largest of the least means of what begins there and ends at i or later
    fit = [max(min(labels[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    steps = len(np.unique(np.round(fit, 9)))
    assert steps == len(at)


def test_obfuscated_words_count():
    measure = toxicity.Measure(toxicity.Lexicon({"idiot": 4.0, "moron": 3.0}, {}))
    value = lambda text: dict(zip(toxicity.FEATURES, measure.features(text), strict=True))
    assert value("you are an id1ot and a m o r o n")["disguised_hits"] == pytest.approx(np.log1p(2))
    assert value("such an idiooot here")["disguised_hits"] > 0 and value("such an idea here")["disguised_hits"] == 0
    near, far = value("you idiot " + "x " * 50), value("idiot " + "x " * 50 + "you")
    assert near["nearness"] > far["nearness"] and near["least_distance"] < far["least_distance"]
    assert value("STOP IT NOW!!")["capital_words"] == 1 and value("")["least_distance"] == 100


def toxic_corpus(n):
    """Words of three letters; every fifth text holds two or more of the bad ones."""
    rng = np.random.default_rng(4)
    words = ["".join(x) for x in rng.choice(list("abcdefghiklmnoprstuw"), (400, 4))]
    bad = [f"zz{w}" for w in words[:8]]
    texts, labels = [], []
    for i in range(n):
        body = list(rng.choice(words, 60))
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            body.insert(int(rng.integers(60)), str(rng.choice(bad)))
        texts.append(" ".join(map(str, body)))
        labels.append(int(toxic))
    return texts, labels, bad


def test_planted_toxic_documents_are_caught_and_clean_ones_left_alone(spark):
    texts, labels, bad = toxic_corpus(600)
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    fresh, want, _ = toxic_corpus(200)
    got = sorted(toxicity.predict(documents(spark, fresh), model).collect())
    assert [int(r.score >= 0.3) for r in got] == want
    again = toxicity.fit(docs, known)
    assert np.array_equal(again.value, model.value) and again.lexicon == model.lexicon and set(model.lexicon.words) <= set(bad)


def test_edges(spark):
    docs = documents(spark, EDGE)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == pytest.approx(0.5, abs=1e-3) for r in toxicity.predict(docs, none).collect())
    odd = spark.createDataFrame([(0, 1), (1, None), (3, 7), (None, 1), (4, 0), (4, 1), (999, 0)], "doc_id long, toxic int")
    scored = toxicity.predict(docs, toxicity.fit(docs, odd)).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.predict(docs.where("false"), none).collect() == []


def test_held_out_accuracy(spark):
    """On the driver's tables: the fold that isn't learned from."""
    base = "/root/testdata/sf0.1"
    held = queries.op12_toxicity(spark, base).where("held_out")
    rows = held.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    above = sum(a.score > b.score for a in toxic for b in clean) / len(toxic) / len(clean)
    assert above > 0.97 and sum(r.predicted for r in toxic) / len(toxic) > 0.85 and sum(r.predicted for r in clean) / len(clean) < 0.01

"""MOD-2 as an iterative fit: against plain numpy, over restarts and partitionings."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentspark.operators import model as nb
from intentspark.operators import softmax as sm
from intentspark.operators import split

SCHEMA = "Id long, text string, label string"


def rows(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rnd.choices(words[(i % 3) * 15:(i % 3) * 15 + 30], k=rnd.randrange(0, 12))), f"L{i % 3}") for i in range(n)]
    return [*out, (n, None, "L1"), (n + 1, "", "L0"), (n + 1, "", "L0")]


def brute(train, held, hashes, buckets, epochs, warmup, rate):
    """(weights by epoch, (train loss, held loss, held accuracy) by epoch) with dense matrices."""
    labels = sorted({y for _, _, y in train})

    def matrix(data):
        x = np.zeros((len(data), buckets + 1))
        for i, (_, t, _) in enumerate(data):
            for tok in (t or "").split():
                x[i, hashes[tok]] = 1
            x[i] /= np.linalg.norm(x[i]) or 1.0
            x[i, buckets] = 1.0
        return x, np.array([labels.index(y) if y in labels else -1 for *_, y in data])

    (x, y), (xh, yh) = matrix(train), matrix(held)
    c = np.stack([(x[y == k] > 0).sum(axis=0) for k in range(len(labels))]).astype(float)
    w = np.log(np.hstack([(c[:, :-1] + 1) / (c[:, :-1].sum(axis=1, keepdims=True) + buckets), c[:, -1:] / len(y)]))
    w = w - w.mean(axis=0)
    g2, every, history = np.zeros_like(w), [w], []
    prob = lambda x: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(x @ w.T - (x @ w.T).max(axis=1, keepdims=True)))
    for e in range(epochs + 1):
        p, ph = prob(x), prob(xh)
        held_loss = -np.log(ph[np.arange(len(yh)), np.maximum(yh, 0)])[yh >= 0].sum() / len(yh)
        history.append((-np.log(p[np.arange(len(y)), y]).mean(), held_loss, (ph.argmax(axis=1) == yh).mean()))
        p[np.arange(len(y)), y] -= 1
        g = p.T @ x / len(y)
        g2 = g2 + g * g
        w = w - rate * min(1, (e + 1) / warmup) * g / np.sqrt(g2 + 1e-12)
        every.append(w)
    return every, history


@pytest.fixture(scope="module")
def parts(spark):
    train, held = rows(150), [*rows(60, 2), (999, "w1", "unseen")]
    words = spark.createDataFrame([(f"w{i}",) for i in range(60)], "t string")
    hashes = {r[0]: r[1] for r in words.select("t", F.pmod(F.xxhash64("t"), F.lit(32))).collect()}
    return train, held, hashes


def test_weights_equal_plain_numpy_under_any_partitioning(spark, parts, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 7)
    train, held, hashes = parts
    every, history = brute(train, held, hashes, 32, 4, 2, 0.7)
    for n in (1, 5):
        m = sm.fit_softmax(spark.createDataFrame(train, SCHEMA).repartition(n), spark.createDataFrame(held, SCHEMA).repartition(n),
                           "label", "text", epochs=4, warmup=2, rate=0.7, buckets=32)
        assert m.labels == ["L0", "L1", "L2"]
        assert np.allclose([h[1:] for h in m.history], history, atol=1e-9)
        best = min(range(5), key=lambda e: (-m.history[e][3], m.history[e][2], e))
        assert m.epoch == best and np.abs(m.weights - every[best]).max() < 1e-9
    got = {r["Id"]: r["predicted"] for r in sm.score_softmax(spark.createDataFrame(held, SCHEMA), m, "Id", "text").collect()}
    again = sm.score_softmax(spark.createDataFrame(held, SCHEMA).repartition(3), m, "Id", "text", carry=["label"]).collect()
    assert {r["Id"]: r["predicted"] for r in again} == got
    assert np.mean([r["predicted"] == r["label"] for r in again]) == pytest.approx(m.history[best][3])


def test_a_broken_fit_goes_on(spark, parts, tmp_dir, monkeypatch):
    train, held = (spark.createDataFrame(p, SCHEMA).repartition(2) for p in parts[:2])
    fit = lambda state=None: sm.fit_softmax(train, held, "label", "text", epochs=4, buckets=32, state=state)
    whole, state, step, ran = fit(), os.path.join(tmp_dir, "state"), sm._epoch, []

    def failing(features, weights, counting=False):
        ran.append(counting)
        if ran == [True, False, False, False]:
            raise RuntimeError("lost")
        return step(features, weights, counting)

    monkeypatch.setattr(sm, "_epoch", failing)
    with pytest.raises(RuntimeError):
        fit(state)
    m = fit(state)
    # counts, epochs 0, 1 and the lost one; then counts, 2, 3 and the last scoring
    assert ran == [True, False, False, False, True, False, False, False]
    assert m.epoch == whole.epoch and np.abs(m.weights - whole.weights).max() < 1e-9
    assert np.allclose([h[1:] for h in m.history], [h[1:] for h in whole.history], atol=1e-9)


def test_at_least_as_good_as_the_count_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    flagged = split.with_split(docs, "doc_id", fraction=0.3).cache()
    train, held = (flagged.filter(F.col("split") == s) for s in ("train", "eval"))
    m = sm.fit_softmax(train, held, "lang", "text")
    counted = nb.score_intent_model(held, nb.fit_intent_model(train, "lang", "text"), "doc_id", "text", carry=["lang"])
    naive = counted.filter("lang = predicted").count() / held.count()
    mine = sm.score_softmax(held, m, "doc_id", "text", carry=["lang"]).filter("lang = predicted").count() / held.count()
    flagged.unpersist()
    assert mine >= naive > 0.9
    assert m.history[-1][1] < m.history[1][1] < m.history[0][1]


def test_bounds_and_odd_tables(spark):
    train = spark.createDataFrame(rows(9), SCHEMA)
    with pytest.raises(ValueError):
        sm.fit_softmax(train.limit(0), train, "label", "text", buckets=32)
    with pytest.raises(ValueError):
        sm.fit_softmax(train.withColumn("label", F.lit(None).cast("string")), train, "label", "text", buckets=32)
    with pytest.raises(ValueError):
        sm.fit_softmax(train, train, "label", "text", buckets=sm.MAX_WEIGHTS)
    m = sm.fit_softmax(train, train.limit(0), "label", "text", epochs=1, buckets=32)
    assert sm.score_softmax(train.limit(0), m, "Id", "text").count() == 0


def test_rows_are_taken_in_bounded_parts(spark, parts, monkeypatch):
    train, held, hashes = parts
    every, history = brute(train, held, hashes, 32, 2, 2, 0.7)
    monkeypatch.setattr(sm, "PART", 5)  # fewer than some rows have
    m = sm.fit_softmax(spark.createDataFrame(train, SCHEMA).repartition(2), spark.createDataFrame(held, SCHEMA), "label", "text",
                       epochs=2, warmup=2, rate=0.7, buckets=32)
    assert np.allclose([h[1:] for h in m.history], history, atol=1e-9) and np.abs(m.weights - every[m.epoch]).max() < 1e-9
    w = m.weights
    best = {i: m.labels[int((w[:, sorted({hashes[x] for x in (t or "").split()})].sum(axis=1)
                             / max(len({hashes[x] for x in (t or "").split()}), 1) ** 0.5 + w[:, -1]).argmax())] for i, t, _ in held}
    got = sm.score_softmax(spark.createDataFrame(held, SCHEMA), m, "Id", "text").collect()
    assert len(got) == len(held) and all(best[r["Id"]] == r["predicted"] for r in got)


def test_the_feature_table_holds_each_bucket_once(spark):
    df = spark.createDataFrame([("b", True, [3, 1, 3]), ("a", False, []), ("?", True, [0])], "label string, held boolean, hashed array<int>")
    got = sm._feature_table(df.coalesce(1), ["a", "b"], 8)
    assert got.columns == ["label", "held", "at"]
    assert sorted(map(tuple, got.collect())) == [(-1, True, [0]), (0, False, []), (1, True, [1, 3])]

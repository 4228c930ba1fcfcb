"""MOD-2..MOD-5, SNK-3 against a brute-force naive Bayes."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from intentspark.operators import model as m

TRAIN = [(1, "red apple red", "fruit"), (2, "green apple", "fruit"), (3, "red car fast", "car"),
         (4, "fast car", "car"), (5, "blue car", "car")]
TEST = [(10, "red red apple"), (11, "fast blue"), (12, ""), (13, "unseen words only")]


def brute(train, test, alpha=1.0):
    counts, docs, tot = {}, Counter(), Counter()
    vocab = set()
    for _, t, y in train:
        toks = t.split()
        docs[y] += 1
        tot[y] += len(toks)
        for w in toks:
            counts[(y, w)] = counts.get((y, w), 0) + 1
            vocab.add(w)
    out = {}
    for k, t in test:
        toks = t.split()
        best = None
        for y in sorted(docs):
            s = math.log(docs[y]) - len(toks) * math.log(tot[y] + alpha * len(vocab))
            s += sum(f * math.log(counts.get((y, w), 0) + alpha) for w, f in Counter(toks).items())
            if best is None or s > best[0]:
                best = (s, y)
        out[k] = best[1]
    return out


@pytest.fixture(params=["pivot", "by label"], autouse=True)
def way(request, monkeypatch):
    """Both ways of scoring, for few labels and for many."""
    if request.param == "by label":
        monkeypatch.setattr(m, "PIVOT_LABELS", 0)


def test_fit_predict_matches_brute_force(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    test = spark.createDataFrame(TEST, "Id long, text string")
    model = m.fit_intent_model(train, "label", "text")
    pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(test, model, "Id", "text").collect()}
    assert pred == brute(TRAIN, TEST)
    assert None not in pred.values()
    # empty text: the prior decides (car has 3 docs, fruit 2)
    assert pred[12] == "car"


def test_counts_and_meta(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    model = m.fit_intent_model(train, "label", "text")
    got = {(r["label"], r["token"]): r["n_tok"] for r in model.counts.collect()}
    assert got[("fruit", "red")] == 2 and got[("car", "car")] == 3
    meta = model.meta_row()
    assert meta["vocab_size"] == 6 and meta["n_docs"] == 5


def test_evaluate_and_format(spark):
    pred = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "k long, predicted string")
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k long, y string")
    conf, metrics = m.evaluate(pred, truth, key="k", label="y")
    c = {(r["truth"], r["predicted"]): r["n"] for r in conf.collect()}
    assert c == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1}
    lines = {r["metric"]: r["line"] for r in m.format_metrics(metrics).collect()}
    assert lines == {"accuracy": "accuracy: 0.5000", "recall:a": "recall:a: 0.6667",
                     "recall:b": "recall:b: 0.0000"}


def test_save_load_round_trip(spark, tmp_dir):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    model = m.fit_intent_model(train, "label", "text")
    m.save_model(model, f"{tmp_dir}/model")
    back = m.load_model(spark, f"{tmp_dir}/model")
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, model.counts.collect()))
    test = spark.createDataFrame(TEST, "Id long, text string")
    p1 = {r[0]: r[1] for r in m.score_intent_model(test, back, "Id", "text").collect()}
    assert p1 == brute(TRAIN, TEST)


def test_scoring_shuffles_no_text(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    model = m.fit_intent_model(train, "label", "text")
    test = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("Id"), "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = m.score_intent_model(test, model, "Id", "text")._jdf.queryExecution().executedPlan()
        # what the scored rows' exchanges carry (the weights' own holds tokens)
        carried = []

        def walk(node):
            if "ShuffleExchange" in node.getClass().getSimpleName():
                carried.append(node.output().toString())
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))
        walk(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    carried = [out for out in carried if "_key" in out]
    assert carried
    assert not any(name in out for out in carried for name in ("text", "_toks", "token"))


def test_shuffle_join_path_gives_same_predictions(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    test = spark.createDataFrame(TEST, "Id long, text string")
    spark.conf.set("spark.intentspark.broadcastBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = m.fit_intent_model(train, "label", "text")
        scored = m.score_intent_model(test, model, "Id", "text")
        plan = scored._jdf.queryExecution().executedPlan().toString()
        pred = {r["Id"]: r["predicted"] for r in scored.collect()}
    finally:
        spark.conf.unset("spark.intentspark.broadcastBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan
    assert pred == brute(TRAIN, TEST)


def test_smoothing_other_than_one(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    # documents whose label depends on counting unseen tokens as ln(alpha)
    extra = [(14, "red blue"), (15, "red red car"), (16, "green"), (17, "apple green car")]
    test = spark.createDataFrame(TEST + extra, "Id long, text string")
    for alpha in (0.5, 3.0):
        model = m.fit_intent_model(train, "label", "text", alpha=alpha)
        pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(test, model, "Id", "text").collect()}
        assert pred == brute(TRAIN, TEST + extra, alpha=alpha)


def test_many_labels_match_brute_force(spark):
    import random
    extra = [(14, "red blue"), (15, "red red car"), (16, "green"), (17, "apple green car")]
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    test = spark.createDataFrame(TEST + extra, "Id long, text string")
    for alpha in (1.0, 0.5, 3.0):
        model = m.fit_intent_model(train, "label", "text", alpha=alpha)
        pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(test, model, "Id", "text").collect()}
        assert pred == brute(TRAIN, TEST + extra, alpha=alpha), alpha
    # many labels with uneven sizes, long and empty documents
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    train_rows = []
    for i in range(900):
        lab = f"L{rnd.randrange(300):03d}"
        train_rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))), lab))
    test_rows = [(10_000 + i, " ".join(rnd.choice(words + ["zz"]) for _ in range(rnd.randrange(0, 40))))
                 for i in range(200)]
    tr = spark.createDataFrame(train_rows, "Id long, text string, label string")
    te = spark.createDataFrame(test_rows, "Id long, text string")
    model = m.fit_intent_model(tr, "label", "text")
    pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(te, model, "Id", "text").collect()}
    assert pred == brute(train_rows, test_rows)


def test_repeated_keys_are_scored_row_by_row(spark):
    train = spark.createDataFrame(TRAIN, "Id long, text string, label string")
    rows = [(1, "red red apple", "fruit"), (1, "fast blue", "car"), (1, "fast blue", "car"), (1, "fast blue", "fruit"),
            (None, "apple", "fruit"), (2, None, "car"), (2, "", "car")]
    test = spark.createDataFrame(rows, "Id long, text string, y string").repartition(3)
    model = m.fit_intent_model(train, "label", "text")
    scored = m.score_intent_model(test, model, "Id", "text", carry=["y"])
    want = Counter((k, y, brute(TRAIN, [(0, t or "")])[0]) for k, t, y in rows)
    assert Counter((r["Id"], r["y"], r["predicted"]) for r in scored.collect()) == want
    confusion, _ = m.evaluate_scored(scored, "y")
    assert sum(r["n"] for r in confusion.collect()) == len(rows)


def test_frequent_tokens_broadcast_and_rare_ones_shuffled(spark):
    rows = [(i, f"the w{i % 40} w{i % 7} the", f"L{i % 9}") for i in range(300)]
    test_rows = [(1000 + i, f"the w{i} the w{i % 5} zz") for i in range(60)] + [(2000, ""), (2001, "zz")]
    train = spark.createDataFrame(rows, "Id long, text string, label string")
    test = spark.createDataFrame(test_rows, "Id long, text string")
    model = m.fit_intent_model(train, "label", "text")
    spark.conf.set("spark.intentspark.broadcastBytes", "3000")
    try:
        weights = model.counts.select("token", "label", F.col("n_tok").alias("_n"), F.lit(1).alias("_w"))
        head, tail = m._split_weights(weights, 3000)
        assert head.count() and tail.count() and head.count() + tail.count() == model.counts.count()
        assert ("the",) in {tuple(r) for r in head.select("token").distinct().collect()}
        pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(test, model, "Id", "text").collect()}
    finally:
        spark.conf.unset("spark.intentspark.broadcastBytes")
    assert pred == brute(rows, test_rows)


def test_ties_do_not_depend_on_copies(spark):
    train = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "d", "z")], "Id long, text string, label string")
    model = m.fit_intent_model(train, "label", "text", alpha=0.3)
    rows = [(n, "a b c a b a") for n in range(1, 8) for _ in range(n)]  # x and y tie exactly
    got = m.score_intent_model(spark.createDataFrame(rows, "Id long, text string").repartition(3), model, "Id", "text")
    assert Counter(map(tuple, got.collect())) == Counter((n, "x") for n, _ in rows)


def test_best_smoothing_is_the_most_accurate(spark):
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(words[(i % 3) * 8:(i % 3) * 8 + 20], k=rnd.randrange(0, 9))), f"L{i % 3}") for i in range(400)]
    train, held = rows[:60], rows[60:] + rows[60:70]
    df = lambda r: spark.createDataFrame(r, "Id long, text string, label string")
    alphas = (0.001, 0.05, 1.0, 20.0)
    model = m.fit_intent_model(df(train), "label", "text")
    chosen, report = m.best_smoothing(model, df(held), "label", "text", alphas)
    want, hits = Counter(), Counter()
    for a in alphas:
        pred = brute(train, [(i, t) for i, (_, t, _) in enumerate(held)], alpha=a)
        for i, (_, _, y) in enumerate(held):
            want[a, y, pred[i]] += 1
            hits[a] += pred[i] == y
    best = min(alphas, key=lambda a: (-hits[a], a))
    got = report.collect()
    assert {(r["alpha"], r["truth"], r["predicted"]): r["n"] for r in got} == dict(want)
    assert {r["alpha"] for r in got if r["best"]} == {best} and chosen.meta_row()["alpha"] == best
    pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(df(held[:300]), chosen, "Id", "text").collect()}
    assert pred == brute(train, [(k, t) for k, t, _ in held[:300]], alpha=best)
    with pytest.raises(ValueError):
        m.best_smoothing(model, df(held), "label", "text", (0.0,))


def test_a_thousand_labels_take_seconds(spark):
    import time
    rows = [(i, f"w{i % 1000} v{i % 37} w{i % 90}", f"L{i % 1000:04d}") for i in range(3000)]
    test_rows = [(i, f"w{i} v{i % 37} u{i % 3}") for i in range(400)]
    model = m.fit_intent_model(spark.createDataFrame(rows, "Id long, text string, label string"), "label", "text")
    began = time.monotonic()
    scored = m.score_intent_model(spark.createDataFrame(test_rows, "Id long, text string"), model, "Id", "text")
    pred = {r["Id"]: r["predicted"] for r in scored.collect()}
    assert time.monotonic() - began < 20
    assert pred == brute(rows, test_rows)

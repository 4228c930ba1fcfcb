"""Scale properties: hot keys stay correct and plans never funnel whole
tables through one task."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from intentspark.operators import model as m
from intentspark.operators import prompts
from intentspark.streaming import hygiene

SF = "/root/testdata/sf0.001"


def _static_plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_single_task_funnel(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _static_plan(spark, E.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"\bWindow\b", plan)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # only partial aggregates (one row per partition) may be gathered
            assert "Aggregate" in lines[i + 1], (name, lines[i:i + 2])


def test_hot_conversation_renders_in_order(spark, monkeypatch):
    monkeypatch.setattr(prompts, "CHAT_BLOCK", 50)
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(1500)]
    rows += [(c, 0, "user", f"c{c}") for c in range(1, 3001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = {r["conv_id"]: r["text"] for r in prompts.render_chat(df).collect()}
    want0 = "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\nt{t}<|end|>\n" for t in range(1500))
    assert out[0] == want0 + "<|assistant|>\n"
    assert len(out) == 3001 and out[17] == "<|user|>\nc17<|end|>\n<|assistant|>\n"


def test_hot_session_until_exit(spark):
    rows = [(0, t, "exit" if t == 2500 else f"m{t}") for t in range(3000)]
    rows += [(s, 0, "x") for s in range(1, 6001)]
    df = spark.createDataFrame(rows, "s long, turn long, text string").repartition(5)
    out = hygiene.until_exit(df, "s", "turn")
    c = Counter(r["s"] for r in out.collect())
    assert c[0] == 2500 and len(c) == 6001


def test_hot_label_and_token_model(spark):
    train_rows = [(i, "the the the hot", "big") for i in range(3000)]
    train_rows += [(10_000 + i, f"w{i % 50} the", f"l{i % 5}") for i in range(3000)]
    train = spark.createDataFrame(train_rows, "Id long, text string, label string").repartition(6)
    model = m.fit_intent_model(train, "label", "text")
    counts = {(r["label"], r["token"]): r["n_tok"] for r in model.counts.collect()}
    assert counts[("big", "the")] == 9000
    test = spark.createDataFrame([(1, "hot the"), (2, "w3 w3"), (3, "")], "Id long, text string")
    pred = {r["Id"]: r["predicted"] for r in m.score_intent_model(test, model, "Id", "text").collect()}
    assert pred[1] == "big" and pred[2] == "l3" and pred[3] == "big"

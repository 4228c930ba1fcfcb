"""MOD-1, MOD-7 and RPT-1..5."""

import hashlib
import zlib

import pytest
import os
from pyspark.sql import functions as F

from intentspark.operators import report, scoring
from intentspark.plans.inputs import GENERATION_FIXTURE, FixtureGeneratorFactory


def _turns(spark, n=60):
    return spark.createDataFrame([(i, f"sentence {i}") for i in range(n)], "Id long, Sentence string")


def test_generate_passes_prompt_and_keeps_rows(spark):
    out = scoring.predict(_turns(spark), FixtureGeneratorFactory("Id")).collect()
    assert len(out) == 60
    for r in out:
        assert r["generated"] == GENERATION_FIXTURE[r["Id"] % 26]


def test_failed_rows_are_null_others_unaffected(spark):
    df = _turns(spark).repartition(3)
    good = {r["Id"]: r["Category"] for r in scoring.predict(df, FixtureGeneratorFactory("Id")).collect()}
    out = scoring.predict(df, FixtureGeneratorFactory("Id", fail_on=25), on_error="null").collect()
    for r in out:
        if r["Id"] % 26 == 25:
            assert r["generated"] is None and r["Category"] is None and "generation failed" in r["error"]
        else:
            assert r["error"] is None and r["Category"] == good[r["Id"]]


def test_failure_raises_by_default(spark):
    with pytest.raises(Exception):
        scoring.predict(_turns(spark), FixtureGeneratorFactory("Id", fail_on=25)).collect()


def test_python_only_in_generation(spark):
    plan = scoring.predict(_turns(spark), FixtureGeneratorFactory("Id"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_reports(spark):
    df = spark.createDataFrame([(i, ["A", "B", "B", "C"][i % 4]) for i in range(20)], "Id long, Category string")
    counts = [(r["Category"], r["count"]) for r in report.category_counts(df).collect()]
    assert counts == [("B", 10), ("A", 5), ("C", 5)]
    prev = report.preview(report.submission(df.orderBy(F.desc("Id"))), 5)
    assert [r["Id"] for r in prev.collect()] == [0, 1, 2, 3, 4]
    assert "TakeOrderedAndProject" in prev._jdf.queryExecution().executedPlan().toString()
    out, obs = report.with_progress(df)
    out.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 20, "labelled": 20}


def test_distinct_prompts_hot_sentence(spark):
    from intentspark.plans.inputs import PromptFixtureGeneratorFactory
    rows = [(i, "the same request") for i in range(3000)] + [(3000 + i, f"other {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "Id long, Sentence string").repartition(6)
    a = {r["Id"]: (r["generated"], r["Category"]) for r in
         scoring.predict(df, PromptFixtureGeneratorFactory()).collect()}
    b = {r["Id"]: (r["generated"], r["Category"]) for r in
         scoring.predict(df, PromptFixtureGeneratorFactory(), dedupe=True).collect()}
    assert a == b and len(b) == 9000


def test_generator_batch_size_cap(spark):
    class SizeRecorder:
        """Generator factory reporting the size of each batch it is called with
        (defined locally so it is pickled by value for the workers)."""

        def __call__(self):
            return lambda batch: [str(len(batch))] * len(batch)

    df = spark.createDataFrame([(i, f"p{i}") for i in range(250)], "Id long, prompt string").coalesce(1)
    out = scoring.generate(df, SizeRecorder(), batch_size=40).collect()
    assert len(out) == 250 and max(int(r["generated"]) for r in out) <= 40


def test_max_new_tokens_reaches_generators_that_take_it(spark):
    class Factory:
        def __call__(self):
            def gen(batch, max_new_tokens=None):
                return [f"n={max_new_tokens}"] * len(batch)
            return gen

    df = spark.createDataFrame([(1, "p")], "Id long, prompt string")
    assert scoring.generate(df, Factory(), max_new_tokens=7).first()["generated"] == "n=7"


def test_wrong_output_length_is_a_batch_failure(spark):
    class Short:
        def __call__(self):
            return lambda batch: ["x"] * max(len(batch) - 1, 1) if len(batch) > 1 else ["x"]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "Id long, prompt string").coalesce(1)
    with pytest.raises(Exception, match="generator returned"):
        scoring.generate(df, Short()).collect()
    out = scoring.generate(df, Short(), on_error="null").collect()
    assert [r["generated"] for r in out] == ["x"] * 5   # retried row by row


def counting(log, fail=None):
    """A factory that gives the prompt's length and notes every prompt in a file; may fail on one."""
    def factory():
        def generator(batch):
            if fail in set(batch["prompt"]):
                raise RuntimeError("no")
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in batch["prompt"])
            return [f"{len(p)}" for p in batch["prompt"]]
        return generator
    return factory


def test_only_new_prompts_are_generated(spark, tmp_dir):
    log, store = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "store")
    df = lambda ps: spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "Id long, prompt string").repartition(3)

    def run(prompts, **options):
        open(log, "w").close()
        out = scoring.generate_resumable(df(prompts), counting(log, options.pop("fail", None)), store, steps=4, **options).collect()
        assert len(out) == len(prompts)
        return {r["prompt"]: r["generated"] for r in out}, sorted(open(log).read().split())

    got, asked = run(["a", "bb", "bb", None, "ccc"])
    assert got == {"a": "1", "bb": "2", "ccc": "3", None: None} and asked == ["a", "bb", "ccc"]
    got, asked = run(["a", "bb", "dddd"])
    assert got == {"a": "1", "bb": "2", "dddd": "4"} and asked == ["dddd"]
    assert run(["a", "bb"])[1] == []
    # a failing prompt stops a run; what other parts had finished stays
    with pytest.raises(Exception):
        run([*(f"p{i:02d}" for i in range(40)), "bad"], fail="bad")
    part = lambda p: zlib.crc32(hashlib.sha256(p.encode()).hexdigest().encode()) % 4
    got, asked = run([f"p{i:02d}" for i in range(40)])
    assert set(got.values()) == {"3"}
    assert asked == [p for p in sorted(got) if part(p) >= part("bad")]
    # or it is left out, and tried again later
    got, asked = run(["bad", "new"], fail="bad", on_error="null")
    assert got == {"bad": None, "new": "3"}
    assert run(["bad", "new"])[1] == ["bad"]

"""End-to-end jobs over CSV inputs."""

import glob
import json
import os

from intentspark import domain
from intentspark.plans import jobs
from intentspark.plans.inputs import FixtureGeneratorFactory, PromptFixtureGeneratorFactory

WORDS = {
    "PlayMusic": "play song album track music",
    "RateBook": "rate book stars novel points",
    "GetWeather": "weather forecast rain sunny cold",
}


def _labelled_csv(tmp_dir, n=90):
    lines = ["Id,Sentence,Category"]
    cats = list(WORDS)
    for i in range(n):
        c = cats[i % 3]
        w = WORDS[c].split()
        lines.append(f"{i},{w[i % 5]} {w[(i + 2) % 5]} please,{c}")
    p = os.path.join(tmp_dir, "train.csv")
    open(p, "w").write("\n".join(lines) + "\n")
    return p


def test_fit_then_score_with_model(spark, tmp_dir):
    train = _labelled_csv(tmp_dir)
    out = jobs.fit_csv(spark, train, f"{tmp_dir}/model")
    assert out["sizes"] == {"train": 81, "eval": 9}
    assert out["metrics"][0].startswith("accuracy: ")
    test = os.path.join(tmp_dir, "test.csv")
    open(test, "w").write("Id,Sentence\n3,play a song\n1,will it rain\n2,rate this novel\n")
    res = jobs.score_csv(spark, test, f"{tmp_dir}/out", model_dir=f"{tmp_dir}/model")
    assert [r["Id"] for r in res["preview"]] == [1, 2, 3]
    pred = {r["Id"]: r["Category"] for r in res["preview"]}
    assert pred == {1: "GetWeather", 2: "RateBook", 3: "PlayMusic"}
    sub = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_dir}/out/submission/part-*.csv")))
    assert sub.splitlines()[0] == "Id,Category" and len(sub.splitlines()) == 4


def test_score_with_generator(spark, tmp_dir):
    test = os.path.join(tmp_dir, "test.csv")
    open(test, "w").write("Id,Sentence\n" + "".join(f"{i},s {i}\n" for i in range(52)))
    res = jobs.score_csv(spark, test, f"{tmp_dir}/out", factory=FixtureGeneratorFactory("Id"))
    assert res["rows"] == 52
    assert sum(r["count"] for r in res["counts"]) == 52
    assert {r["Category"] for r in res["counts"]} <= set(domain.CATEGORIES)


def test_csv_table_round_trip(spark, tmp_dir):
    train = _labelled_csv(tmp_dir, 12)
    assert jobs.csv_to_table(spark, train, "intents_job_test", f"{tmp_dir}/tbl") == 12
    jobs.table_to_csv(spark, "intents_job_test", f"{tmp_dir}/csv")
    from intentspark.sources.csv import read_sentences
    back = sorted(tuple(r) for r in read_sentences(spark, f"{tmp_dir}/csv").collect())
    orig = sorted(tuple(r) for r in read_sentences(spark, train).collect())
    assert back == orig


def make_factory():
    return FixtureGeneratorFactory("Id", fail_on=5)


def test_score_options_on_the_command_line(spark, tmp_dir, monkeypatch, capsys):
    test = os.path.join(tmp_dir, "test.csv")
    open(test, "w").write("Id,Sentence\n" + "".join(f"{i},s {i}\n" for i in range(52)))
    monkeypatch.setattr("intentspark.session.build_session", lambda: spark)
    args = ["score", "--input", test, "--output", f"{tmp_dir}/out", "--generator", "test_jobs:make_factory", "--single-line"]
    jobs.main([*args, "--on-error", "null"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 52
    assert spark.read.parquet(f"{tmp_dir}/out/predictions").filter("Category is null").count() == 2
    monkeypatch.setattr("test_jobs.make_factory", PromptFixtureGeneratorFactory)
    jobs.main([*args, "--dedupe"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 52


def test_serve_on_the_command_line(spark, tmp_dir, monkeypatch, capsys):
    monkeypatch.setattr("intentspark.session.build_session", lambda: spark)
    monkeypatch.setattr("test_jobs.make_factory", PromptFixtureGeneratorFactory)
    requests = f"{tmp_dir}/requests"
    args = ["serve", *(x for n in ("requests", "responses", "rejects", "checkpoint", "ledger") for x in (f"--{n}", f"{tmp_dir}/{n}")),
            "--generator", "test_jobs:make_factory", "--max-files", "1"]
    for i, total in ((0, 3), (1, 6)):
        spark.createDataFrame([(f'{{"sentence": "s{i}"}}',), ("{",), ('{"sentence": 1}',)], "value string") \
            .coalesce(1).write.mode("append").text(requests)
        jobs.main(args)
        got = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert got == {"answered": i + 1, "rejected": 2 * i + 2, "rows": total}

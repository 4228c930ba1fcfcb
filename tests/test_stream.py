"""SRC-6, SNK-4, MOD-6 (stream = batch), HYG-1..2."""

import os

import pytest
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.plans.inputs import GENERATION_FIXTURE, FixtureGeneratorFactory
from intentspark.streaming import hygiene, serving
from intentspark.streaming import requests as streams
from test_resolve import py_resolve_api


def test_request_contract(spark):
    bodies = ['{"sentence": "play jazz"}', '{"sentence": 5}', '{"text": "x"}', "not json",
              '{"sentence": null}', '{"sentence": "x", "extra": 1}', '["sentence"]', None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, value string")
    out = {r["i"]: (r["valid"], r["sentence"]) for r in streams.read_requests(df).collect()}
    assert out[0] == (True, "play jazz")
    assert out[5] == (True, "x")
    for i in (1, 2, 3, 4, 6, 7):
        assert out[i] == (False, None), i
    assert streams.rejected(streams.read_requests(df)).count() == 6


def test_response_round_trip(spark):
    df = spark.createDataFrame([("PlayMusic",), ("Unknown",)], "Category string")
    out = streams.read_response(streams.to_response(df)).collect()
    assert [r["response"] for r in out] == ['{"category":"PlayMusic"}', '{"category":"Unknown"}']
    assert [r["category"] for r in out] == ["PlayMusic", "Unknown"]


def test_stream_equals_batch(spark, tmp_dir):
    rows = [(i, f'{{"Id": {i}, "sentence": "s{i}"}}') for i in range(60)] + [(99, '{"Id": 99}')]
    batch_in = spark.createDataFrame(rows, "Id long, value string")
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    batch_in.select("value").repartition(3).write.text(src)
    reqs = (spark.readStream.format("text").load(src)
            .withColumn("Id", F.get_json_object("value", "$.Id").cast("long")))
    resp = streams.stream_predict(reqs, FixtureGeneratorFactory("Id"), keep=("Id",))
    q = resp.writeStream.format("parquet").option("checkpointLocation", ck) \
        .trigger(availableNow=True).start(out)
    q.awaitTermination()
    streamed = {r["Id"]: r["response"] for r in spark.read.parquet(out).collect()}
    batched = {r["Id"]: r["response"] for r in
               streams.stream_predict(batch_in, FixtureGeneratorFactory("Id"), keep=("Id",)).collect()}
    assert streamed == batched and len(streamed) == 60 and 99 not in streamed


def test_hygiene_fixture(spark):
    texts = [" a ", "", "\t", "EXIT", "b"]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(texts)], "s long, turn long, text string")
    kept = hygiene.clean_requests(hygiene.until_exit(df, session="s", order="turn"))
    assert [r["request"] for r in kept.collect()] == ["a"]
    # no exit in a session keeps all non-blank inputs
    df2 = spark.createDataFrame([(2, 0, "x"), (2, 1, " "), (2, 2, "exits")], "s long, turn long, text string")
    assert sorted(r["request"] for r in hygiene.clean_requests(hygiene.until_exit(df2, "s", "turn")).collect()) \
        == ["exits", "x"]


def test_until_exit_shuffle_path(spark):
    df = spark.createDataFrame([(s, t, "exit" if t == s % 4 else f"m{t}") for s in range(30) for t in range(5)],
                               "s long, turn long, text string")
    a = sorted(tuple(r) for r in hygiene.until_exit(df, "s", "turn").collect())
    spark.conf.set("spark.intentspark.broadcastBytes", "0")
    try:
        b = sorted(tuple(r) for r in hygiene.until_exit(df, "s", "turn").collect())
    finally:
        spark.conf.unset("spark.intentspark.broadcastBytes")
    assert a == b and all(r[1] < r[0] % 4 for r in a)


BODIES = ['{"Id": %d, "sentence": "s%d"}', '{"Id": %d, "sentence": %d}', '{"Id": %d, "note": "%d"}', '{"Id": %d, broken %d',
          '["Id", %d, %d]', "not json %d %d"]


def add_requests(spark, src, ids, files=1):
    rows = [(BODIES[i % 9 if i % 9 < len(BODIES) else 0] % (i, i),) for i in ids]
    spark.createDataFrame(rows, "value string").repartition(files).write.mode("append").text(src)


def request_stream(spark, src, **options):
    return serving.request_files(spark, src, **options).withColumn("Id", F.regexp_extract("value", r"(\d+)", 1).cast("long"))


def served(spark, out, rejected):
    """{Id: category} of the answers and {Id: reason} of the rejects, each exactly once."""
    good = streams.read_response(spark.read.parquet(out)).collect()
    bad = spark.read.parquet(rejected).collect()
    ids = [r["Id"] for r in good + bad]
    assert len(ids) == len(set(ids))
    return {r["Id"]: r["category"] for r in good}, {r["Id"]: r["reason"] for r in bad}


def expected(ids, fail_on):
    good, bad = {}, {}
    for i in ids:
        kind = i % 9 if i % 9 < len(BODIES) else 0
        if kind:
            bad[i] = serving.NO_SENTENCE if kind in (1, 2, 4) else serving.NOT_JSON
        elif i % 26 == fail_on:
            bad[i] = f"{serving.FAILED}: RuntimeError: generation failed"
        else:
            good[i] = py_resolve_api(strip_special_py(GENERATION_FIXTURE[i % 26]))
    return good, bad


def strip_special_py(text):
    for t, _, special, _ in domain.SPECIAL_TOKENS:
        text = text.replace(t, "") if special else text
    return text


def test_every_request_is_answered_or_rejected_over_restarts(spark, tmp_dir):
    src, out, rejected, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "rejected", "ck"))
    factory = FixtureGeneratorFactory("Id", fail_on=5)

    def run():
        q = serving.serve_requests(request_stream(spark, src, max_files=2), factory, out, rejected, ck, keep=("Id",))
        q.awaitTermination()
        return q

    add_requests(spark, src, range(0, 400), files=5)
    first = run()
    g, e = served(spark, out, rejected), expected(range(400), 5)
    assert [(k, a.get(k), b.get(k)) for a, b in zip(g, e) for k in {*a, *b} if a.get(k) != b.get(k)][:8] == []
    assert len(first.recentProgress) == 3  # bounded: 5 files, two a batch
    add_requests(spark, src, range(400, 500))
    run()  # a restart: only the new file
    assert served(spark, out, rejected) == expected(range(500), 5)
    totals = serving.request_totals(spark, out, rejected).orderBy("batch").collect()
    assert [r["batch"] for r in totals] == [0, 1, 2, 3]
    assert sum(r["answered"] + r["rejected"] for r in totals) == 500


def test_a_crash_between_the_sinks_is_made_good(spark, tmp_dir, monkeypatch):
    src, out, rejected, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "rejected", "ck"))
    factory = FixtureGeneratorFactory("Id", fail_on=5)
    add_requests(spark, src, range(0, 200), files=4)
    make, crashes = serving._batch_writer, []

    def crashing(factory, responses, rejects, *rest):
        def write(batch, batch_id):
            if batch_id == 1 and not crashes:
                crashes.append(batch_id)
                make(factory, responses, f"{rejects}-lost", *rest)(batch, batch_id)  # the answers only
                raise RuntimeError("lost")
            make(factory, responses, rejects, *rest)(batch, batch_id)
        return write

    monkeypatch.setattr(serving, "_batch_writer", crashing)

    def run():
        serving.serve_requests(request_stream(spark, src, max_files=2), factory, out, rejected, ck, keep=("Id",)).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert served(spark, out, rejected) == expected(range(200), 5)


def test_ledger_counts_all_batches_over_a_restart(spark, tmp_dir):
    src, out, ck, log = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck", "log"))
    ledger = serving.ProgressLedger(spark, log)
    spark.streams.addListener(ledger)
    try:
        for files, upto in ((150, 600), (3, 630)):
            done = spark.read.text(src).count() if os.path.exists(src) else 0
            spark.range(done, upto).selectExpr("cast(id as string) value").repartition(files).write.mode("append").text(src)
            q = (serving.request_files(spark, src, max_files=1).writeStream.format("parquet")
                 .option("checkpointLocation", ck).trigger(availableNow=True).start(out))
            q.awaitTermination()
            ledger.wait(q)
    finally:
        spark.streams.removeListener(ledger)
    assert len(q.recentProgress) < 150  # what Spark itself still knows
    got = serving.stream_progress(spark, log).collect()
    assert [(r["batches"], r["rows"], r["runs"]) for r in got] == [(153, 630, 2)]
    assert spark.read.parquet(out).count() == 630


def test_restart_from_checkpoint_processes_only_new_files(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))

    def add(ids):
        rows = [(f'{{"Id": {i}, "sentence": "s{i}"}}',) for i in ids]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(src)

    def run():
        reqs = (spark.readStream.format("text").load(src)
                .withColumn("Id", F.get_json_object("value", "$.Id").cast("long")))
        resp = streams.stream_predict(reqs, FixtureGeneratorFactory("Id"), keep=("Id",))
        q = resp.writeStream.format("parquet").option("checkpointLocation", ck) \
            .trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    add(range(0, 40))
    assert run() == 40
    add(range(40, 55))
    assert run() == 15          # only the new file
    ids = [r["Id"] for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(55))   # exactly once


def test_sessions_end_over_micro_batches_and_restarts(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    rows = [(s, t, " Exit " if t == s and s < 6 else f"m{t}") for s in range(9) for t in range(8)] + [(0, 3, "EXIT"), (8, 9, "exits")]
    df = spark.createDataFrame(rows, "s long, turn long, text string")
    for wave in range(4):  # two turns arrive at a time, each time to a new run
        df.filter(f"turn div 2 = {wave} or turn = 9 and {wave} = 3").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        hygiene.until_exit_stream(stream, "s", "turn").writeStream.format("parquet").option("checkpointLocation", ck) \
            .trigger(availableNow=True).start(out).awaitTermination()
    want = sorted(map(tuple, hygiene.until_exit(df, "s", "turn").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_an_idle_session_is_forgotten(spark, tmp_dir):
    import time
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))
    schema = "s long, turn long, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def wait_for(n):
        end = time.monotonic() + 60
        while time.monotonic() < end:
            if os.path.exists(f"{out}/_spark_metadata") and spark.read.schema(schema).parquet(out).count() >= n:
                return
            time.sleep(0.5)
        raise TimeoutError

    arrive([(1, 0, "a"), (1, 1, "exit")])
    stream = hygiene.until_exit_stream(spark.readStream.schema(schema).parquet(src), "s", "turn", idle="2 seconds")
    q = stream.writeStream.format("parquet").option("checkpointLocation", ck).trigger(processingTime="1 second").start(out)
    try:
        wait_for(1)
        time.sleep(6)
        arrive([(1, 5, "b")])  # a new session of the same name
        wait_for(2)
    finally:
        q.stop()
    assert sorted(r["turn"] for r in spark.read.parquet(out).collect()) == [0, 5]

"""SPL-1, SPL-2: exact size, determinism, brute-force order."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from intentspark.operators import split as split_op


def brute_eval(keys, seed=42, frac=0.1):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return set(order[:math.ceil(frac * len(keys))])


@pytest.mark.parametrize("n,k", [(1, 1), (9, 1), (10, 1), (11, 2), (350, 35), (1000, 100)])
def test_exact_sizes_and_rows(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "Id")
    flagged = split_op.with_split(df, "Id")
    ev = {r["Id"] for r in flagged.filter(F.col("split") == "eval").collect()}
    assert len(ev) == k
    assert ev == brute_eval(list(range(n)))
    sizes = {r["split"]: r["n"] for r in split_op.split_sizes(flagged).collect()}
    assert sizes.get("eval") == k and sizes.get("train", 0) == n - k


def test_same_rows_under_any_partitioning(spark):
    base = spark.range(1000).withColumnRenamed("id", "Id")
    sets = []
    for p in (1, 3, 7):
        tr, ev = split_op.train_eval_split(base.repartition(p), "Id")
        e = {r["Id"] for r in ev.collect()}
        t = {r["Id"] for r in tr.collect()}
        assert not (e & t) and len(e | t) == 1000
        sets.append(e)
    assert sets[0] == sets[1] == sets[2]


def test_refinement_rounds_match_brute_force(spark, monkeypatch):
    # force the radix select to refine through several prefix rounds
    monkeypatch.setattr(split_op, "SMALL_BUCKET", 0)
    df = spark.range(5000).withColumnRenamed("id", "Id")
    ev = {r["Id"] for r in split_op.with_split(df, "Id").filter(F.col("split") == "eval").collect()}
    assert ev == brute_eval(list(range(5000)))


def test_string_keys_and_empty(spark):
    keys = [f"k{i}" for i in range(57)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    ev = {r["key"] for r in split_op.with_split(df, "key").filter(F.col("split") == "eval").collect()}
    assert ev == brute_eval(keys)
    empty = spark.createDataFrame([], "key string")
    assert split_op.with_split(empty, "key").count() == 0


def sizes(df, fraction, key="Id"):
    flagged = split_op.with_split(df, key, fraction=fraction)
    got = {r["split"]: r["n"] for r in split_op.split_sizes(flagged).collect()}
    return flagged, got.get("eval", 0), got.get("train", 0)


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_hot_key_straddling_the_cut_splits_exactly(spark, fraction):
    # a third of the rows share a key and differ otherwise
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("Id"),
                                 F.col("id").alias("other"))
    flagged, n_eval, n_train = sizes(df, fraction)
    assert n_eval == math.ceil(fraction * 900) and n_eval + n_train == 900
    again = split_op.with_split(df.repartition(5), "Id", fraction=fraction)
    assert sorted(map(tuple, flagged.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_wholly_equal_rows_are_counted_exactly(spark, monkeypatch, step):
    monkeypatch.setattr(split_op, "COPY_STEP", step)
    df = spark.range(100).select(F.lit(5).cast("long").alias("Id"), F.lit(None).cast("string").alias("text"))
    flagged, n_eval, n_train = sizes(df, 0.1)
    assert (n_eval, n_train) == (10, 90)
    assert flagged.schema.simpleString() == "struct<Id:bigint,text:string,split:string>"
    assert {(r["Id"], r["text"]) for r in flagged.collect()} == {(5, None)}


def test_null_keys_come_first_and_count(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("Id"), F.col("id").alias("other"))
    flagged, n_eval, n_train = sizes(df, 0.1)
    assert (n_eval, n_train) == (10, 90)
    assert all(r["Id"] is None for r in flagged.filter("split = 'eval'").collect())


def test_repeated_keys_split_exactly(spark):
    df = spark.range(140).select((F.col("id") % 20).alias("Id"), F.col("id").alias("other"))
    _, n_eval, n_train = sizes(df, 0.1)
    assert (n_eval, n_train) == (14, 126)
    _, n_eval, n_train = sizes(df, 0.07)
    assert (n_eval, n_train) == (10, 130)

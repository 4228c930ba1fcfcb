"""ENC-1..ENC-9 and the distributed row index."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.functions.text import strip_special, tokenize
from intentspark.operators import batches as bt
from intentspark.operators import encode as enc
from intentspark.operators import indexing
from intentspark.operators.indexing import with_row_index

L = domain.MAX_LENGTH


def _texts(spark, rows):
    return spark.createDataFrame(rows, "Id long, text string")


def test_tokenize_whitespace_and_specials(spark):
    df = spark.createDataFrame([("a　b  c\n\nd",), ("x<|end|>y</s>z",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(tokenize("t")).collect()]
    assert out[0] == "a　b  c\n\nd".split()
    assert out[1] == ["x", "<|end|>", "y", "</s>", "z"]
    assert out[2] == [] and out[3] == []


def test_row_index_matches_sorted_order(spark):
    df = spark.createDataFrame([(f"w{i % 37}", i % 11) for i in range(500)], "token string, n long") \
        .repartition(5)
    out = with_row_index(df, [F.desc("n"), F.asc("token")], out="ix").collect()
    rows = sorted(((r["n"], r["token"], r["ix"]) for r in out), key=lambda x: x[2])
    assert [r[2] for r in rows] == list(range(500))
    keys = [(-r[0], r[1]) for r in rows]
    assert keys == sorted(keys)


def test_vocab_ranking_brute_force(spark):
    texts = ["b a a", "c b a <|end|>", "d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    v = {r["token"]: (r["id"], r["n"]) for r in enc.build_vocab(df, "text").collect()}
    cnt = Counter(t for s in texts for t in s.split() if t != "<|end|>")
    ranked = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))
    for i, (tok, n) in enumerate(ranked):
        assert v[tok] == (domain.FIRST_WORD_ID + i, n)
    for tok, tid, _, _ in domain.SPECIAL_TOKENS:
        assert v[tok] == (tid, None)


@pytest.mark.parametrize("n_tok", [0, 1, 255, 256, 257])
def test_lengths_padding_and_mask(spark, n_tok):
    text = " ".join(f"w{i}" for i in range(n_tok))
    df = _texts(spark, [(1, text)])
    vocab = enc.build_vocab(df, "text")
    r = enc.encode(df, vocab, "Id", "text").first()
    ids, mask = r["input_ids"], r["attention_mask"]
    real = min(n_tok, L)
    assert len(ids) == L and len(mask) == L
    assert mask == [0] * (L - real) + [1] * real
    assert ids[:L - real] == [domain.PAD_ID] * (L - real)
    assert all(i >= domain.FIRST_WORD_ID for i in ids[L - real:])


def test_unknown_and_pad_text(spark):
    train = _texts(spark, [(1, "known words")])
    vocab = enc.build_vocab(train, "text")
    df = _texts(spark, [(2, "known mystery <|endoftext|>")])
    r = enc.encode(df, vocab, "Id", "text").first()
    tail = r["input_ids"][-3:]
    assert tail[1] == domain.UNK_ID and tail[2] == domain.PAD_ID
    # the mask follows the real length, not the pad id
    assert r["attention_mask"][-3:] == [1, 1, 1]
    col = enc.collate_causal(enc.encode(df, vocab, "Id", "text")).first()["labels"]
    assert col[-1] == domain.IGNORE_INDEX and col[-3] == tail[0]
    assert col[:L - 3] == [domain.IGNORE_INDEX] * (L - 3)


def test_training_labels_hide_prompt_and_padding(spark):
    df = spark.createDataFrame([(1, "p q r T1 T2", "p q r ")], "Id long, text string, prompt string")
    vocab = enc.build_vocab(df, "text")
    r = enc.encode_training(df, vocab, "Id", "text", "prompt").first()
    ids, labels = r["input_ids"], r["labels"]
    assert labels[:L - 2] == [domain.IGNORE_INDEX] * (L - 2)
    assert labels[L - 2:] == ids[L - 2:]


def test_strip_special_keeps_unflagged(spark):
    text = "".join(t for t, _, _, _ in domain.SPECIAL_TOKENS) + "end"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip_special("t")).first()[0] == "</s>end"


def test_truncation_report(spark):
    df = spark.createDataFrame([("a", " ".join(["x"] * 300)), ("a", "y"), ("b", "")], "g string, t string")
    out = {r["g"]: (r["rows"], r["truncated"], r["max_tokens"]) for r in enc.truncation_report(df, "g", "t").collect()}
    assert out == {"a": (2, 1, 300), "b": (1, 0, 0)}


def test_shuffle_vocab_join_path_is_identical(spark):
    df = _texts(spark, [(i, f"w{i % 7} shared w{i % 3} x{i}") for i in range(40)])
    vocab = enc.build_vocab(df, "text")
    small = {r["Id"]: r["input_ids"] for r in enc.encode(df, vocab, "Id", "text").collect()}
    spark.conf.set("spark.intentspark.broadcastBytes", "0")
    try:
        big = {r["Id"]: r["input_ids"] for r in enc.encode(df, vocab, "Id", "text").collect()}
    finally:
        spark.conf.unset("spark.intentspark.broadcastBytes")
    assert small == big


@pytest.mark.parametrize("budget", [None, "0"])
def test_repeated_keys_keep_their_rows(spark, budget):
    long = " ".join(["a"] * 200)
    rows = [(1, "a b"), (1, "b"), (1, "b"), (2, "a"), (None, "b"), (3, long), (3, long + " b"), (4, None), (4, "")]
    df = _texts(spark, rows).repartition(3)
    vocab = enc.build_vocab(df, "text")
    word = {r["token"]: r["id"] for r in vocab.collect()}
    if budget is not None:
        spark.conf.set("spark.intentspark.broadcastBytes", budget)
    try:
        got = enc.encode(df, vocab, "Id", "text").collect()
    finally:
        spark.conf.unset("spark.intentspark.broadcastBytes")
    want = Counter()
    for key, text in rows:
        ids = [word[t] for t in (text or "").split()][:L]
        want[(key, (domain.PAD_ID,) * (L - len(ids)) + tuple(ids))] += 1
    assert Counter((r["Id"], tuple(r["input_ids"])) for r in got) == want


def test_large_vocabulary_has_its_frequent_words_broadcast(spark):
    rows = [(i, "the the of " + " ".join(f"w{(i * 7 + k) % 300}" for k in range(i % 9))) for i in range(200)] + [(None, None), (7, "the")]
    df = spark.createDataFrame(rows, "Id long, text string").repartition(3)
    v = enc.build_vocab(df, "text")
    want = sorted(map(str, enc.token_ids(df, v, "Id", "text").collect()))
    for budget in ("2000", "0"):
        spark.conf.set("spark.intentspark.broadcastBytes", budget)
        try:
            got = enc.token_ids(df, v, "Id", "text")
            assert ("_asked" in got._jdf.queryExecution().analyzed().toString()) == (budget != "0")
            assert sorted(map(str, got.collect())) == want
        finally:
            spark.conf.unset("spark.intentspark.broadcastBytes")


def test_copies_are_made_in_blocks_by_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 7)], "k string, _times long")
    monkeypatch.setattr(indexing, "COPY_STEP", 10)
    for spread in (None, ["k"]):
        out = indexing.repeated(df, spread).withColumn("p", F.spark_partition_id())
        assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 1, "b": 1000, "c": 7}
    assert out.filter("k = 'b'").select("p").distinct().count() > 3
    monkeypatch.undo()
    many = indexing.repeated(spark.createDataFrame([("a", 3_000_000_000)], "k string, _times long"))
    assert many.limit(5).count() == 5  # three billion are not made at once


def test_equal_rows_are_encoded_where_they_are(spark):
    df = spark.createDataFrame([(1, "a b")] * 400 + [(2, "b")], "Id long, text string").repartition(6)
    merged = indexing.distinct_rows(df.withColumn("t", F.col("text")), ["Id"], "t")
    assert merged.filter("Id = 1").count() == 6 and merged.agg(F.sum("_times")).first()[0] == 401
    v = enc.build_vocab(df, "text")
    assert enc.token_ids(df, v, "Id", "text").count() == 401


def test_epoch_batches(spark):
    rows = [(i if i % 5 else None, list(range(100, 100 + (i * 7) % 60))) for i in range(230)] + [(1, [9, 9])] * 40
    df = spark.createDataFrame(rows, "Id long, ids array<int>")
    seen = {}
    for epoch in (0, 1):
        out = [bt.epoch_batches(df.repartition(n), "Id", batch_size=8, epoch=epoch).collect() for n in (1, 5)]
        assert Counter(map(str, out[0])) == Counter(map(str, out[1]))  # any partitioning
        by = {}
        for r in out[0]:
            by.setdefault(r["batch"], []).append(r)
            pad = r["longest"] - r["n_tokens"]
            assert r["input_ids"][:pad] == [domain.PAD_ID] * pad and len(r["input_ids"]) == r["longest"] == len(r["attention_mask"])
            assert sum(r["attention_mask"]) == r["n_tokens"]
        assert sorted(by) == list(range(len(by)))
        for batch in by.values():
            assert sorted(r["place"] for r in batch) == list(range(len(batch))) and len(batch) <= 8
            assert max(r["n_tokens"] for r in batch) == batch[0]["longest"]
            assert len({r["n_tokens"] // bt.WIDTH for r in batch}) == 1
        back = Counter((r["Id"], tuple(r["input_ids"][r["longest"] - r["n_tokens"]:])) for r in out[0])
        assert back == Counter((i, tuple(x)) for i, x in rows)  # every row once
        seen[epoch] = [sorted(map(str, ((r["Id"], r["n_tokens"]) for r in by[b]))) for b in sorted(by)]
    assert seen[0] != seen[1]
    report = bt.padding_report(bt.epoch_batches(df, "Id", batch_size=8)).first()
    assert report["rows"] == 270 and 0 < report["share"] < report["fixed_share"] < 1
    assert bt.epoch_batches(df.limit(0), "Id").count() == 0

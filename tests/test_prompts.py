"""PRJ-2..PRJ-8."""

import pytest
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.operators import prompts

HEAD = ("<|user|>\nClassify the following sentence into exactly one of these categories: "
        "PlayMusic, RateBook, SearchCreativeWork, GetWeather, BookRestaurant, AddToPlaylist, "
        "SearchScreeningEvent. You must respond with only the category name, nothing else.\n\n"
        "Sentence: ")
TAIL = "\n\nCategory: "


def test_prompt_text_exact(spark):
    rows = [(1, "play some jazz"), (2, "a {} b {sentence}"), (3, "two\nlines"), (4, None)]
    df = spark.createDataFrame(rows, "Id long, Sentence string")
    out = {r["Id"]: r["prompt"] for r in prompts.with_prompt(df).collect()}
    assert out[1] == HEAD + "play some jazz" + TAIL
    assert out[2] == HEAD + "a {} b {sentence}" + TAIL
    assert out[3] == HEAD + "two\nlines" + TAIL
    assert out[4] == HEAD + "None" + TAIL


def test_training_text_and_null_label(spark):
    df = spark.createDataFrame([(1, "x", "RateBook")], "Id long, Sentence string, Category string")
    assert prompts.with_training_text(df).first()["text"] == HEAD + "x" + TAIL + "RateBook"
    bad = spark.createDataFrame([(1, "x", "RateBook"), (2, "y", None)],
                                "Id long, Sentence string, Category string")
    with pytest.raises(ValueError, match="1 row"):
        prompts.with_training_text(bad)


def test_label_ids_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in domain.CATEGORIES] + [("Nope",)], "Category string")
    out = prompts.with_label(prompts.with_label_id(df), out="back").collect()
    for r in out:
        if r["Category"] == "Nope":
            assert r["label_id"] is None and r["back"] is None
        else:
            assert domain.CATEGORIES[r["label_id"]] == r["Category"] == r["back"]


def test_categories_string_from_table(spark):
    shuffled = domain.label_table(spark).orderBy(F.desc("category"))
    assert prompts.categories_string(shuffled).first()[0] == domain.CATEGORIES_STRING


def test_render_chat_order_roles_tail(spark):
    rows = [(1, 2, "assistant", "A"), (1, 0, "system", "S"), (1, 1, "user", "U"),
            (1, 3, "tool", "T"), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    gen = {r["conv_id"]: r["text"] for r in prompts.render_chat(df, add_generation_prompt=True).collect()}
    assert gen[1] == "<|system|>\nS<|end|>\n<|user|>\nU<|end|>\n<|assistant|>\nA<|end|>\n<|assistant|>\n"
    assert gen[2] == "<|user|>\nonly<|end|>\n<|assistant|>\n"
    done = {r["conv_id"]: r["text"] for r in prompts.render_chat(df, add_generation_prompt=False).collect()}
    assert done[2] == "<|user|>\nonly<|end|>\n<|endoftext|>"


def test_render_chat_long_conversation_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(prompts, "CHAT_BLOCK", 3)
    rows = [(7, t, "user", str(t)) for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = prompts.render_chat(df).first()["text"]
    assert out == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(10)) + "<|assistant|>\n"

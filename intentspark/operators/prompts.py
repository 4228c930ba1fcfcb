"""Prompt building, label mapping and chat rendering (PRJ-2..PRJ-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentspark import domain


def _cats(categories=domain.CATEGORIES) -> Column:
    return F.array(*[F.lit(c) for c in categories])


def prompt_expr(sentence: str | Column, categories_string: str | Column | None = None) -> Column:
    """PRJ-5: the inference prompt around a sentence; a missing sentence is
    written as ``None``; the sentence is inserted verbatim."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    if categories_string is None:
        head = F.lit(domain.PROMPT_PREFIX)
    else:
        cs = F.lit(categories_string) if isinstance(categories_string, str) else categories_string
        before, after = domain.PROMPT_TEMPLATE.split("{sentence}")[0].split("{categories}")
        head = F.concat(F.lit(before), cs, F.lit(after))
    return F.concat(head, F.coalesce(s, F.lit(domain.NULL_SENTENCE)), F.lit(domain.PROMPT_SUFFIX))


def with_prompt(df: DataFrame, sentence: str = "Sentence", out: str = "prompt") -> DataFrame:
    return df.withColumn(out, prompt_expr(sentence))


def with_training_text(df: DataFrame, sentence: str = "Sentence", label: str = "Category",
                       out: str = "text", check: bool = True) -> DataFrame:
    """PRJ-6: prompt followed by the label, with no end marker.

    A missing label cannot be formatted: with ``check`` the rows are counted
    first (one job) and the call fails naming how many.
    """
    if check:
        n_null = df.filter(F.col(label).isNull()).count()
        if n_null:
            raise ValueError(f"{n_null} row(s) have no {label}; training text needs a label")
    return df.withColumn(out, F.concat(prompt_expr(sentence), F.col(label)))


def with_label_id(df: DataFrame, label: str = "Category", out: str = "label_id",
                  categories=domain.CATEGORIES) -> DataFrame:
    """PRJ-2: label -> 0-based ordinal (null for a label outside the list)."""
    pos = F.array_position(_cats(categories), F.col(label))
    return df.withColumn(out, F.when(pos > 0, (pos - 1).cast("int")))


def with_label(df: DataFrame, label_id: str = "label_id", out: str = "Category",
               categories=domain.CATEGORIES) -> DataFrame:
    """PRJ-3: ordinal -> label (null when out of range)."""
    return df.withColumn(out, F.try_element_at(_cats(categories), (F.col(label_id) + 1).cast("int")))


def categories_string(label_df: DataFrame, ord_col: str = "ord",
                      category: str = "category") -> DataFrame:
    """PRJ-4: one row holding the labels joined by ``", "`` in ``ord`` order
    (a global aggregate; the label table is a small dimension)."""
    return label_df.agg(F.array_join(
        F.array_sort(F.collect_list(F.struct(ord_col, category))).getField(category), ", ")
        .alias("categories"))


# -- chat rendering (PRJ-8) ---------------------------------------------------

# A group of turns is first rendered within blocks of this many turns, then
# the blocks are joined. A conversation holding a large share of all rows is
# thus rendered by many tasks; only the final join of block strings is per
# conversation.
CHAT_BLOCK = 1024


def _piece(role: Column, text: Column) -> Column:
    content = F.coalesce(text, F.lit(""))
    expr = None
    for r in domain.CHAT_ROLES:
        v = F.concat(F.lit(f"<|{r}|>\n"), content, F.lit(domain.CHAT_TURN_END))
        expr = F.when(role == r, v) if expr is None else expr.when(role == r, v)
    return expr.otherwise(F.lit(""))


def _ordered_join(order: str, value: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.struct(order, value))).getField(value), "")


def render_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text",
                add_generation_prompt: bool = True, out: str = "text") -> DataFrame:
    """PRJ-8: one string per conversation, turns in order.

    system / user / assistant turns render as ``<|role|>\\n`` + content +
    ``<|end|>\\n``; any other role adds nothing. The tail is
    ``<|assistant|>\\n`` when asking for a generation, else the end token.
    """
    tail = domain.CHAT_GENERATION_TAIL if add_generation_prompt else domain.EOS_TOKEN
    pieces = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
                       _piece(F.col(role), F.col(text)).alias("_piece"))
    blocks = (pieces.groupBy("_conv", F.floor(F.col("_turn") / CHAT_BLOCK).alias("_block"))
              .agg(_ordered_join("_turn", "_piece").alias("_part")))
    return (blocks.groupBy("_conv")
            .agg(F.concat(_ordered_join("_block", "_part"), F.lit(tail)).alias(out))
            .withColumnRenamed("_conv", conv))

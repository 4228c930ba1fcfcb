"""Request path as a stateless stream (SRC-6, SNK-4, MOD-6).

A request body is one JSON object with a string field ``sentence``; the
response is ``{"category": ...}``. The same functions work on batch and
streaming DataFrames; ``stream_predict`` chains them and the generator runs
in ``mapInPandas`` inside each micro-batch. No state is kept, so the query
runs in append mode and scales with the source's partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentspark.functions.text import strip_special
from intentspark.operators.prompts import prompt_expr
from intentspark.operators.resolve import resolve_api
from intentspark.operators.scoring import generate


def read_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """SRC-6: add ``sentence`` and ``valid``.

    A body is valid when it parses as JSON and ``$.sentence`` is a JSON
    string (a number, null, missing field or broken JSON is rejected; a plain
    ``from_json`` would turn a number into text)."""
    v = F.try_parse_json(F.col(value))
    sub = F.variant_get(v, "$.sentence", "variant")
    valid = F.coalesce(F.schema_of_variant(sub) == F.lit("STRING"), F.lit(False))
    return (df.withColumn("valid", valid)
            .withColumn("sentence", F.when(F.col("valid"), F.variant_get(v, "$.sentence", "string"))))


def rejected(df: DataFrame) -> DataFrame:
    """The side output of bodies that do not meet the request contract."""
    return df.filter(~F.col("valid"))


def to_response(df: DataFrame, category: str = "Category", out: str = "response") -> DataFrame:
    """SNK-4: ``{"category": ...}`` as JSON text."""
    return df.withColumn(out, F.to_json(F.struct(F.col(category).alias("category"))))


def read_response(df: DataFrame, value: str = "response", out: str = "category") -> DataFrame:
    """SNK-4 (client side): the ``category`` field, null when absent."""
    return df.withColumn(out, F.get_json_object(F.col(value), "$.category"))


def stream_predict(requests: DataFrame, factory, keep=(), value: str = "value") -> DataFrame:
    """MOD-6: request bodies -> validate -> prompt -> generate -> drop special
    tokens -> RES-6 -> response. Invalid bodies are dropped here (see
    :func:`rejected` for the side output) and a failing row stops the query;
    :mod:`intentspark.streaming.serving` answers or rejects every request.
    ``keep`` columns ride along."""
    ok = read_requests(requests, value).filter(F.col("valid"))
    prompted = ok.select(*keep, prompt_expr("sentence").alias("prompt"))
    gen = generate(prompted, factory).drop("prompt")
    gen = gen.withColumn("generated", strip_special("generated"))
    return to_response(resolve_api(gen)).select(*keep, "response")

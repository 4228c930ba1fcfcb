"""Distributed scoring through a pluggable text generator (MOD-1, MOD-7).

The generator is the only Python in the batch path. It runs inside
``mapInPandas`` on Arrow batches; the factory is called once per Python
worker process (cached by a fingerprint of the pickled factory), so a model
is loaded once per worker, not once per row or per task. Generation is
deterministic (greedy), so a retried task yields the same rows.

A generator is ``gen(batch: pandas.DataFrame) -> sequence of str | None``;
the batch holds the selected columns including ``prompt``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark import domain
from intentspark.functions.text import strip_special
from intentspark.operators.prompts import prompt_expr
from intentspark.operators.resolve import resolve, resolve_api
from intentspark.session import ship_package, stored

GeneratorFactory = Callable[[], Callable]

_WORKER_CACHE: dict[str, Callable] = {}


def _generator(fingerprint: str, factory: GeneratorFactory) -> Callable:
    gen = _WORKER_CACHE.get(fingerprint)
    if gen is None:
        gen = _WORKER_CACHE[fingerprint] = factory()
    return gen


#: A batch input that Catalyst estimates below this many bytes a core is spread over all cores.
SPREAD_BYTES = 32 << 20


def _spread(df: DataFrame) -> DataFrame:
    """Generation is the costly per-row step: a small batch input, which may have
    fewer partitions than the cluster has cores, is spread round-robin first.
    Catalyst's estimate decides; nothing is run for it."""
    if df.isStreaming:
        return df
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM context (remote session): leave it
        return df
    return df.repartition(par) if size < par * SPREAD_BYTES else df


def generate(df: DataFrame, factory: GeneratorFactory, prompt: str = "prompt",
             out: str = "generated", on_error: str = "raise",
             max_new_tokens: int = domain.MAX_NEW_TOKENS,
             max_length: int = domain.MAX_LENGTH,
             batch_size: int | None = None) -> DataFrame:
    """MOD-1: add ``generated`` text for each row's prompt.

    ``on_error='null'`` (MOD-7): a batch that raises is retried row by row;
    a row that still fails gets a null ``generated`` and its message in
    ``error``; other rows are unaffected. ``max_new_tokens`` and
    ``max_length`` (the prompt's limit in tokens) are passed to generators
    whose call accepts keywords of these names. ``batch_size``
    caps the rows handed to one generator call (e.g. to fit accelerator
    memory); Arrow batches are cut to it inside the task.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    fields = list(df.schema.fields) + [T.StructField(out, T.StringType(), True)]
    if on_error == "null":
        fields.append(T.StructField("error", T.StringType(), True))
    schema = T.StructType(fields)
    fingerprint = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    ship_package(df.sparkSession)
    df = _spread(df)
    catch = on_error == "null"

    def chunks(batches):
        for pdf in batches:
            if not batch_size or len(pdf) <= batch_size:
                yield pdf
            else:
                for start in range(0, len(pdf), batch_size):
                    yield pdf.iloc[start:start + batch_size].reset_index(drop=True)

    def run(batches):
        import inspect
        model = _generator(fingerprint, factory)
        try:
            takes = inspect.signature(model).parameters
        except (TypeError, ValueError):
            takes = {}
        limits = {k: v for k, v in (("max_new_tokens", max_new_tokens), ("max_length", max_length)) if k in takes}

        def gen(batch):
            return model(batch, **limits)

        for pdf in chunks(batches):
            pdf = pdf.rename(columns={prompt: "prompt"}) if prompt != "prompt" else pdf
            errors = [None] * len(pdf)
            try:
                texts = list(gen(pdf))
                if len(texts) != len(pdf):
                    raise ValueError(f"generator returned {len(texts)} texts for {len(pdf)} rows")
            except Exception:
                if not catch:
                    raise
                texts = []
                for i in range(len(pdf)):
                    try:
                        texts.append(list(gen(pdf.iloc[i:i + 1]))[0])
                    except Exception as e:  # MOD-7: this row only
                        texts.append(None)
                        errors[i] = f"{type(e).__name__}: {e}"
            if prompt != "prompt":
                pdf = pdf.rename(columns={"prompt": prompt})
            pdf[out] = [None if t is None else str(t) for t in texts]
            if catch:
                pdf["error"] = errors
            yield pdf

    return df.mapInPandas(run, schema)


#: Parts in which new prompts are generated and stored, one after the other.
STEPS = 8

_STORE = "prompt_hash string, generated string"


def generate_resumable(df: DataFrame, factory: GeneratorFactory, store: str, prompt: str = "prompt", out: str = "generated",
                       on_error: str = "raise", batch_size: int | None = None, steps: int = STEPS) -> DataFrame:
    """MOD-1 with a memory: ``df`` with ``out``, where only prompts that the table
    in the folder ``store`` doesn't have are generated.

    The table is (hash of the prompt, text); each call adds the texts of its new
    distinct prompts in ``steps`` parts, each committed for itself, so that a
    broken-off run goes on after its last finished part. A store belongs to one
    generator, which must see nothing but the prompt. With ``on_error='null'`` a
    failing prompt gets a null text and is not stored, so a later run tries it
    again. Rows without a prompt get a null text.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(store)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)

    def known() -> DataFrame:
        # the finished parts only: an unfinished one has no mark
        parts = [f"{store}/{s.getPath().getName()}" for s in fs.listStatus(folder)
                 if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return spark.read.schema(_STORE).parquet(*parts) if parts else spark.createDataFrame([], _STORE)

    digest = F.sha2(F.col(prompt), 256)
    asked = df.filter(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt"), digest.alias("prompt_hash")).distinct()
    fresh = stored(asked.join(known().select("prompt_hash"), "prompt_hash", "left_anti"), "new-prompts")
    failed = None
    for step in range(steps):
        part = fresh.filter(F.pmod(F.crc32(F.col("prompt_hash").cast("binary")), F.lit(steps)) == step)
        made = generate(part, factory, out="generated", on_error=on_error, batch_size=batch_size)
        if on_error == "null":
            made = stored(made, "generated")  # answers and errors of one call
            errors = made.filter(F.col("error").isNotNull()).select("prompt_hash", "error")
            failed = errors if failed is None else failed.unionByName(errors)
            made = made.filter(F.col("error").isNull())
        made.select("prompt_hash", "generated").write.parquet(f"{store}/part-{uuid.uuid4().hex[:12]}")
    hashed = df.withColumn("_ph", digest)
    texts = known().select(F.col("prompt_hash").alias("_ph"), F.col("generated").alias(out)).dropDuplicates(["_ph"])
    found = hashed.join(texts, "_ph", "left")
    if failed is not None:
        found = found.join(failed.withColumnRenamed("prompt_hash", "_ph"), "_ph", "left")
    return found.drop("_ph")


def predict(df: DataFrame, factory: GeneratorFactory, key: str = "Id",
            sentence: str = "Sentence", on_error: str = "raise",
            api: bool = False, dedupe: bool = False, store: str | None = None) -> DataFrame:
    """Batch path A: prompt -> generate -> drop special tokens -> clean ->
    resolve. Returns ``key, generated, [cleaned, resolved_by,] Category
    [, error]``; with ``on_error='null'`` a failed row has a null Category.
    ``api=True`` resolves with the request-path rule (RES-6) instead.

    ``dedupe=True`` runs the generator once per distinct prompt and joins the
    text back (valid because generation is deterministic and, in this mode,
    sees only the prompt). The distinct is combined map-side, so a sentence
    repeated on a large share of the rows costs one model call; the join
    back is a shuffle join on the prompt whose hot partition AQE splits.
    ``store`` names a folder that keeps texts by prompt over runs
    (:func:`generate_resumable`): only prompts it doesn't have are generated."""
    prompted = df.select(F.col(key), prompt_expr(sentence).alias("prompt"))
    if store:
        gen = generate_resumable(prompted, factory, store, on_error=on_error).drop("prompt")
    elif dedupe:
        distinct = prompted.select("prompt").distinct()
        texts = generate(distinct, factory, on_error=on_error)
        gen = prompted.join(texts, "prompt", "left").drop("prompt")
    else:
        gen = generate(prompted, factory, on_error=on_error).drop("prompt")
    gen = gen.withColumn("generated", strip_special("generated"))
    resolved = resolve_api(gen) if api else resolve(gen)
    if on_error == "null":
        resolved = resolved.withColumn(
            "Category", F.when(F.col("error").isNull(), F.col("Category")))
    return resolved

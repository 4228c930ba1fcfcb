"""Fault-tolerant request stream (SRC-6, SNK-4, MOD-6, MOD-7) and its progress (RPT-5).

Every request gets exactly one row in one of two sinks: an answer, or a reject
with its body and a reason (a body outside the contract, or a row on which the
generator failed). One bad request never stops the stream, and none vanishes:
answers + rejects = input.

Each micro-batch is written to folders named by its id, with overwrite. Spark
replays a batch that was not committed with the same id and the same input, so
a restart after a crash anywhere in a batch, between the two sinks too, leaves
each request in the sinks once. Batches are bounded by files or bytes.
"""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from intentspark.functions.text import strip_special
from intentspark.operators.prompts import prompt_expr
from intentspark.operators.resolve import resolve_api
from intentspark.operators.scoring import generate
from intentspark.streaming.requests import read_requests, to_response

ANSWERED, REJECTED = "answered", "rejected"
NOT_JSON = "not JSON"
NO_SENTENCE = "no string field sentence"
FAILED = "generation failed"

MAX_FILES = 1000  # of a micro-batch, unless the caller says otherwise


def request_files(spark: SparkSession, path: str, max_files: int = MAX_FILES, max_bytes: str | None = None) -> DataFrame:
    """A stream of request bodies, one a line of the files under ``path``, in
    micro-batches of at most ``max_files`` files (and about ``max_bytes``)."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
    return (reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader).load(path)


def answers(requests: DataFrame, factory, keep=(), value: str = "value", batch_size: int | None = None) -> DataFrame:
    """``(*keep, value, status, response, reason)``: one row for each request.

    Works on batch and streaming DataFrames. Valid bodies are prompted,
    generated (row by row where a batch fails), resolved by the request path's
    rule and answered; all others are rejected with a reason."""
    # one pass over the requests: invalid ones ride along without a prompt
    checked = read_requests(requests, value).select(
        *keep, F.col(value).alias("value"), F.when(F.col("valid"), prompt_expr("sentence")).alias("prompt"))
    scored = generate(checked, _Prompted(factory), on_error="null", batch_size=batch_size)
    resolved = to_response(resolve_api(scored.withColumn("generated", strip_special("generated"))))
    reason = (F.when(F.col("prompt").isNull(), F.when(F.try_parse_json(F.col("value")).isNull(), NOT_JSON).otherwise(NO_SENTENCE))
              .when(F.col("error").isNotNull(), F.concat(F.lit(f"{FAILED}: "), F.col("error"))))
    return (resolved.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), ANSWERED).otherwise(REJECTED))
            .withColumn("response", F.when(F.col("reason").isNull(), F.col("response")))
            .select(*keep, "value", "status", "response", "reason"))


class _Prompted:
    """A factory whose generator hands on the rows that have a prompt."""

    def __init__(self, factory):
        self.factory = factory

    def __call__(self):
        model = self.factory()

        def generator(batch, **limits):
            asked = batch["prompt"].notna().to_numpy()
            texts = list(model(batch[asked].reset_index(drop=True), **limits)) if asked.any() else []
            if len(texts) != asked.sum():
                raise ValueError(f"generator returned {len(texts)} texts for {asked.sum()} rows")
            found = iter(texts)
            return [next(found) if a else None for a in asked]

        try:
            generator.__signature__ = inspect.signature(model)
        except (TypeError, ValueError):
            pass
        return generator


def _batch_writer(factory, responses: str, rejects: str, keep, value: str, batch_size: int | None) -> Callable:
    def write(batch: DataFrame, batch_id: int) -> None:
        # kept for the two writes only; a lost executor's part is generated again
        found = answers(batch, factory, keep, value, batch_size).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for path, status, cols in ((responses, ANSWERED, ("response",)), (rejects, REJECTED, ("value", "reason"))):
                found.filter(F.col("status") == status).select(*keep, *cols) \
                    .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            found.unpersist()
    return write


def serve_requests(requests: DataFrame, factory, responses: str, rejects: str, checkpoint: str, keep=(),
                   value: str = "value", batch_size: int | None = None, once: bool = True) -> StreamingQuery:
    """Start answering a stream of requests into the folders ``responses`` and
    ``rejects`` (parquet, partitioned by ``batch``). ``once`` handles what is
    there in bounded micro-batches, then stops; else the stream goes on."""
    writer = requests.writeStream.foreachBatch(_batch_writer(factory, responses, rejects, keep, value, batch_size)) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def request_totals(spark: SparkSession, responses: str, rejects: str) -> DataFrame:
    """RPT-5 of the sinks: ``(batch, answered, rejected)``, read from what was written."""
    sides = [spark.read.parquet(path).select(F.col("batch").cast("long").alias("batch"), F.lit(status).alias("status"))
             for path, status in ((responses, ANSWERED), (rejects, REJECTED))]
    return sides[0].unionByName(sides[1]).groupBy("batch").agg(
        F.count_if(F.col("status") == ANSWERED).alias("answered"), F.count_if(F.col("status") == REJECTED).alias("rejected"))


class ProgressLedger(StreamingQueryListener):
    """RPT-5: durable progress of streams, one small JSON file for each query and
    batch under ``path`` (any file system that Spark reaches).

    Spark itself keeps the last hundred reports and forgets them at a restart.
    A batch that is run again after a crash overwrites its own file, so the
    totals count every batch once. Add it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    def _file(self, query_id, batch: int):
        jvm = self._spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/query={query_id}/batch-{batch:012d}.json")
        return target.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), target

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        fs, target = self._file(p.id, p.batchId)
        if not p.numInputRows and fs.exists(target):
            return  # an idle trigger repeats the last batch's id
        line = json.dumps({"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "at": p.timestamp}) + "\n"
        part = target.suffix(".part")
        out = fs.create(part, True)
        out.write(bytearray(line.encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(part, target)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until the last report of a stopped query is in the ledger (reports arrive a little later)."""
        last = query.lastProgress
        if last is None:
            return
        fs, target = self._file(query.id, last["batchId"])
        end = time.monotonic() + seconds
        while not fs.exists(target):
            if time.monotonic() > end:
                raise TimeoutError(f"no report of batch {last['batchId']} within {seconds} s")
            time.sleep(0.05)


def progress_by_batch(spark: SparkSession, path: str) -> DataFrame:
    """RPT-5: ``(query, run, batch, rows, at)`` of a ledger."""
    schema = "run string, batch long, rows long, at string, query string"
    return (spark.read.schema(schema).option("basePath", path).option("pathGlobFilter", "*.json").json(path)
            .select("query", "run", "batch", "rows", "at"))


def stream_progress(spark: SparkSession, path: str) -> DataFrame:
    """RPT-5: ``(query, batches, rows, runs)`` over the whole life of each stream."""
    return progress_by_batch(spark, path).groupBy("query").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.count_distinct("run").alias("runs"))

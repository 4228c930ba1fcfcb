"""End-to-end jobs: the batch scoring, fit and table round-trip runs.

Each job composes the operators; expensive results (generations,
predictions) are written once under the output folder and read back, so the
submission, preview and label counts never re-run the scoring.

Command line::

    python -m intentspark.plans.jobs score --input test.csv --output out/ \
        (--generator pkg.module:factory [--on-error null] [--dedupe] [--store texts/] | --model model_dir/) [--strict] [--single-line]
    python -m intentspark.plans.jobs serve --requests in/ --responses out/ --rejects bad/ --checkpoint ck/ \
        --generator pkg.module:factory [--ledger log/] [--max-files 100] [--forever]
    python -m intentspark.plans.jobs fit --input train.csv --model model_dir/
    python -m intentspark.plans.jobs csv-to-table --input train.csv --table intents --location dir/
    python -m intentspark.plans.jobs table-to-csv --table intents --output out/
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.operators import model as model_op
from intentspark.operators import report, scoring
from intentspark.operators import split as split_op
from intentspark.operators.checks import require_rows
from intentspark.sources import csv as csv_io
from intentspark.sources import intents_table
from intentspark.streaming import serving


def score_csv(spark: SparkSession, input_path: str, output_dir: str, factory=None,
              model_dir: str | None = None, strict: bool = False, on_error: str = "raise", dedupe: bool = False,
              multi_line: bool = True, store: str | None = None) -> dict:
    """Batch scoring of an unlabelled CSV (``Id, Sentence``).

    With ``factory``: prompt -> generator -> clean -> resolve (path A);
    ``on_error='null'`` keeps going over failing rows, ``dedupe`` generates each
    distinct prompt once, ``store`` only those that earlier runs did not. With
    ``model_dir``: the saved count model predicts the label (MOD-3).
    Writes ``predictions`` (parquet, with the audit columns) and the sorted
    ``submission`` CSV; returns the 5-row preview and the label counts."""
    if (factory is None) == (model_dir is None):
        raise ValueError("give exactly one of factory or model_dir")
    df = csv_io.read_sentences(spark, input_path, labelled=False, strict=strict, multi_line=multi_line)
    if factory is not None:
        pred = scoring.predict(df, factory, on_error=on_error, dedupe=dedupe, store=store)
    else:
        m = model_op.load_model(spark, model_dir)
        pred = model_op.score_intent_model(df, m, key="Id", text="Sentence", out="Category")
    pred_path = f"{output_dir}/predictions"
    pred.write.mode("overwrite").parquet(pred_path)
    stored = spark.read.parquet(pred_path)
    csv_io.write_submission(stored, f"{output_dir}/submission")
    return {
        "rows": stored.count(),
        "preview": [r.asDict() for r in report.preview(report.submission(stored), 5).collect()],
        "counts": [r.asDict() for r in report.category_counts(stored).collect()],
    }


def fit_csv(spark: SparkSession, input_path: str, model_dir: str,
            fraction: float = domain.SPLIT_TEST_FRACTION, seed: int = domain.SPLIT_SEED,
            alpha: float = 1.0, strict: bool = False, multi_line: bool = True) -> dict:
    """Fit on a labelled CSV (path B): contract check, exact split, count
    model on the train part, evaluation on the held-out part, saved model.
    Returns the split sizes and the metric lines."""
    df = csv_io.read_sentences(spark, input_path, labelled=True, strict=strict, multi_line=multi_line)
    require_rows(df, what=input_path)
    flagged = split_op.with_split(df, "Id", fraction, seed)
    flagged_path = f"{model_dir}/split"
    flagged.write.mode("overwrite").parquet(flagged_path)
    flagged = spark.read.parquet(flagged_path)
    train = flagged.filter(F.col("split") == "train")
    held = flagged.filter(F.col("split") == "eval")
    m = model_op.fit_intent_model(train, label="Category", text="Sentence", alpha=alpha)
    model_op.save_model(m, model_dir)
    m = model_op.load_model(spark, model_dir)
    pred = model_op.score_intent_model(held, m, key="Id", text="Sentence", carry=["Category"])
    _, metrics = model_op.evaluate_scored(pred, "Category")
    return {
        "sizes": {r["split"]: r["n"] for r in split_op.split_sizes(flagged).collect()},
        "metrics": [r["line"] for r in model_op.format_metrics(metrics).orderBy("metric").collect()],
    }


def serve(spark: SparkSession, requests: str, responses: str, rejects: str, checkpoint: str, factory,
          ledger: str | None = None, max_files: int = serving.MAX_FILES, once: bool = True) -> dict:
    """Answer the request files of a folder (one JSON body a line) as a stream;
    run again on the same checkpoint to go on where it stopped. Returns the
    totals of all runs so far: answers, rejects and, with a ``ledger``, rows."""
    log = serving.ProgressLedger(spark, ledger) if ledger else None
    if log:
        spark.streams.addListener(log)
    try:
        q = serving.serve_requests(serving.request_files(spark, requests, max_files), factory, responses, rejects, checkpoint,
                                   once=once)
        q.awaitTermination()
        if log:
            log.wait(q)
    finally:
        if log:
            spark.streams.removeListener(log)
    totals = serving.request_totals(spark, responses, rejects).agg(F.sum("answered"), F.sum("rejected")).first()
    out = {"answered": totals[0] or 0, "rejected": totals[1] or 0}
    if log:
        out["rows"] = serving.stream_progress(spark, ledger).agg(F.sum("rows")).first()[0]
    return out


def csv_to_table(spark: SparkSession, input_path: str, table: str, location: str, multi_line: bool = True) -> int:
    """CSV (strict UTF-8) -> intents table with the declared column types."""
    df = csv_io.read_sentences(spark, input_path, labelled=True, strict=True, multi_line=multi_line)
    intents_table.replace_table(df, table, location)
    return spark.table(table).count()


def table_to_csv(spark: SparkSession, table: str, output_dir: str) -> None:
    """Intents table -> CSV through the SQL projection (no order promise)."""
    csv_io.write_csv(intents_table.read_table_query(spark, table), output_dir)


def _load_factory(spec: str):
    mod, _, attr = spec.partition(":")
    obj = getattr(importlib.import_module(mod), attr)
    return obj


def main(argv=None) -> None:
    from intentspark.session import build_session
    ap = argparse.ArgumentParser(prog="intentspark.plans.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("score")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    g = s.add_mutually_exclusive_group(required=True)
    g.add_argument("--generator", help="module:callable returning a generator factory")
    g.add_argument("--model", help="folder of a saved count model")
    s.add_argument("--on-error", choices=("raise", "null"), default="raise")
    s.add_argument("--dedupe", action="store_true", help="generate each distinct prompt once")
    f = sub.add_parser("fit")
    f.add_argument("--input", required=True)
    f.add_argument("--model", required=True)
    s.add_argument("--store", help="folder that keeps generated texts over runs")
    for p in (s, f):
        p.add_argument("--strict", action="store_true")
    v = sub.add_parser("serve")
    for name in ("requests", "responses", "rejects", "checkpoint", "generator"):
        v.add_argument(f"--{name}", required=True)
    v.add_argument("--ledger")
    v.add_argument("--max-files", type=int, default=serving.MAX_FILES)
    v.add_argument("--forever", action="store_true", help="go on waiting for new files")
    c = sub.add_parser("csv-to-table")
    c.add_argument("--input", required=True)
    c.add_argument("--table", default="intents")
    c.add_argument("--location", required=True)
    for p in (s, f, c):
        p.add_argument("--single-line", action="store_true", help="no field holds a newline")
    t = sub.add_parser("table-to-csv")
    t.add_argument("--table", default="intents")
    t.add_argument("--output", required=True)
    a = ap.parse_args(argv)
    spark = build_session()
    if a.cmd == "score":
        factory = _load_factory(a.generator)() if a.generator else None
        out = score_csv(spark, a.input, a.output, factory=factory, model_dir=a.model, strict=a.strict, on_error=a.on_error,
                        dedupe=a.dedupe, multi_line=not a.single_line, store=a.store)
    elif a.cmd == "fit":
        out = fit_csv(spark, a.input, a.model, strict=a.strict, multi_line=not a.single_line)
    elif a.cmd == "serve":
        out = serve(spark, a.requests, a.responses, a.rejects, a.checkpoint, _load_factory(a.generator)(), a.ledger,
                    a.max_files, once=not a.forever)
    elif a.cmd == "csv-to-table":
        out = {"rows": csv_to_table(spark, a.input, a.table, a.location, not a.single_line)}
    else:
        table_to_csv(spark, a.table, a.output)
        out = {"written": a.output}
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()

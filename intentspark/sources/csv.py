"""CSV sources and sinks (SRC-1..SRC-3, SNK-1, SNK-2).

Cells are read as strings by header name (extra and reordered columns are
fine, a missing one fails with both column lists), pandas' default NA
strings become null, then ``Id`` is cast. Quoted fields may hold commas,
doubled quotes and newlines, and still every file is read by many tasks
(:mod:`intentspark.sources.csv_records`). Files of one folder may order their
columns differently: each is read by its own header.
"""

from __future__ import annotations

import csv as text_csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark import domain
from intentspark.operators.checks import ContractError, require_columns
from intentspark.operators.report import submission
from intentspark.sources.csv_records import records, survey

LABELLED = ("Id", "Sentence", "Category")
UNLABELLED = ("Id", "Sentence")

READ_OPTIONS = dict(header=True, quote='"', escape='"', encoding="UTF-8",
                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
WRITE_OPTIONS = dict(header=True, quote='"', escape='"', emptyValue="",
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


SURPLUS = "__surplus_field"


class InvalidUtf8Error(ContractError):
    """Strict reading found bytes that are not UTF-8."""


def header_names(line: str) -> list[str]:
    """Column names of a header line; a repeated name gets its place appended."""
    names = next(text_csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), [])
    return [n if n not in names[:i] else f"{n}{i}" for i, n in enumerate(names)]


def _load(spark: SparkSession, path: str, strict: bool, multi_line: bool) -> list[DataFrame]:
    """All rows as strings, one frame for each header that the files have."""
    options = READ_OPTIONS | {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    fail = F.raise_error(F.lit(f"{path}: a row has more fields than the header")).cast("boolean")

    def schema(names):
        # one more column than the header has takes a surplus field, which would else be dropped
        fields = [T.StructField(n, T.StringType()) for n in names]
        return T.StructType(fields if strict else [*fields, T.StructField(SURPLUS, T.StringType())])

    def ddl(kind):
        return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in kind.fields)

    def checked(df):
        return df if strict else df.filter(F.when(F.col(SURPLUS).isNotNull(), fail).otherwise(True)).drop(SURPLUS)

    try:
        splits = survey(spark, path, quoted=multi_line)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"input not found: {path}") from e  # CHK-2
        raise
    cut = records(spark, path, splits) if splits.any_open else None
    headers = splits.headers if cut is None else dict(map(tuple, cut.filter("is_first").select("file", "record").collect()))
    files: dict[tuple, list[str]] = {}
    for file, line in headers.items():
        files.setdefault(tuple(header_names(line)), []).append(file)
    frames = []
    for names, own in files.items():
        if cut is None:
            rows = spark.read.options(**options).schema(schema(names)).csv(path)
            rows = rows if len(files) == 1 else rows.filter(F.col("_metadata.file_path").isin(own))
        else:
            rows = cut if len(files) == 1 else cut.filter(F.col("file").isin(own))
            parse = {k: str(v) for k, v in options.items() if k != "header"}
            rows = rows.filter(~F.col("is_first") & (F.col("record") != "")) \
                .select(F.from_csv("record", ddl(schema(names)), parse).alias("r")).select("r.*")
        frames.append(checked(rows))
    return frames or [spark.createDataFrame([], T.StructType([]))]


def check_utf8(spark: SparkSession, path: str) -> None:
    """SRC-3: fail if any line holds bytes that are not valid UTF-8.

    The text source keeps raw bytes, so the check is a distributed filter
    with a limit-1 job; nothing is decoded on the driver.
    """
    bad = (spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count())
    if bad:
        raise InvalidUtf8Error(f"{path}: invalid UTF-8 bytes")


def read_sentences(spark: SparkSession, path: str, labelled: bool = True,
                   strict: bool = False, columns=None, multi_line: bool = True) -> DataFrame:
    """SRC-1/SRC-2 (lenient: bad bytes become U+FFFD) and SRC-3 (strict:
    invalid UTF-8 and malformed rows fail the read).

    A row with fewer fields than the header has nulls for the rest; one with
    more (but for a single empty one) fails the read.
    Returns ``Id LONG, Sentence STRING[, Category STRING]`` (or ``columns``).
    ``multi_line=False`` is for inputs known to hold no quoted newlines: it
    saves the look for them.
    """
    cols = tuple(columns) if columns else (LABELLED if labelled else UNLABELLED)
    parts = _load(spark, path, strict, multi_line)
    if strict:
        check_utf8(spark, path)
    na = list(domain.PANDAS_NA_STRINGS)
    out = None
    for raw in parts:
        require_columns(raw, cols, what=path)
        part = raw.select(*[F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols])
        out = part if out is None else out.unionByName(part)
    if "Id" in cols:
        out = out.withColumn("Id", F.col("Id").cast("long"))
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: header, no index, quotes doubled, spaces and empties kept.
    No order promise (see ``write_submission``)."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def write_submission(pred: DataFrame, path: str, key: str = "Id",
                     label: str = "Category") -> None:
    """SNK-2: ``(Id, Category)``, Id cast to integer (fails on bad values),
    range-partitioned by Id so part files are in Id order and each is sorted."""
    write_csv(submission(pred, key, label), path)

"""CSV records from files that are split across tasks (SRC-1..SRC-3).

A quoted field may hold newlines, so a line's meaning depends on whether it
starts inside a quoted field, which only the lines before it tell. Read by
splits, this is a prefix computation:

1. Each line with a quote is a map from "starts inside quotes or not" to the
   same for the next line; lines without quotes change nothing. A split's map is
   the composition of its lines' maps, made where the split is read.
2. The maps of a file's splits, one row a split, are composed in order: every
   split's starting state.
3. With it each task cuts its own lines into records. A record that crosses
   splits comes as fragments, at most two a split, that are put together by a
   grouping of the fragments alone.

Where no line leaves a field open, lines are records and the second read is
Spark's own splittable one. Lines end in ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.operators.checks import ContractError
from intentspark.session import local_table, scratch_path, ship_package

#: Characters of records in a batch handed back by a task.
BATCH_CHARS = 1 << 20

_QUOTED = re.compile(r'(?:[^"]|"")*')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the line after ``line`` starts inside a quoted field. A quote
    opens a field at its very start only; a doubled one inside is text."""
    at, n = 0, len(line)
    while True:
        if not inside:
            while line[at:at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
            at += 1
        at = _QUOTED.match(line, at).end()
        if at >= n:
            return True
        at = line.find(",", at) + 1  # what follows the closing quote belongs to the field
        if not at:
            return False
        inside = False


class Splits(NamedTuple):
    """What a first look at the files finds."""

    headers: dict[str, str]          # first line by file
    inside: set[tuple[str, int]]     # splits that start inside a quoted field
    any_open: bool                   # some line leaves a field open


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def survey(spark: SparkSession, path, quoted: bool = True) -> Splits:
    """The first lines of the files and, if ``quoted``, the starting states of
    the splits: one row a split for the driver. Only lines with a quote go to
    Python."""
    ship_package(spark)
    lines = _lines(spark, path)
    found = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "start").agg(
        F.min_by("value", "at").alias("first"),
        F.count_if(F.col("value").contains('"')).alias("quoted")) \
        .select("file", "start", F.when(F.col("start") == 0, F.col("first")).alias("first"), "quoted").collect()
    headers = {r["file"]: r["first"] for r in found if r["start"] == 0}
    if not quoted or not any(r["quoted"] for r in found):
        return Splits(headers, set(), False)

    def task(batches):
        maps: dict[tuple[str, int], tuple] = {}  # by split: the state after, from outside and from inside; any line that opens
        for b in batches:
            for line, file, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                line = line.decode("utf-8", "replace")
                after = ends_inside(line, False), ends_inside(line, True)
                out, in_, opens = maps.get((file, start), (False, True, False))
                maps[file, start] = after[out], after[in_], opens or after[0]
        if maps:
            rows = [(*k, *v) for k, v in maps.items()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                             names=["file", "start", "after_out", "after_in", "opens"])

    maps = {(r[0], r[1]): r[2:] for r in lines.filter(F.col("value").contains('"'))
            .select(F.col("value").cast("binary"), "file", "start")
            .mapInArrow(task, "file string, start long, after_out boolean, after_in boolean, opens boolean").collect()}
    inside, state = set(), {}
    for file, start in sorted((r["file"], r["start"]) for r in found):
        if state.get(file, False):
            inside.add((file, start))
        state[file] = maps.get((file, start), (False, True))[state.get(file, False)]
    return Splits(headers, inside, any(m[2] for m in maps.values()))


#: Kinds of a piece of text: a record, the first record of a file, and the
#: fragments of records that cross splits: beginning, middle, end.
RECORD, FIRST, BEGINS, GOES_ON, ENDS = range(5)


def _cut(lines: Iterator[tuple[str, str, int]], inside: set[tuple[str, int]]) -> Iterator[tuple]:
    """(file, start, kind, text) of the lines of whole splits."""
    now, held, state, open_start, ended = None, [], False, False, 0

    def rest():
        if held:
            yield (*now, GOES_ON if open_start and not ended else BEGINS, "\n".join(held))

    for line, file, start in lines:
        if (file, start) != now:
            yield from rest()
            now, held, ended = (file, start), [], 0
            state = open_start = now in inside
        held.append(line)
        state = ends_inside(line, state) if '"' in line else state
        if not state:
            kind = RECORD if ended else ENDS if open_start else FIRST if start == 0 else RECORD
            yield file, start, kind, "\n".join(held)
            held, ended = [], ended + 1
    yield from rest()


def records(spark: SparkSession, path, splits: Splits) -> DataFrame:
    """``(file, is_first, record)``: all records, the first of each file marked.

    The records are written to the shared folder once. Fragments of those that
    cross splits (at most two a split) are grouped by the split where their
    record begins and joined. A first record (the header) longer than a split
    is an error."""
    ship_package(spark)
    inside = splits.inside  # at most one entry a split, as the driver's list of splits has
    names, kinds = ["file", "start", "kind", "text"], (pa.string(), pa.int64(), pa.int32(), pa.string())

    def task(batches):
        def lines():
            for b in batches:
                for value, file, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                    yield value.decode("utf-8", "replace"), file, start

        rows, size = [], 0
        for row in _cut(lines(), inside):
            rows.append(row)
            size += len(row[3])
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    out = scratch_path(spark, "csv-records")
    _lines(spark, path).select(F.col("value").cast("binary"), "file", "start") \
        .mapInArrow(task, "file string, start long, kind int, text string").write.parquet(out)
    cut = spark.read.parquet(out)
    whole = cut.filter(F.col("kind") <= FIRST).select("file", (F.col("kind") == FIRST).alias("is_first"), "text")
    parts = cut.filter(F.col("kind") >= BEGINS)
    begins, origins = {}, []
    for file, start, kind in sorted(map(tuple, parts.select("file", "start", "kind").collect()), key=lambda r: (r[0], r[1], r[2] == BEGINS)):
        if kind == BEGINS:
            if start == 0 and splits.headers.get(file) is not None and ends_inside(splits.headers[file], False):
                raise ContractError(f"{file}: the header is longer than a split")
            begins[file] = start
        origins.append((file, start, kind, begins[file]))  # one or two a split inside quotes
    known = local_table(spark, origins, T.StructType([
        T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
        T.StructField("origin", T.LongType())]))
    ordered = F.array_sort(F.collect_list(F.struct("start", "text"))).getField("text")
    joined = (parts.join(F.broadcast(known), ["file", "start", "kind"]).groupBy("file", "origin")
              .agg(F.array_join(ordered, "\n").alias("text")).select("file", F.lit(False).alias("is_first"), "text"))
    return whole.unionByName(joined).select("file", "is_first", F.regexp_replace("text", "\r$", "").alias("record"))

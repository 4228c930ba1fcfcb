"""Hard negatives by a secondary sort.

A pair of an anchor and a row becomes one packed key (anchor, descending score,
side, id): as bytes its order is the order in which a miner reads an anchor's
pairs. ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts
them, and an iterator walks each partition once: a positive opens a window, a
negative goes to every open window whose margin holds it, a window closes after
its last negative or below its margin. The iterator holds the open windows of
one anchor, never its pairs.

The keys are combined before the shuffle, without loss:

1. positives: a block of rows sends each anchor's first positives only;
2. negatives: with the positives known, a block sends the first negatives of
   each window only.

Scores are made in blocks: rows are dealt into cells, each cell gets the
anchors of one block (at most ``ANCHOR_VALUES`` numbers) ahead of its rows,
which then stream past. Neither side is broadcast, and no pair outside the
anchors' own query set is formed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import prepare, shuffle_partitions, written
from intentspark.sources.tables import read_table

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is between these percentages of its positive's.
LOW, HIGH = 80, 100

#: Numbers of the anchors held by a task at once, and of a cell's rows.
ANCHOR_VALUES, ROW_VALUES = 1 << 22, 1 << 20
#: Scores made at once in a task.
SCORES = 1 << 21

#: Integers below this are exact as doubles.
EXACT = 1 << 53
_TOP = (1 << 63) - 1

_KEY = np.dtype([("anchor", ">u8"), ("anchor_row", ">u8"), ("falling", ">u8"), ("side", "u1"), ("id", ">u8"),
                 ("row", ">u8")])
_KEY_SCHEMA = pa.schema([("key", pa.binary())])
_SIGN = np.uint64(1 << 63)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones of the same order."""
    return x.astype(np.int64).view(np.uint64) ^ _SIGN


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) ^ _SIGN).view(np.int64)


def pack(anchor, anchor_row, score, side: int, ids, rows) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, side (positives before
    negatives of the same score), id and row."""
    keys = np.empty(len(ids), _KEY)
    keys["anchor"], keys["anchor_row"] = _ordered(anchor), anchor_row
    keys["falling"], keys["side"] = ~_ordered(score), side
    keys["id"], keys["row"] = _ordered(ids), rows
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return packed.cast(pa.binary())


def unpack(key: bytes) -> tuple[int, int, int, int, int, int]:
    """(anchor, anchor_row, score, side, id, row) of one key."""
    k = np.frombuffer(key, _KEY)
    return (int(_signed(k["anchor"])[0]), int(k["anchor_row"][0]), int(_signed(~k["falling"].astype(np.uint64))[0]),
            int(k["side"][0]), int(_signed(k["id"])[0]), int(k["row"][0]))


def sorted_keys(keys: DataFrame):
    """An RDD of the keys, each anchor's in one partition and in order."""
    n = shuffle_partitions(keys.sparkSession)
    return (keys.rdd.map(lambda r: (bytes(r[0]), None))
            .repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:16])).keys())


def first_positives(keys: Iterator[bytes], most: int) -> Iterator[tuple]:
    """(anchor, anchor_row, id, row, score) of the first positives of each anchor."""
    now, seen = None, 0
    for key in keys:
        if key[:16] != now:
            now, seen = key[:16], 0
        if seen < most:
            seen += 1
            anchor, anchor_row, score, _, id_, row = unpack(key)
            yield anchor, anchor_row, id_, row, score


def windows(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive's score, negative's score),
    from one pass over sorted keys. Only the open windows are held."""
    now, opened, open_ = None, 0, []
    for key in keys:
        if key[:16] != now:
            now, opened, open_ = key[:16], 0, []
        anchor, _, score, side, id_, _ = unpack(key)
        if side == 0:
            if opened < positives:
                opened += 1
                open_.append([id_, score, 0])
            continue
        still = []
        for window in open_:
            positive, top, rank = window
            if 100 * score < low * top:  # scores fall: nothing more for this window
                continue
            if 100 * score <= high * top:
                window[2] = rank = rank + 1
                yield anchor, positive, rank, id_, top, score
            if rank < negatives:
                still.append(window)
        open_ = still


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> tuple:
    """The first ``most`` entries of each group: higher scores, then smaller ids."""
    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    starts = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
    at = np.arange(len(g))
    kept = order[at - np.maximum.accumulate(np.where(starts, at, 0)) < most]
    return group[kept], score[kept], ids[kept], rows[kept]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products. ``exact``: all sums are exact as doubles."""
    if exact:
        return (a @ b.T).astype(np.int64)
    got = a.astype(object) @ b.astype(object).T
    if got.size and (got.max() > _TOP or got.min() < -_TOP):
        raise OverflowError("an inner product does not fit 64 bits")
    return got.astype(np.int64)


def _matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """Rows of integers, short ones filled."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy()
    out = np.full((len(column), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class _Cell:
    """The first pairs of a cell's anchors, over the rows seen so far."""

    def __init__(self, dims: int, exact: bool, keep: int, positives: bool):
        self.dims, self.exact, self.keep, self.positives = dims, exact, keep, positives
        self.parts: list[pa.RecordBatch] = []
        self.best = None

    def number(self, m: np.ndarray) -> np.ndarray:
        return m.astype(np.float64) if self.exact else m

    def start(self) -> None:
        t = pa.Table.from_batches(self.parts)
        c = {n: t.column(n).combine_chunks() for n in t.schema.names}
        self.id, self.row, self.label = (c[n].to_numpy() for n in ("id", "row", "label"))
        self.m = self.number(_matrix(c["vec"], self.dims))
        if not self.positives:  # a column for each window, empty ones hold no score
            self.width = int(pc.max(pc.list_value_length(c["tops"])).as_py())
            self.tops, self.lows = _matrix(c["tops"], self.width, -1), _matrix(c["lows"], self.width, 0)
        self.best = tuple(np.empty(0, np.int64) for _ in range(4))

    def merge(self, group, score, ids, rows) -> None:
        self.best = first_of(*(np.concatenate(x) for x in zip(self.best, (group, score, ids, rows))), self.keep)

    def candidates(self, s: np.ndarray, ok: np.ndarray, groups: np.ndarray, ids, rows) -> None:
        """Take the entries of ``s`` (one line a group) that may be among the first."""
        if s.shape[1] > self.keep:
            low = np.where(ok, s, -_TOP)
            ok = ok & (s >= np.partition(low, -self.keep, axis=1)[:, -self.keep][:, None])
        line, at = np.nonzero(ok)
        if len(line):
            self.merge(groups[line], s[line, at], ids[at], rows[at])

    def rows(self, batch: pa.RecordBatch) -> None:
        ids, rows, label = (batch.column(n).to_numpy() for n in ("id", "row", "label"))
        m = self.number(_matrix(batch.column("vec"), self.dims))
        step = max(1, SCORES // max(len(m), 1))
        for a in range(0, len(self.m), step):
            at = np.arange(a, min(a + step, len(self.m)))
            s = products(self.m[at], m, self.exact)
            same = self.label[at][:, None] == label
            if self.positives:
                self.candidates(s, same & (self.row[at][:, None] != rows), at, ids, rows)
                continue
            for w in range(self.width):
                ok = ~same & (s <= self.tops[at, w][:, None]) & (s >= self.lows[at, w][:, None])
                self.candidates(s, ok, at * self.width + w, ids, rows)

    def keys(self) -> Iterator[pa.RecordBatch]:
        if self.best is None or not len(self.best[0]):
            return
        anchor, score, ids, rows = self.best
        if not self.positives:
            anchor = anchor // self.width
            once = np.unique(np.stack([anchor, rows]), axis=1, return_index=True)[1]  # a pair may be in several windows
            anchor, score, ids, rows = anchor[once], score[once], ids[once], rows[once]
        packed = pack(self.id[anchor], self.row[anchor], score, 0 if self.positives else 1, ids, rows)
        yield pa.RecordBatch.from_arrays([packed], schema=_KEY_SCHEMA)


def _scored(cells: DataFrame, dims: int, exact: bool, positives: bool, keep: int) -> DataFrame:
    """Keys of the first pairs of each cell: its anchors come first, then its rows stream past."""

    def task(batches):
        cell, now = None, None
        for batch in batches:
            ids, is_row = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for a, b in zip(cuts, [*cuts[1:], len(ids)]):
                if ids[a] != now:
                    if cell is not None:
                        yield from cell.keys()
                    cell, now = _Cell(dims, exact, keep, positives), ids[a]
                n = int(b - a - is_row[a:b].sum())
                if n:
                    cell.parts.append(batch.slice(a, n))
                if a + n < b and (cell.parts or cell.best is not None):  # else no anchor of this block is left
                    if cell.best is None:
                        cell.start()
                        cell.parts = []
                    cell.rows(batch.slice(a + n, b - a - n))
        if cell is not None:
            yield from cell.keys()

    return cells.mapInArrow(task, "key binary")


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, streams: int) -> DataFrame:
    """Every row once for each block of anchors, and every anchor once for each
    stream of rows, a cell's anchors before its rows."""
    cell = F.col("_block") * F.lit(streams) + F.col("_stream")
    some = F.lit(None).cast("array<bigint>")
    left = (anchors.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
            .withColumn("_stream", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))))
            .select(cell.cast("bigint").alias("cell"), F.lit(False).alias("is_row"), "id", "row", "label", "vec", "tops", "lows"))
    right = (rows.withColumn("_stream", F.pmod(F.xxhash64("row"), F.lit(streams)))
             .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(cell.cast("bigint").alias("cell"), F.lit(True).alias("is_row"), "id", "row", "label", "vec",
                     some.alias("tops"), some.alias("lows")))
    n = min(max(shuffle_partitions(rows.sparkSession), 1), blocks * streams)
    return left.unionByName(right).repartition(n, "cell").sortWithinPartitions("cell", "is_row")


def mine(vectors: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "vec",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds.

    ``vector`` is an array of integers; the score of a row is its inner product
    with the anchor, higher first, ties by smaller id. The positives of an
    anchor are its first ``positives`` other rows of the same label; for each,
    the first ``negatives`` rows of another label whose score is between
    ``low`` and ``high`` per cent of the positive's. Returns (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label or vector, or a null component, take no part.
    Repeated rows are rows of their own: each is an anchor of its own, and the
    positive or negative of others. Vectors of different lengths meet as if the
    shorter ended in zeros. Other columns are ignored. An empty table gives no
    rows. A score beyond 64 bits is an error.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are percentages, the lower first")
    spark = vectors.sparkSession
    prepare(spark)
    table = written(
        vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                       F.col(vector).cast("array<bigint>").alias("vec"), anchor.alias("is_anchor"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                & ~F.exists("vec", lambda x: x.isNull()))
        .withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = table.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1)), F.max(F.size("vec")),
                     F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).first()
    count, n_anchors, dims, largest = (int(x or 0) for x in size)
    dims = max(dims, 1)
    exact = dims * largest * largest < EXACT
    blocks = max(1, -(-2 * n_anchors * dims // ANCHOR_VALUES))  # filled to a half on average
    streams = max(1, -(-count * dims // ROW_VALUES))
    rows = table.select("id", "row", "label", "vec")
    none = F.lit(None).cast("array<bigint>")
    anchors = table.filter("is_anchor").select("id", "row", "label", "vec")

    cells = _cells(rows, anchors.withColumn("tops", none).withColumn("lows", none), blocks, streams)
    mates = written(_scored(cells, dims, exact, True, positives), "positive-keys")
    found = sorted_keys(mates).mapPartitions(lambda keys: first_positives(keys, positives))
    first = written(spark.createDataFrame(found, "anchor bigint, anchor_row bigint, id bigint, row bigint, score bigint"),
                    "positives")
    # decimals: 100 times a score may pass 64 bits
    least = F.ceil(F.col("score").cast("decimal(25,0)") * low / 100).cast("bigint")
    most = F.floor(F.col("score").cast("decimal(25,0)") * high / 100).cast("bigint")
    opened = (first.select(F.col("anchor_row").alias("row"), most.alias("top"), least.alias("low"))
              .filter("low <= top").distinct()
              .groupBy("row").agg(F.collect_list(F.struct("top", "low")).alias("_w"))
              .select("row", F.col("_w.top").alias("tops"), F.col("_w.low").alias("lows")))
    cells = _cells(rows, anchors.join(opened, "row"), blocks, streams)
    others = _scored(cells, dims, exact, False, negatives)

    def as_keys(batches):
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in b.schema.names}
            yield pa.RecordBatch.from_arrays(
                [pack(c["anchor"], c["anchor_row"], c["score"], 0, c["id"], c["row"])], schema=_KEY_SCHEMA)

    keys = written(others.unionByName(first.mapInArrow(as_keys, "key binary")), "window-keys")
    out = sorted_keys(keys).mapPartitions(lambda found: windows(found, positives, negatives, low, high))
    return spark.createDataFrame(out, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                      "positive_score bigint, negative_score bigint")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows with a whole finite vector: labels of
    ids divisible by 7 moved to the next of ten, components floor(256 * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    label = F.col("label").cast("bigint")
    return (embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))
            .select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose id is divisible by 100, against all rows."""
    return mine(integer_vectors(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, id="vec_id")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.vec, b.vec)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

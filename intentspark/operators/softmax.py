"""Iteratively fitted intent model: softmax regression over hashed tokens (MOD-2, MOD-4).

Every epoch is one Spark job: tasks read their part of the feature table (made
once, written to the shared folder) with the weights broadcast, and send the sum
of their gradients in blocks of buckets; the blocks are dealt by number, sorted
and summed as they stream past. The same pass scores the held-out rows. The driver holds the weights, of a size that the
caller's parameters bound, makes the step, and writes its state after each
epoch, from which a broken-off fit goes on.

Tokens are hashed into ``buckets``; a row has the same value in each bucket that
its tokens fall into, of Euclidean length 1 in all, and a last bucket is 1 (the
bias). So the feature table holds the buckets alone. Tasks take many rows at a
time, label by label, in parts of a bounded number of buckets.
The first weights are those of a count model over the buckets (one more pass),
so epochs improve on naive Bayes; steps are Adagrad's, with a rate that rises
over the first ``warmup`` epochs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.functions.text import tokenize
from intentspark.session import local_table, scratch_path, ship_package, stored

EPOCHS = 10
BUCKETS = 1 << 16
BLOCK = 1 << 12  # buckets of a gradient that travel together
#: Labels times buckets, at most: 32 MB of weights.
MAX_WEIGHTS = 1 << 22

PART = 1 << 18  # buckets of rows that a task takes together, if they are not of one row

_FEATURES = pa.schema([("label", pa.int32()), ("held", pa.bool_()), ("at", pa.list_(pa.int32()))])
_STATE = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("w", T.BinaryType()),
                       T.StructField("g2", T.BinaryType())])
_HISTORY = T.StructType([T.StructField("epoch", T.IntegerType())] + [
    T.StructField(n, T.DoubleType()) for n in ("train_loss", "held_loss", "held_accuracy")])


@dataclass
class SoftmaxModel:
    labels: list
    weights: np.ndarray              # labels x (buckets + 1)
    history: list = field(default_factory=list)  # (epoch, train_loss, held_loss, held_accuracy) of the weights before it
    epoch: int = 0                   # the epoch whose weights these are


def _hashed(text: str, buckets: int):
    return F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, where each list starts and the last one ends)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]


def _distinct(flat: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of hashed tokens, as by :func:`_lists`, with each bucket once."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    both = np.unique(row * buckets + flat)
    return (both % buckets).astype(np.int32), np.searchsorted(both, np.arange(len(ends)) * buckets)


def _parts(ends: np.ndarray):
    """(first row, row after the last) of stretches of rows of up to PART values, or of one row."""
    at = 0
    while at < len(ends) - 1:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, side="right")) - 1)
        yield at, end
        at = end


def _scale(ends: np.ndarray) -> np.ndarray:
    """The value that each row has in its buckets."""
    return 1 / np.sqrt(np.maximum(np.diff(ends), 1))


def _scores(weights: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows x labels: the products of the weights and rows with the buckets ``at``."""
    some = np.flatnonzero(np.diff(ends))  # rows that have tokens: the others get the bias alone
    scale = _scale(ends)[some]
    out = np.repeat(weights[:, -1][None, :], len(ends) - 1, axis=0)
    if len(some):
        for label, w in enumerate(weights):
            out[some, label] += np.add.reduceat(w[at], ends[some]) * scale
    return out


def _feature_table(rows: DataFrame, labels: list, buckets: int) -> DataFrame:
    """(label, held, at) of rows (label, held, hashed): a label's number, -1 for one that was not in training."""
    numbers = {lab: i for i, lab in enumerate(labels)}

    def task(batches):
        for b in batches:
            number = pa.array([numbers.get(lab, -1) for lab in b.column("label").to_pylist()], pa.int32())
            flat, ends = _lists(b.column("hashed"))
            for i, j in _parts(ends):
                at, some = _distinct(flat[ends[i]:ends[j]], ends[i:j + 1] - ends[i], buckets)
                yield pa.RecordBatch.from_arrays([number[i:j], b.column("held")[i:j], pa.ListArray.from_arrays(
                    pa.array(some, pa.int32()), pa.array(at))], schema=_FEATURES)

    return stored(rows.mapInArrow(task, "label int, held boolean, at array<int>"), "softmax-features")


_BLOCKS = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def _blocks(m: np.ndarray) -> list[tuple[int, bytes]]:
    """(number, bytes) of a matrix cut into blocks of columns."""
    return [(k, np.ascontiguousarray(m[:, a:a + BLOCK]).tobytes()) for k, a in enumerate(range(0, m.shape[1], BLOCK))]


def _joined(blocks: list[tuple[int, bytes]], n_labels: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(bytes(b), np.float64).reshape(n_labels, -1) for _, b in sorted(blocks)], axis=1)


def _summed(batches):
    """Blocks of the same number, which come one after another, as their sum."""
    now, total = None, None
    for b in batches:
        done = []
        for block, sums in zip(b.column("block").to_pylist(), b.column("sums").to_pylist()):
            part = np.frombuffer(sums, np.float64)
            if block != now:
                if now is not None:
                    done.append((now, total.tobytes()))
                now, total = block, part.copy()
            else:
                total += part
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done), _BLOCKS)], schema=_BLOCKS)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_BLOCKS)


def _first_weights(features: DataFrame, n_labels: int, width: int) -> np.ndarray:
    """Log shares of the buckets in each label's training rows, smoothed by one, and the
    log share of the rows; centred over the labels."""
    counts, _ = _epoch(features, np.zeros((n_labels, width)), counting=True)
    tokens = counts[:, :-1]
    w = np.log(np.concatenate([(tokens + 1) / (tokens.sum(axis=1, keepdims=True) + width - 1),
                               counts[:, -1:] / counts[:, -1].sum()], axis=1))
    return w - w.mean(axis=0)


def _count(counts: np.ndarray, at: np.ndarray, ends: np.ndarray, labels: np.ndarray, sides: np.ndarray) -> None:
    """Add the training rows to their label's buckets and bias."""
    each = np.repeat(np.where(sides == 0, labels, -1), np.diff(ends))
    for label, row in enumerate(counts):
        row[:-1] += np.bincount(at[each == label], minlength=len(row) - 1)
        row[-1] += np.count_nonzero((sides == 0) & (labels == label))


def _add(gradient: np.ndarray, sums: np.ndarray, weights: np.ndarray, at: np.ndarray, ends: np.ndarray,
         labels: np.ndarray, sides: np.ndarray) -> None:
    """Add the training rows' gradients, and the loss, hits and number of rows of either side."""
    p = _scores(weights, at, ends)
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    rows, known = np.arange(len(labels)), labels >= 0
    loss = np.where(known, -np.log(np.maximum(p[rows, labels], 1e-300)), 0.0)
    hit = known & (p.argmax(axis=1) == labels)
    for k, x in enumerate((loss, hit, np.ones(len(rows)))):
        sums[:, k] += np.bincount(sides, weights=x, minlength=2)
    p[rows[known], labels[known]] -= 1.0
    p[sides == 1] = 0.0
    n, scale = np.diff(ends), _scale(ends)
    for label, row in enumerate(gradient):
        row[:-1] += np.bincount(at, weights=np.repeat(p[:, label] * scale, n), minlength=len(row) - 1)
        row[-1] += p[:, label].sum()


def _epoch(features: DataFrame, weights: np.ndarray, counting: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the training rows' gradients, sums of loss, hits and rows of both
    parts). ``counting``: the rows in each label and bucket instead of gradients."""
    spark = features.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # at most MAX_WEIGHTS numbers
    n_labels, width = weights.shape

    def task(batches):
        w, gradient, sums = shared.value, np.zeros((n_labels, width)), np.zeros((2, 3))
        for b in batches:
            labels, sides = b.column("label").to_numpy(), b.column("held").to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = _lists(b.column("at"))
            for i, j in _parts(ends):
                part = flat[ends[i]:ends[j]], ends[i:j + 1] - ends[i], labels[i:j], sides[i:j]
                if counting:
                    _count(gradient, *part)
                else:
                    _add(gradient, sums, w, *part)
        out = [(-1, sums.tobytes()), *_blocks(gradient)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _BLOCKS)], schema=_BLOCKS)

    n = -(-width // BLOCK) + 1
    found = (features.mapInArrow(task, "block int, sums binary").repartition(n, "block").sortWithinPartitions("block")
             .mapInArrow(_summed, "block int, sums binary").collect())  # the gradient, once
    shared.unpersist()
    blocks = {r[0]: r[1] for r in found}
    sums = np.frombuffer(bytes(blocks.pop(-1, np.zeros(6).tobytes())), np.float64).reshape(2, 3)
    return (_joined(list(blocks.items()), n_labels) if blocks else np.zeros((n_labels, width))), sums


def _save(spark: SparkSession, state: str, epoch: int, w: np.ndarray, g2: np.ndarray, history: list) -> None:
    local_table(spark, [(k, a, b) for (k, a), (_, b) in zip(_blocks(w), _blocks(g2))], _STATE) \
        .coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={epoch}/weights")
    local_table(spark, history, _HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={epoch}/history")


def _load(spark: SparkSession, state: str, epoch: int, n_labels: int) -> tuple | None:
    """(weights, squares, history) after an epoch, None if it was not finished."""
    path = f"{state}/epoch={epoch}/history"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # the last thing that an epoch writes
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    rows = spark.read.schema(_STATE).parquet(f"{state}/epoch={epoch}/weights").collect()
    history = [tuple(r) for r in spark.read.schema(_HISTORY).parquet(path).orderBy("epoch").collect()]
    return _joined([(r["block"], r["w"]) for r in rows], n_labels), _joined([(r["block"], r["g2"]) for r in rows], n_labels), history


def fit_softmax(train: DataFrame, held: DataFrame, label: str, text: str, epochs: int = EPOCHS, warmup: int = 2,
                rate: float = 1.0, buckets: int = BUCKETS, state: str | None = None) -> SoftmaxModel:
    """Fit on ``train`` and keep the weights of the epoch with the best accuracy
    on ``held`` (of equal ones that with the smaller loss, then the earlier).

    ``state`` names a folder where each epoch's weights are written; a fit that
    finds finished epochs there goes on after them (give a new folder for new
    data or parameters). Training rows without a label are an error; held-out
    rows with a label that training has not count as wrong. The weights under
    any partitioning agree but for the rounding of sums.
    """
    spark = train.sparkSession
    ship_package(spark)
    most = MAX_WEIGHTS // (buckets + 1)
    labels = [r[0] for r in train.select(F.col(label)).distinct().limit(most + 1).collect()]
    if None in labels:
        raise ValueError("training rows have no label")
    if not labels or len(labels) > most:
        raise ValueError(f"{buckets} buckets allow 1 to {most} labels")
    labels.sort()
    rows = [df.select(F.col(label).alias("label"), F.lit(is_held).alias("held"), _hashed(text, buckets).alias("hashed"))
            for df, is_held in ((train, False), (held, True))]
    features = _feature_table(rows[0].unionByName(rows[1]), labels, buckets)
    state = state or scratch_path(spark, "softmax")
    g2 = np.zeros((len(labels), buckets + 1))
    w = first = _first_weights(features, *g2.shape)
    history: list[tuple] = []
    start = 0
    while (found := _load(spark, state, start + 1, len(labels))) is not None and start < epochs:
        (w, g2, history), start = found, start + 1
    for epoch in range(start, epochs + 1):  # the last round only scores the last weights
        gradient, sums = _epoch(features, w)
        (loss, _, n), (held_loss, hits, n_held) = map(tuple, sums.tolist())
        history = [*history[:epoch], (epoch, loss / max(n, 1.0), held_loss / max(n_held, 1.0), hits / max(n_held, 1.0))]
        if epoch < epochs:
            gradient /= max(n, 1.0)
            g2 = g2 + gradient * gradient
            w = w - rate * min(1.0, (epoch + 1) / max(warmup, 1)) * gradient / np.sqrt(g2 + 1e-12)
            _save(spark, state, epoch + 1, w, g2, history)
    chosen = min(history, key=lambda h: (-h[3], h[2], h[0]))[0]
    weights = first if chosen == 0 else _load(spark, state, chosen, len(labels))[0]
    return SoftmaxModel(labels, weights, history, chosen)


def score_softmax(df: DataFrame, model: SoftmaxModel, key: str, text: str, out: str = "predicted", carry=()) -> DataFrame:
    """MOD-3: ``(key, *carry, out)``, one row for every row of ``df``: the label
    with the highest score (the first of ties). Rows are scored where they are read."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.labels, model.weights))
    buckets = model.weights.shape[1] - 1
    kept = df.select(F.col(key), *carry)
    kind = df.schema  # the label's own type is that of Python's values: strings, whole numbers, ...
    label_type = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}[type(model.labels[0])]

    def task(batches):
        labels, w = shared.value
        labels = pa.array(labels)
        for b in batches:
            flat, ends = _lists(b.column(b.num_columns - 1))
            for i, j in _parts(ends):
                at, some = _distinct(flat[ends[i]:ends[j]], ends[i:j + 1] - ends[i], buckets)
                best = pa.array(_scores(w, at, some).argmax(axis=1))
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in b.columns[:-1]], labels.take(best)],
                                                 names=[*b.schema.names[:-1], out])

    schema = T.StructType([*[kind[c] for c in kept.columns], T.StructField(out, label_type)])
    return df.select(key, *carry, _hashed(text, buckets).alias("_hashed")).mapInArrow(task, schema)

"""Quality classifier on supervised subword embeddings.

Words, the character n-grams inside them (with word ends marked) and pairs of
a word with itself are hashed to rows of one learned table; a document is the average of its
vectors, and a softmax layer turns the average into class probabilities.
Table and layer are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled documents.

After training, the difference of the two classes' logits is linear in the
average, so each table row has one number (its vector times the difference of
the layer's rows), and a document's score is the sigmoid of the mean of those
numbers plus a constant: the same softmax, without the vectors. Scoring runs
over every whole text in Arrow batches.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, name_free, prepare
from intentspark.llm.toxicity import fold_of, training_sample
from intentspark.sources.tables import read_table

BUCKETS = 1 << 17
WIDTH = 8
NGRAMS = (2, 3, 4)
SAMPLE_DOCS = 4000  # labelled documents that the model is fitted on, at most
SAMPLE_CHARS = 100_000  # a longer text is not used for fitting (it is scored whole)
EPOCHS = 6
RATE = 0.2
SCALE = 50.0
SEED = 20240917
THRESHOLD = 0.3
CACHED_WORDS = 400_000
FOLDS = 5


def features(word: bytes) -> np.ndarray:
    """Hash buckets of a word and its n-grams (bytes, the ends marked by < and >)."""
    marked = b"<" + word + b">"
    grams = [marked[i:i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    hashed = [xxhash.xxh3_64_intdigest(marked, seed=1), *map(xxhash.xxh3_64_intdigest, grams)]
    return np.array(hashed, np.uint64) % np.uint64(BUCKETS)


def repeats(words: list) -> int:
    """Word pairs of a word with itself; all such pairs share the bucket 0."""
    return sum(map(eq, words, islice(words, 1, None)))


def bag(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share) of a text: the shares of its buckets add up to 1."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    for w in words:
        if w not in cache:
            cache[w] = features(w)
    parts = [cache[w] for w in words]
    parts.append(np.zeros(repeats(words), np.uint64))
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return found.astype(np.int64), n / n.sum()


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple:
    """(number by bucket, constant) of the trained softmax's logit difference.

    Gradient descent one document at a time, the rate falling to 0 linearly.
    A bucket's step is its share of the document times SCALE, at most 1, as
    shares are small in long texts.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, const = rng.normal(0, 0.1, (2, WIDTH)), np.zeros(2)
    cache: dict = {}
    bags = [bag(t, cache) for t in texts]
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            found, part = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(found):
                continue
            vectors = table[found]
            mean = part @ vectors
            z = layer @ mean + const
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= lr * np.outer(p, mean)
            const -= lr * 0.1 * p
            table[found] = vectors - lr * np.outer(np.minimum(part * SCALE, 1.0), back)
    values = table @ (layer[1] - layer[0])
    return values.astype(np.float32), float(const[1] - const[0])


class Scorer:
    """Scores texts with a model; keeps (sum, features) of words it has met."""

    def __init__(self, values: np.ndarray, const: float) -> None:
        self.values, self.const, self.words = values.astype(np.float64), const, {}

    def score(self, text: str | None) -> float:
        """A text without words (null and empty too) has the mean 0 of no vector: the constant alone decides."""
        words = text.encode().split() if text else []
        known, values = self.words, self.values
        total, n = 0.0, 0
        for w in words:
            v = known.get(w)
            if v is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                f = features(w)
                v = known[w] = (float(values[f].sum()), len(f))
            total += v[0]
            n += v[1]
        if again := repeats(words):
            total += again * float(values[0])
            n += again
        z = self.const + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def score_documents(docs: DataFrame, model: tuple, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with ``out`` (0 to 1, higher: better), row by row, without a
    shuffle. Other columns are kept, one called ``out`` is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # half a megabyte, whatever the input
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    src = docs.select(*rest, docs[text].alias(name_free(docs, "__text")))

    def run(batches):
        scorer = Scorer(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                got = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], [*rest, out])

    kept = docs.select(*rest).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), f"`{out}` double"])
    return src.mapInArrow(run, schema)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold=None) -> tuple:
    """A model from the documents' labels."""
    rows = training_sample(docs, labels, "quality", F.lit(True) if fold is None else fold, SAMPLE_DOCS, SAMPLE_CHARS)
    return train([t for t, _ in rows], [y for _, y in rows])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fitted outside fold 0 of 5, scored on all documents."""
    docs = documents(spark, sf_dir)
    held = fold_of(F.col("doc_id"), FOLDS) == 0
    model = fit(spark, docs, read_table(spark, sf_dir, "labels"), ~held)
    out = score_documents(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

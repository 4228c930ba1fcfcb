"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence has
the probability p = sigmoid(b + sum of the weights of its features); a
document has 1 - prod(1 - p), the noisy-or of its sentences. The weights are
trained from document labels alone by stochastic gradient steps (Adagrad) on
the log-likelihood, in numpy, on a bounded sample of labelled documents; the
gradient of a bag reaches its sentences in the share they have in the
noisy-or, so the weight settles on the sentences that make a document toxic.
Scoring then runs over every sentence of every whole text in Arrow batches,
and the sentences with p of at least ``SENTENCE_THRESHOLD`` are located.

Features of a word: itself in lower case, and its first four to eight
characters, as 64-bit hashes. Weights are kept at 0 or above: a word can be
evidence of toxicity or none, so that a long clean remainder never hides an
offending word. The model holds the features with a weight only, which are
no more than the sample's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import MASK64, documents, name_free, prepare
from intentspark.sources.tables import read_table

PREFIXES = (4, 5, 6, 7, 8)
SAMPLE_DOCS = 5000  # labelled documents that the model is fitted on, at most
SAMPLE_CHARS = 100_000  # a longer text is not used for fitting (it is scored whole)
UPDATES = 1000  # batches that the fit takes, whatever the sample's size
BATCH = 64
RATE = 1.0
START_BIAS = -3.0
SEED = 20240917
LEAST = 0.01  # smaller weights are left out
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
CACHED_WORDS = 400_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_TOKEN = re.compile(r"[^\W_]+")


def sentences(text: str):
    """(start, end) of the sentences: they end after . ! ? or before a newline."""
    return ((m.start(), m.end()) for m in _SENTENCE.finditer(text))


def features(word: str) -> list[int]:
    """Hashes of a lower-case word and its prefixes."""
    keys = [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(k) for k in keys]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, sentence of each) of a text; a word counts once a sentence."""
    feats, owner, n = [], [], 0
    for a, b in sentences(text):
        found = [f for w in set(_TOKEN.findall(text[a:b].lower())) for f in features(w)]
        if found:
            feats.extend(found)
            owner.extend([n] * len(found))
            n += 1
    return np.array(feats, np.uint64), np.array(owner, np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: list[int], updates: int = UPDATES, rate: float = RATE, seed: int = SEED) -> tuple:
    """({feature: weight}, bias) by Adagrad steps on batches of documents.

    Features that only one document of the sample has get no weight.
    """
    bags = [bag(t) for t in texts]
    y = np.array(labels, np.float64)
    every, seen = np.unique(np.concatenate([np.unique(f) for f, _ in bags] or [np.empty(0, np.uint64)]),
                            return_counts=True)
    kept = every[seen > 1]

    def placed(f, o):
        at = np.minimum(np.searchsorted(kept, f), max(len(kept) - 1, 0))
        ok = kept[at] == f if len(kept) else np.zeros(len(f), bool)
        return at[ok], o[ok], int(o[-1]) + 1 if len(o) else 0

    bags = [placed(f, o) for f, o in bags]
    w, g2 = np.zeros(len(kept)), np.full(len(kept), 1e-3)
    b, b2 = START_BIAS, 1.0
    rng = np.random.default_rng(seed)
    for _ in range(-(-updates * BATCH // max(len(bags), 1)) if len(kept) else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = [i for i in order[at:at + BATCH] if bags[i][2]]
            if not part:
                continue
            sizes = np.array([bags[i][2] for i in part])
            first = np.cumsum(sizes) - sizes
            feats = np.concatenate([bags[i][0] for i in part])
            owner = np.concatenate([bags[i][1] + k for i, k in zip(part, first)])
            p = _sigmoid(b + np.bincount(owner, weights=w[feats], minlength=int(sizes.sum())))
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first))  # no sentence is toxic
            # slope of the log-likelihood by each sentence's z
            slope = p * np.repeat(np.where(y[part] > 0, none / np.maximum(1 - none, 1e-9), -1.0), sizes)
            grad = np.bincount(feats, weights=slope[owner], minlength=len(kept))
            g2 += grad * grad
            w = np.maximum(w + rate * grad / np.sqrt(g2), 0.0)
            step = float(slope.sum())
            b2 += step * step
            b += rate * step / np.sqrt(b2)
    held = w > LEAST
    return dict(zip(kept[held].tolist(), w[held].tolist())), float(b)


class Scorer:
    """Scores texts with a model; keeps the weights of words it has met."""

    def __init__(self, weights: dict, bias: float) -> None:
        self.weights, self.bias, self.words = weights, bias, {}

    def _word(self, word: str) -> float:
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        value = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def score(self, text: str | None, threshold: float) -> tuple[float, int, list]:
        """(noisy-or, sentences, [(start, end, p)] of sentences at or above the threshold).

        A text without a word (null and empty too) has no sentence and scores 0.
        A sentence without a weighted word has p = 0, not the bias alone, so that
        no number of them adds up to a toxic text.
        """
        if not text:
            return 0.0, 0, []
        known, word = self.words, self._word
        spans, sums = [], []
        for a, b in sentences(text):
            found = set(_TOKEN.findall(text[a:b].lower()))
            if found:
                total = 0.0
                for x in sorted(found):  # a fixed order, so that equal texts have equal scores
                    v = known.get(x)
                    total += word(x) if v is None else v
                sums.append(total)
                spans.append((a, b))
        if not sums:
            return 0.0, 0, []
        sums = np.array(sums)
        p = np.where(sums > 0, _sigmoid(self.bias + sums), 0.0)
        score = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
        return float(score), len(sums), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= threshold)]


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, fold, limit: int = SAMPLE_DOCS,
                chars: int = SAMPLE_CHARS, seed: int = SEED, halves: bool = False) -> DataFrame:
    """(_h, doc_id, text, _y) of at most ``limit`` labelled documents, in the
    order of (_h, doc_id); ``halves``: at most half of them with either label.

    The ids come first, from the labels alone, by a seeded hash; only the
    texts of that bounded set are then read. A doc_id labelled twice counts
    with its highest label. ``fold`` is a condition on doc_id.
    """
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & fold)
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
           .withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))))
    if halves:
        ids = (ids.filter("_y = 1").orderBy("_h", "doc_id").limit(limit // 2)
               .unionAll(ids.filter("_y = 0").orderBy("_h", "doc_id").limit(limit - limit // 2)))
    else:
        ids = ids.orderBy("_h", "doc_id").limit(limit)
    return (docs.select("doc_id", "text").filter(F.length("text") <= chars)
            .join(F.broadcast(ids), "doc_id")  # at most ``limit`` rows of three numbers
            .dropDuplicates(["doc_id"]).orderBy("_h", "doc_id").limit(limit).select("_h", "doc_id", "text", "_y"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold, limit: int = SAMPLE_DOCS,
                    chars: int = SAMPLE_CHARS) -> list:
    """(text, label) of :func:`sample_rows`, in their order."""
    got = sample_rows(docs, labels, label, fold, limit, chars).select("text", "_y").toPandas()
    return list(zip(got["text"], got["_y"].astype(int)))


def fold_of(doc_id, parts: int):
    """crc32 of the id's decimal text modulo ``parts``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def score_documents(docs: DataFrame, model: tuple, text: str = "text",
                    sentence_threshold: float = SENTENCE_THRESHOLD) -> DataFrame:
    """``docs`` with tox_score (double), tox_sentences (int) and tox_spans
    (string, start:end:p of the offending sentences in code points, by start).

    Row by row: no shuffle. Null and empty texts score 0. Columns of these
    three names are replaced, all others are kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    new = ("tox_score", "tox_sentences", "tox_spans")
    rest = [c for c in docs.columns if c.lower() not in new]
    src = docs.select(*rest, docs[text].alias(name_free(docs, "__text")))

    def run(batches):
        scorer = Scorer(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                got = [scorer.score(t, sentence_threshold) for t in batch.column(batch.num_columns - 1).to_pylist()]
                spans = [",".join(f"{a}:{b}:{p:.4f}" for a, b, p in found) for _, _, found in got]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([s for s, _, _ in got], pa.float64()),
                     pa.array([n for _, n, _ in got], pa.int32()), pa.array(spans, pa.string())], [*rest, *new])

    kept = docs.select(*rest).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields),
                        "tox_score double", "tox_sentences int", "tox_spans string"])
    return src.mapInArrow(run, schema)


def _train_task(batches):
    """The sample's rows to (feature, weight); the bias comes with a null feature."""
    import pandas as pd
    rows = sorted((r for pdf in batches for r in pdf.itertuples(index=False, name=None)), key=lambda r: r[:2])
    weights, bias = train([r[2] for r in rows], [int(r[3]) for r in rows])
    keys = np.array(list(weights), np.uint64).view(np.int64)
    yield pd.DataFrame({"feature": pd.array([*keys.tolist(), None], "Int64"), "weight": [*weights.values(), bias]})


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold=None) -> tuple:
    """A model from the documents' labels. Without a labelled document it scores all alike, near 0.

    The bounded sample is trained on in one task, so its texts never reach the
    driver; a lost executor's task runs again and gives the same weights.
    """
    prepare(spark)
    sample = sample_rows(docs, labels, "toxic", F.lit(True) if fold is None else fold, halves=True)
    got = sample.mapInPandas(_train_task, "feature bigint, weight double").collect()  # bounded by the sample
    bias = next((r["weight"] for r in got if r["feature"] is None), START_BIAS)
    return {r["feature"] & MASK64: r["weight"] for r in got if r["feature"] is not None}, bias


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fitted outside fold 1 of 3, scored on all documents."""
    docs = documents(spark, sf_dir)
    held = fold_of(F.col("doc_id"), 3) == 1
    model = fit(spark, docs, read_table(spark, sf_dir, "labels"), ~held)
    out = score_documents(docs.select("doc_id", "text", held.alias("held_out")).select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("tox_score").alias("score"),
                      (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.col("tox_sentences").alias("n_sentences"), F.col("tox_spans").alias("offending"))

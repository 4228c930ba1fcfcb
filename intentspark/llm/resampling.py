"""Importance resampling towards a target distribution, over a head-tail vocabulary.

A text's features are its words (and runs of up to ``runs`` words), each hashed
to the CRC-32 of its bytes modulo a number of buckets. A bucket's gain is the
log of its smoothed share in the target over that in the documents; a document
weighs the mean gain of its features, and the documents of the highest weight
plus keyed Gumbel noise are drawn (sampling without replacement in proportion
to the weights).

* Head: the frequent words and pairs of neighbours, from mergeable summaries of
  bounded size that each task makes of its texts. Their exact CRC states are
  broadcast: at most ``HEAD`` words and as many pairs, of at most ``HEAD_BYTES``
  bytes a word.
* Tail: any other word's CRC is taken directly, any other run's by carrying on
  from the state of the run before its last word.

Both give the same bucket, so what is in the head changes the time taken and
never a result: bucket totals are exact counts over all texts, added up in each
task, then over tasks (one row a task and bucket).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, prepare, with_index, written
from intentspark.sources.tables import read_table

BUCKETS = 10_000
#: Words in the longest run that is a feature.
RUNS = 1
#: Documents of fewer words are not drawn; of the others, this share is.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

HEAD = 16_384
HEAD_BYTES = 64
#: Bytes of a text taken at once.
SEGMENT = 1 << 20

#: Bytes of a text as bytes of words: A-Z lowered, ASCII but letters and digits to spaces.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
               for c in range(256))


def word_lists(text: bytes | None, segment: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``segment`` bytes."""
    data, at = (text or b"").translate(_PLAIN), 0
    while at < len(data):
        end = data.find(b" ", at + segment)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class WordStates(dict):
    """CRC-32 by word: from the head, else taken directly."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class PairStates(dict):
    """CRC-32 by (word, next word): from the head, else carried on from the first word's state."""

    def __init__(self, words: WordStates, head: dict):
        super().__init__(head)
        self.words = words

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.words[pair[0]])


class Vocabulary:
    """The states of features, from the head's (word, next word or None) and their CRC states."""

    def __init__(self, head: dict):
        self.words = WordStates({a: crc for (a, b), crc in head.items() if b is None})
        self.pairs = PairStates(self.words, {k: crc for k, crc in head.items() if k[1] is not None})

    def states(self, words: list[bytes], before: list[bytes], runs: int) -> list[int]:
        """CRC states of all runs that end in ``words``; ``before`` are the words ahead of them, at least runs - 1
        unless the text begins."""
        every, skip = before + words, len(before)
        state = list(map(self.words.__getitem__, every))
        found = state[skip:]
        for n in range(2, runs + 1):
            if n == 2:
                state = list(map(self.pairs.__getitem__, zip(every, every[1:])))
            else:
                state = [zlib.crc32(b" " + w, s) for s, w in zip(state, every[n - 1:])]
            found += state[max(skip - n + 1, 0):]
        return found

    def of_text(self, text: bytes | None, runs: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, states of the features) for each segment of a text."""
        before: list[bytes] = []
        for words in word_lists(text):
            found = self.states(words, before, runs)
            yield len(words), np.fromiter(found, np.uint32, len(found))
            before = (before + words)[-(runs - 1):] if runs > 1 else []


def trimmed(counts: Counter, most: int) -> Counter:
    """A summary of at most ``most`` keys: the next largest count comes off all
    of them (any key with more than one part in ``most`` of the total stays)."""
    if len(counts) <= most:
        return counts
    cut = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -most - 1)[-most - 1]
    return Counter({k: n - int(cut) for k, n in counts.items() if n > cut})


def frequent(texts: DataFrame, runs: int, most: int) -> dict:
    """{(word, next word or None): CRC state} of the head: at most ``most`` words and as many pairs."""

    def task(batches):
        sums = [Counter(), Counter()]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                last: list[bytes] = []
                for words in word_lists(text):
                    sums[0].update(words)
                    if runs > 1:
                        sums[1].update(zip(last + words, (last + words)[1:]))
                        last = words[-1:] or last
                    sums = [trimmed(c, 4 * most) if len(c) > 16 * most else c for c in sums]
        words, pairs = (trimmed(c, most) for c in sums)
        rows = [(w, None, n) for w, n in words.items() if len(w) <= HEAD_BYTES]
        rows += [(a, b, n) for (a, b), n in pairs.items() if max(len(a), len(b)) <= HEAD_BYTES]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))],
                                             names=["word", "next", "n"])

    total = (texts.mapInArrow(task, "word binary, next binary, n bigint")
             .groupBy("word", "next").agg(F.sum("n").alias("n")))
    head = {}
    for side in ("next is null", "next is not null")[:min(runs, 2)]:
        for w, x, _ in total.filter(side).orderBy(F.desc("n"), "word", "next").limit(most).collect():
            w, x = bytes(w), None if x is None else bytes(x)
            head[w, x] = zlib.crc32(w if x is None else w + b" " + x)
    return head


def bucket_totals(texts: DataFrame, head: Broadcast, runs: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all texts."""

    def task(batches):
        vocabulary, total = Vocabulary(head.value), np.zeros(buckets, np.int64)
        for batch in batches:
            pending, size = [], 0
            for text in batch.column(0).to_pylist():
                for _, states in vocabulary.of_text(text, runs):
                    pending.append(states % np.uint32(buckets))
                    size += len(states)
                    if size > SEGMENT:
                        total += np.bincount(np.concatenate(pending), minlength=buckets)
                        pending, size = [], 0
            if pending:
                total += np.bincount(np.concatenate(pending), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(task, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)  # at most one row a bucket
    for bucket, n in rows:
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's share in the target over that in the source, smoothed by one."""
    size = len(source)
    s_all, t_all = int(source.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", keep: tuple[str, ...] = (),
          runs: int = RUNS, buckets: int = BUCKETS, head_size: int = HEAD) -> DataFrame:
    """(kept, n_words, n_features, weight) of every document: ``kept`` is a
    struct of the columns ``keep``, weight the floored mean gain of the features."""
    if runs < 1 or not 1 <= buckets <= 1 << 20:
        raise ValueError("runs is 1 or more, buckets at most 2**20")
    spark = docs.sparkSession
    prepare(spark)
    here, there = (d.select(F.col(c).cast("binary").alias("text")) for d, c in ((docs, text), (target, target_text)))
    head = spark.sparkContext.broadcast(frequent(here.unionByName(there), runs, head_size))
    by_bucket = gains(bucket_totals(here, head, runs, buckets), bucket_totals(there, head, runs, buckets))
    table = spark.sparkContext.broadcast(by_bucket)  # 8 bytes a bucket

    def task(batches):
        vocabulary, gain = Vocabulary(head.value), table.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n = features = total = 0
                for words, states in vocabulary.of_text(text, runs):
                    n, features = n + words, features + len(states)
                    total += int(gain[states % np.uint32(buckets)].sum())
                out.append((n, features, total // features if features else 0))
            rest = [pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=["kept", "n_words", "n_features", "weight"])

    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(kept.alias("kept"), F.col(text).cast("binary").alias("text"))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint"
    return rows.mapInArrow(task, schema)


def gumbel(key, seed: int):
    """Thousandths of Gumbel noise from a key's text: 32 bits of its hash as a uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, keep: tuple[str, ...] = (),
             runs: int = RUNS, buckets: int = BUCKETS, head_size: int = HEAD) -> DataFrame:
    """Every document's (key, n_features, weight, score, rank), and ``kept``, a
    struct of the columns ``keep``, if any are named.

    Of the N documents with at least ``least_words`` words, floor(percent * N /
    100) are drawn: the highest scores, ties to smaller keys. Their rank counts
    from 1; it is null for the others.

    A null text has no words and weight 0. A null key hashes as an empty one and
    comes last among ties. Repeated rows are rows of their own, drawn or not
    each for itself (which of wholly equal ones is left open). Texts of any
    length are taken whole, in segments. An empty table of documents gives no
    rows, an empty target counts no features. Other columns are ignored, so
    their names clash with nothing.
    """
    weighed = weigh(docs, target, text, target_text, (key, *keep), runs, buckets, head_size)
    kept = F.col("kept")
    # a row's number settles ties between equal rows; it is written, so that reruns of a task agree
    scored = written(weighed.select(
        kept.getField(key).alias("key"), F.struct(*[kept.getField(c).alias(c) for c in keep]).alias("kept") if keep else
        F.lit(None).cast("int").alias("kept"), "n_features", "weight", (F.col("n_words") >= least_words).alias("able"),
        (F.col("weight") + gumbel(kept.getField(key), seed)).alias("score"),
        F.monotonically_increasing_id().alias("row")), "scored")
    drawn = scored.filter("able").count() * percent // 100
    ranked = with_index(scored, [F.desc("able"), F.desc("score"), F.asc_nulls_last("key"), F.asc("row")], "index")
    out = ranked.select(F.col("key").alias(key), "n_features", "weight", "score",
                        F.when(F.col("index") < drawn, F.col("index") + 1).alias("rank"), "kept")
    return out if keep else out.drop("kept")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the texts of ``benchmark``; a tenth is drawn."""
    return resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: the table's 256 entries by eight shifts each, then a fold over each distinct word's bytes.
OP13_SQL = r"""
WITH poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
texts AS (
  SELECT row, false AS target, text FROM docs UNION ALL SELECT NULL, true, text FROM benchmark),
words AS (
  SELECT row, target, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
crc AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda i:
      ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), poly),
totals AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t
  FROM words JOIN crc USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM totals),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM totals, sums),
weights AS (
  SELECT row, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN crc USING (word) JOIN gain USING (bucket) WHERE NOT target GROUP BY row),
scored AS (
  SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""

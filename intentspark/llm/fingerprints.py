"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text: h = 2 h + G[byte], so that its low
k bits depend on the last k bytes only. A chunk ends where the hash meets a
mask; chunking is normalised: up to the wanted size a stricter mask holds,
beyond it a looser one, which keeps most chunks near that size. An edit moves
the boundaries next to it and no others. The fingerprint is the set of chunk
digests with their lengths; the containment of one text in another is the
share of its distinct chunks, by length, that the other has.

The hash of all positions comes from log2(width) shifted additions in numpy;
only the walk from boundary to boundary is a loop, one step a chunk.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, name_free, prepare, shuffle_partitions

MIN_SIZE, SIZE, MAX_SIZE = 16, 48, 192  # bytes
STRICT_BITS, LOOSE_BITS = 7, 4  # two bits stricter, one looser than log2(SIZE)
WINDOW = 16  # bytes that the hash depends on: the masks use its low 16 bits
PIECE = 1 << 22  # bytes hashed at a time
BUCKETS_PER_PARTITION = 1
_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=0x67656172) & 0xFFFFFFFF for b in range(256)], np.uint32)
# the masks test the hash's highest bits within the window, which most bytes of it reach
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (WINDOW - STRICT_BITS))
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (WINDOW - LOOSE_BITS))


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte; its low 16 bits are those of the running form."""
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, 2 * reach
    return h


def _boundaries(data: np.ndarray) -> tuple[list, list]:
    """Positions after which the strict and the loose mask allow a cut."""
    strict, loose = [], []
    for at in range(0, len(data), PIECE):
        lead = min(at, WINDOW)
        h = gear(data[at - lead:at + PIECE])[lead:]
        hit = np.flatnonzero((h & _LOOSE) == 0)
        loose.append(hit + at + 1)
        strict.append(hit[(h[hit] & _STRICT) == 0] + at + 1)
    return (np.concatenate(strict).tolist(), np.concatenate(loose).tolist()) if strict else ([], [])


def chunks(data: bytes) -> list[bytes]:
    """Consecutive chunks of ``data``; only the last may be shorter than MIN_SIZE."""
    n = len(data)
    strict, loose = _boundaries(np.frombuffer(data, np.uint8))
    out, at = [], 0
    n_strict, n_loose = len(strict), len(loose)
    while at < n:
        end = min(at + MAX_SIZE, n)
        i = bisect_left(strict, at + MIN_SIZE)
        if i < n_strict and strict[i] < at + SIZE:
            end = min(strict[i], n)
        else:
            i = bisect_left(loose, at + SIZE)
            if i < n_loose and loose[i] < end:
                end = loose[i]
        out.append(data[at:end])
        at = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Digest -> bytes of each distinct chunk, in the order of the text."""
    return {xxhash.xxh3_64_intdigest(c): len(c) for c in chunks(text.encode())}


def written_out(print_: dict[int, int]) -> str:
    """digest-length pairs by digest, so equal sets are equal strings."""
    return " ".join(f"{d:016x}-{n:x}" for d, n in sorted(print_.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's chunks, by length, that b has too; an empty text is in every text."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / total


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` (code points, rounded down) replaced by as
    many from the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _row(doc, text: str, following: str, mine: dict, other: dict) -> tuple:
    changed = edited(text, following)
    its = fingerprint(changed)
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), written_out(mine), written_out(its),
            containment(mine, its), containment(mine, other))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64())])
_DDL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _pairs_in_order(batches):
    """Rows (bucket, ahead, doc_id, text) by bucket and id: each document is
    paired with the one behind it. The last row of a bucket is a copy of the
    next bucket's first document (``ahead``), which gives no row itself."""
    waiting = None  # (bucket, doc_id, text, fingerprint)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            rows = []
            for bucket, ahead, doc, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                text = text or ""
                if ahead and (waiting is None or waiting[0] != bucket):
                    continue  # a second copy, for a repeated id
                mine = fingerprint(text)
                if waiting is not None and waiting[0] == bucket:
                    rows.append(_row(waiting[1], waiting[2], text, waiting[3], mine))
                waiting = None if ahead else (bucket, doc, text, mine)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def with_following(docs: DataFrame) -> DataFrame:
    """The fingerprint table of ``docs`` (doc_id, text): each document against
    its edited text and against the next document by ascending doc_id.

    Documents go to buckets by ranges of doc_id whose bounds are ids of the
    table (quantiles), are sorted there and streamed through, so a task holds
    two texts at a time. The one text that a bucket needs from the next is
    sent to both. A null text counts as empty, null ids come first, repeated
    ids are neighbours in the order of their texts. With one document the
    next is the document itself; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = max(1, shuffle_partitions(spark) * BUCKETS_PER_PARTITION)
    docs = docs.select("doc_id", "text")
    ids = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n + 10000),
                   F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    if not ids[3]:
        return spark.createDataFrame([], _DDL)
    if ids[0] is None or ids[2]:
        low = None  # the first document has no id
    else:
        low = ids[0]
    # bounds[i] is the first id of bucket i + 1; as many numbers as partitions
    bounds = sorted({b for b in (ids[1] or []) if b != ids[0]}) if n > 1 else []
    cuts = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    last = len(bounds)

    @F.pandas_udf("array<struct<bucket:int,ahead:boolean>>")
    def places(doc_id: pd.Series) -> pd.Series:
        out = []
        limits = cuts.value
        missing = doc_id.isna().to_numpy()
        values = doc_id.fillna(0).astype("int64").to_numpy()
        bucket = np.where(missing, 0, np.searchsorted(limits, values, side="right"))
        starts = np.isin(values, limits) & ~missing
        for b, s, v, m in zip(bucket.tolist(), starts.tolist(), values.tolist(), missing.tolist()):
            here = [{"bucket": b, "ahead": False}]
            if s:
                here.append({"bucket": b - 1, "ahead": True})
            if (m and low is None) or (not m and low is not None and v == low):
                here.append({"bucket": last, "ahead": True})  # the first document follows the last
            out.append(here)
        return pd.Series(out)

    dealt = docs.select(F.explode(places("doc_id")).alias("_at"), "doc_id", "text")
    dealt = dealt.select("_at.bucket", "_at.ahead", "doc_id", "text")
    dealt = (dealt.repartition(n, "bucket")
             .sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    return dealt.mapInArrow(_pairs_in_order, _DDL)


def add_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of its texts (null: that of an empty text), row by row."""
    prepare(df.sparkSession)
    rest = [c for c in df.columns if c.lower() != out.lower()]
    src = df.select(*rest, df[text].alias(name_free(df, "_fp_text")))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = [written_out(fingerprint(t or "")) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string())], [*rest, out])

    kept = df.select(*rest).schema
    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields),
                                          f"`{out}` string"]))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return with_following(documents(spark, sf_dir))

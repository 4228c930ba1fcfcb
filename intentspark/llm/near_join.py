"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; a link is a pair of different sets
with a Jaccard similarity of 0.8 or more.

1. One pass over the texts makes, for each document, the digest of its
   shingle set and its MinHash bands. Documents with the same set are copies
   and go on as one set with a weight.
2. Sets that share a band are candidates. Within a band's bucket each set goes
   with the bucket's smallest one, its hub. A set and its hubs (one a band at
   most) are tied to the smallest of these hubs, so ties are few however large
   a bucket is; the connected components of the ties hold every candidate pair.
3. A component is cut into blocks of about ``BLOCK`` sets, and a task gets two
   blocks (or one with itself), however large the component is. For the pairs
   in it MinHash values are compared sixteen at a time, and a pair is dropped
   once the posterior probability that its similarity reaches the threshold
   (uniform prior, binomial matches) is below ``TOLERANCE``. The pairs that
   are left are verified exactly on their shingles.
4. A task hands on one row a set: how many documents it is linked to, and the
   smallest set it is connected with. Copies and near copies are never
   written out as pairs. Connected components of these rows are the classes.

A pair of similarity 0.8 shares one of the 25 bands of five with a
probability of 0.99995, one of 0.85 with 0.9999999, and pairs of a component
are compared whether they share a band or not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, mix64, prepare, shuffle_partitions, window_hashes, word_hashes, written

WIDTH = 5
THRESHOLD = (4, 5)  # similarity as a fraction, compared in integers
BANDS, ROWS, HASHES = 25, 5, 128
STEP = 16  # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 128
SLAB = 4096
SEED = 20240917
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows; a text of one to four
    words is one shingle of all its words, a text without words (null too) has none."""
    words = word_hashes((text or "").encode())
    return np.unique(window_hashes(words, min(WIDTH, max(len(words), 1))))


def minhash(found: np.ndarray) -> np.ndarray:
    """HASHES 32-bit MinHash values of a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, (_MULTIPLIERS[:, None] * found[None, at:at + 1024]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(signature: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    rows = signature[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, k])
    return h.view(np.int64)


def posterior(matches: int, compared: int, threshold: float) -> float:
    """P[similarity >= threshold | matches of compared], uniform prior."""
    n = compared + 1
    return math.fsum(math.comb(n, j) * threshold ** j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(compared: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """The fewest matches with which a pair goes on."""
    return next((m for m in range(compared + 1) if posterior(m, compared, threshold) >= tolerance), compared)


_NEEDED = [(at + STEP, least_matches(at + STEP)) for at in range(0, HASHES, STEP)]


def linked_pairs(sets: list, signatures: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple:
    """The pairs (of the given ones) that reach the threshold."""
    num, den = THRESHOLD
    sizes = np.array([len(s) for s in sets], np.int64)
    small, large = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
    ok = den * small >= num * large  # else even a subset is not similar enough
    first, second = first[ok], second[ok]
    matches = np.zeros(len(first), np.int64)
    for upto, needed in _NEEDED:
        part = slice(upto - STEP, upto)
        matches = matches + (signatures[first, part] == signatures[second, part]).sum(axis=1)
        ok = matches >= needed
        first, second, matches = first[ok], second[ok], matches[ok]
    if not len(first):
        return first, second
    used = np.unique(np.concatenate([first, second]))
    place = np.full(len(sets), -1, np.int64)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set adds to no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(used), len(used)), np.float32)  # counts below 2^24 are exact
    for at in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(column, [at, at + SLAB])
        table = np.zeros((len(used), SLAB), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        both += table @ table.T
    common = both[place[first], place[second]].astype(np.int64)
    # common / (n1 + n2 - common) >= num / den
    ok = (num + den) * common >= num * (sizes[first] + sizes[second])
    return first[ok], second[ok]


def _lowest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The lowest index in the connected component of each of n."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, first, low[second])
        np.minimum.at(new, second, low[first])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _sketches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            digest, keys = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = shingles(text)
                digest.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                keys.append(bands(minhash(found)).tolist() if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(digest, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "set_id", "bands"])


def _members(batches):
    """Rows of representatives with their shingles and MinHash values instead of the text."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            found = [shingles(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([minhash(f).tobytes() for f in found], pa.binary()),
                 pa.array([f.tobytes() for f in found], pa.binary())],
                [*batch.schema.names[:-1], "signature", "shingles"])


def _join_group(key: tuple, rows: list) -> pa.RecordBatch:
    """One task: rows (node, block, copies, signature, shingles) of one or two blocks."""
    nodes = np.array([r[0] for r in rows], np.int64)
    _, only = np.unique(nodes, return_index=True)  # a repeated row of the input comes twice
    rows = [rows[i] for i in only]
    nodes = nodes[only]
    block = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    signatures = np.stack([np.frombuffer(r[3], np.uint32) for r in rows])
    if key[1] == key[2]:
        first, second = np.triu_indices(len(rows), 1)
    else:
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        first, second = np.repeat(left, len(right)), np.tile(right, len(left))
    first, second = linked_pairs(sets, signatures, first, second)
    n = len(rows)
    links = np.bincount(first, copies[second], n) + np.bincount(second, copies[first], n)
    low = nodes[_lowest(n, first, second)]
    has = links > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[has]), pa.array(links[has].astype(np.int64)), pa.array(low[has])], ["node", "links", "low"])


def _join_groups(batches):
    """Streams rows in the order of (component, left, right) and joins each group."""
    key, rows = None, []
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            for *k, node, block, copies, signature, found in zip(
                    *(c.to_pylist() for c in whole.slice(at, 256).columns)):
                if k != key:
                    if len(rows) > 1:
                        yield _join_group(key, rows)
                    key, rows = k, []
                rows.append((node, block, copies, signature, found))
    if len(rows) > 1:
        yield _join_group(key, rows)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b): the
    smallest node of its connected component.

    Each round takes the smallest label among the neighbours and then the
    label of the label, so long chains shrink fast; every round is a written
    table, and nothing but a count of changes reaches the driver.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), name)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name)
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")))
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hooked = written(hooked, name)
        up = hooked.select(F.col("node").alias("parent"), F.col("label").alias("over"))
        labels = written(hooked.join(up, hooked["label"] == up["parent"]).select("node", "old", F.col("over").alias("label")),
                         name)
        if not labels.filter("old <> label").head(1):
            return labels.select("node", "label")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, copy_of, n_copies, n_links, stays) for each row of ``docs`` (doc_id, text).

    ``doc_id``: any integer type, a long in the result. ``class_id``: the smallest doc_id of the documents connected by links or
    copies. ``copy_of``: the smallest doc_id with the same shingle set.
    ``n_links``: other documents linked with this one, copies included.
    ``stays``: whether the row is the one its class keeps (the smallest
    (doc_id, text_key); rows that repeat it wholly are all marked).

    A text without words, null too, has the empty set: such documents are
    copies of each other and linked to nothing else. A text of less than five
    words is one shingle. Null ids come after all others, and class_id is null
    if a class has no id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")
    sketch = written(texts.mapInArrow(_sketches, "doc_id bigint, text_key bigint, set_id string, bands array<bigint>"),
                     "near-sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    sets = written(sketch.groupBy("set_id").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                F.any_value("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()), "near-sets")
    # ties of each band's bucket to its smallest set
    rows = sets.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a set is tied to the smallest of its hubs, and so are its other hubs: what its bands connect stays
    # connected, and the hubs of a large group, few as they are, give few distinct ties
    tied = rows.join(hubs, "band").groupBy("node").agg(F.min("hub").alias("b"), F.collect_set("hub").alias("hubs"))
    ties = (tied.select("b", F.explode(F.array_union(F.array("node"), "hubs")).alias("a"))
            .filter("a <> b").select("a", "b").distinct())
    comps = components(ties, "near-ties")
    sizes = comps.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chosen = (comps.join(sizes, "label").join(sets.select("node", "rep", "copies"), "node")
              .select(F.coalesce(F.col("rep.doc_id").cast("string"), F.lit("null")).alias("kid"),
                      F.col("rep.text_key").alias("text_key"), "node", "label", "blocks", "copies",
                      F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
    named = texts.withColumn("kid", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    members = (named.join(chosen, ["kid", "text_key"]).select("label", "blocks", "node", "block", "copies", "text")
               .mapInArrow(_members, "label bigint, blocks int, node bigint, block int, copies bigint, "
                                     "signature binary, shingles binary"))
    dealt = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                     "node", "block", "copies", "signature", "shingles")
             .repartition(shuffle_partitions(spark), "label", "left", "right")
             .sortWithinPartitions("label", "left", "right"))
    found = written(dealt.mapInArrow(_join_groups, "node bigint, links bigint, low bigint"), "near-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")),
                        "near-classes")
    flat = sets.select("set_id", "node", "rep", "copies")
    labelled = written(flat.join(joined, "node", "left").join(links, "node", "left")
                       .withColumn("label", F.coalesce("label", "node")), "near-labels")
    heads = labelled.groupBy("label").agg(F.min("rep").alias("head"))
    classed = labelled.join(heads, "label").select("set_id", "rep", "copies", "links", "head")
    out = sketch.select("doc_id", "text_key", "set_id").join(classed, "set_id")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return out.select("doc_id", "text_key", F.col("head.doc_id").alias("class_id"), F.col("rep.doc_id").alias("copy_of"),
                      (F.col("copies") - 1).alias("n_copies"),
                      (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), is_head.alias("stays"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any more, of any names) with one document of each
    class. Rows that agree in doc_id and text are one document. An empty table
    gives an empty result."""
    kid = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    heads = near_classes(docs).filter("stays").select(kid.alias("kid"), F.col("text_key").alias("key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), kid.alias("kid"),
                        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    one = keyed.join(heads, ["kid", "key"], "left_semi").dropDuplicates(["kid", "key"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, its copies and its number of links."""
    out = near_classes(documents(spark, sf_dir))
    return out.select("doc_id", "class_id", "copy_of", "n_copies", "n_links")

"""Mixing sources to target weights by entropy balancing.

For each source the document rates r are the least change from rate 1 (in
relative entropy) whose words add up to the source's target:

    minimise  sum_d  r_d log r_d - r_d + 1
    subject to  sum_d r_d size_d = target,   0 <= r_d <= 2

The solution is an exponential tilt, r_d = min(2, exp(l * size_d / scale)),
with one dual variable l per source. The dual is convex and is solved by
Newton steps, kept inside a bracket that every step narrows; the sums of a
step run as one Spark aggregation over the table of (source, size, documents),
which is made once and is far smaller than the documents. Sums are taken in
decimals, so they do not depend on the order in which tasks end.

Rates then become whole copies: floor(r), plus one where the fractional part
beats a seeded hash by at least the source's margin. The margin is chosen by
two histograms of 4,096 bins a source so that the words taken come to the
target within the bin (2^-24 of the hash range) where it is crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import WORD, documents, shuffle_partitions, with_index, written
from intentspark.operators.sizing import fits_broadcast

SEED = 20240917
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
NEWTON_STEPS = 200  # a bracket is halved at least, so far fewer do
TOLERANCE = 1e-6
BINS = 4096
NUMBERED = 1 << 16  # equal rows numbered at once
_D = "decimal(38,12)"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from a table (source, size).

    Sources in code point order, null last, take ``weights`` in turn and
    share ``share`` of all words; a target above ``cap`` times its source's
    size stops there and the excess is shared by weight among the others,
    until none is above. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = with_index(per, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = written(per.select("source", "source_size", w.alias("weight")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    level, n_capped = 0.0, -1
    while True:  # every round caps at least one more source or ends
        r = per.withColumn("c", capped).agg(
            F.count_if("c").alias("n"), F.sum(F.when(F.col("c"), F.col("source_size"))).alias("s"),
            F.sum(F.when(~F.col("c"), F.col("weight"))).alias("w")).first()
        if r["n"] == n_capped or not r["w"]:
            break
        n_capped = r["n"]
        level = (share * total - cap * (r["s"] or 0)) / r["w"]
        capped = F.col("weight") * F.lit(float(level)) > F.col("source_size") * F.lit(float(cap))
    target = F.least(F.col("weight") * F.lit(float(level)), F.col("source_size") * F.lit(float(cap)))
    return per.select("source", "source_size", target.alias("target"))


def rate(lam, size, scale, cap: float = CAP):
    """The tilted rate; ``lam`` null stands for a source at its cap."""
    x = F.least(lam * size / scale, F.lit(30.0))
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.exp(x), F.lit(float(cap))))


def solve(cells: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lam, scale) by safeguarded Newton steps on the dual.

    ``cells``: (source, size, docs). A source whose target is its cap gets a
    null ``lam``; a source without words gets 0.
    """
    # sizes are divided by the source's mean size, so that lam is near 0 whatever the sizes
    stats = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"),
                                        F.sum("docs").alias("n"))
    on = F.col("t.source").eqNullSafe(F.col("s.source"))
    state = (targets.alias("t").join(stats.alias("s"), on)
             .select("t.source", "t.target", F.greatest(F.col("words") / F.col("n"), F.lit(1.0)).alias("scale"),
                     (F.col("target") >= F.col("words") * float(cap)).alias("full"), F.col("words"))
             .withColumn("lam", F.when(~F.col("full"), F.lit(0.0)))
             .withColumn("low", F.lit(-1e6)).withColumn("high", F.lit(1e6))
             .withColumn("done", F.col("full") | (F.col("words") == 0)))
    state = state.withColumn("lam", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.col("lam")))
    state = written(state, "mix-state")
    for taken in range(steps + 1):
        if not state.filter("not done").head(1):
            break
        if taken == steps:
            raise ValueError(f"a source is not at its target after {steps} steps")
        r = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        step = (cells.alias("c").join(state.filter("not done").alias("s"),
                                      F.col("c.source").eqNullSafe(F.col("s.source")))
                .select("s.*", "size", "docs").withColumn("r", r)
                .groupBy("source")
                .agg(F.sum((F.col("r") * F.col("size") * F.col("docs")).cast(_D)).alias("words_now"),
                     F.sum(F.when(F.col("r") < float(cap), F.col("r") * F.col("size") * F.col("size") * F.col("docs")
                                  / F.col("scale")).otherwise(0.0).cast(_D)).alias("slope")))
        g = F.col("words_now").cast("double") - F.col("target")
        low = F.when(g < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(g > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - g / F.col("slope").cast("double")
        # a step outside the bracket (or without slope) is replaced by a doubling or the middle
        middle = (F.when(high >= 1e6, F.greatest(low * 2, low + 1.0))
                  .when(low <= -1e6, F.least(high * 2, high - 1.0)).otherwise((low + high) / 2))
        new = F.when((F.col("slope") > 0) & (newton > low) & (newton < high)
                     & (F.abs(newton - F.col("lam")) <= 8.0 + F.abs(F.col("lam"))), newton).otherwise(middle)
        good = F.abs(g) <= F.col("target") * tolerance + 1e-9
        state = written(
            state.alias("t").join(step.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left")
            .select("t.*", "s.words_now", "s.slope")
            .select("source", "target", "scale", "full", "words",
                    F.when(F.col("done") | good, F.col("lam")).otherwise(F.round(new, 12)).alias("lam"),
                    F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                    F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                    (F.col("done") | good).alias("done")), "mix-state")
    return state.select("source", "lam", "scale")


def _crossing(rows: DataFrame, need: DataFrame, bin_col: str) -> DataFrame:
    """(source, bin, left): the first bin at which a source's running words
    reach ``left``, and what is still to take inside it. ``rows``: source,
    bin, size; at most ``BINS`` sums a source meet in one array."""
    sums = rows.groupBy("source", F.col(bin_col).alias("bin")).agg(F.sum("size").alias("w"))
    runs = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("bins"))
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("w"))

    def step(acc, x):
        # stands still once the sum has reached ``left``
        return F.when(acc["upto"] >= F.col("left"), acc).otherwise(F.struct(
            x["bin"].alias("bin"), (acc["upto"] + x["w"]).alias("upto"), x["w"].alias("w")))

    j = (runs.alias("b").join(need.select("source", "left").alias("n"),
                              F.col("b.source").eqNullSafe(F.col("n.source")))
         .select("b.source", "left", F.aggregate("bins", start, step).alias("m")))
    return (j.filter(F.col("m.upto") >= F.col("left"))
            .select("source", F.col("m.bin").alias("bin"),
                    (F.col("left") - (F.col("m.upto") - F.col("m.w"))).alias("left"), F.col("m.w").alias("w")))


def _small(per_source: DataFrame) -> DataFrame:
    """A table of one row a source, broadcast if it measures small: then a hot
    source is not one task's. Else the join shuffles and AQE splits it."""
    return F.broadcast(per_source) if fits_broadcast(per_source) else per_source


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` (row, source, key, size) with ``nth``, a text that tells rows of one
    key apart: a digest of the row's content, and a number among equal ones.

    Equal rows are counted (combined before the shuffle), and numbered again in
    blocks that are dealt over tasks, so that no task makes all copies of one."""
    n = shuffle_partitions(base.sparkSession)
    same = base.withColumn("_h", F.md5(F.to_json(F.struct("row")))).groupBy("key", "source", "size", "_h").agg(
        F.first("row").alias("row"), F.count(F.lit(1)).alias("_n"))
    blocks = same.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {NUMBERED})"))).repartition(n, "_h", "_block")
    first = F.col("_block") * NUMBERED
    return blocks.withColumn("_i", F.explode(F.sequence(first, F.least(first + NUMBERED, F.col("_n")) - 1))).select(
        "row", "source", "key", "size", F.concat(F.lit(":"), "_h", F.lit(":"), F.col("_i").cast("string")).alias("nth"))


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED,
        key: str = "doc_id", apart: bool = False) -> DataFrame:
    """``rows`` (``key``, source, size, any more) with source_size, target,
    rate and copies.

    A null source is a source of its own. A null or negative size counts as
    0; a document without words gets one copy, which takes nothing. Rows that
    repeat a key get the same hash and so the same number of copies when
    their sources and sizes agree, unless ``apart``: then rows that are equal in
    all columns are numbered, and each draws for itself (which of them takes
    which number is left open), so null and repeated keys meet their target too.
    An empty table gives an empty result.
    """
    clash = ("source_size", "target", "rate", "copies")
    kept = [c for c in rows.columns if c.lower() not in clash]
    base = rows.select(F.struct(*kept).alias("row"), F.col("source"), F.col(key).alias("key"),
                       F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    base = written(_numbered(base) if apart else base.withColumn("nth", F.lit("")), "mix-rows")
    cells = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-cells")
    targets = written(source_targets(cells.select("source", (F.col("size") * F.col("docs")).alias("size")),
                                     weights, share, cap), "mix-targets")
    lam = solve(cells, targets, cap)
    plan = written(targets.alias("t").join(lam.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")))
                   .select("t.*", "l.lam", "l.scale"), "mix-plan")
    # 48 bits of a seeded hash, uniform in [0, 1)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")), "nth")
    u = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(1 << 48)
    r = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
    rated = (base.alias("b").join(_small(plan).alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
             .select("b.row", "b.source", "b.size", "p.source_size", "p.target", r.alias("rate"), u.alias("u"))
             .withColumn("whole", F.floor("rate").cast("int"))
             # 0 is taken first, 1 last
             .withColumn("order", (F.col("u") - (F.col("rate") - F.col("whole")) + 1) / 2)
             .withColumn("bin1", F.least(F.floor(F.col("order") * BINS), F.lit(BINS - 1)).cast("int"))
             .withColumn("bin2", F.least(F.floor((F.col("order") * BINS - F.col("bin1")) * BINS),
                                         F.lit(BINS - 1)).cast("int")))
    rated = written(rated, "mix-rated")
    need = (rated.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("whole")).alias("w"))
            .select("source", (F.col("t") - F.col("w")).alias("left")).filter("left > 0"))
    open_ = rated.filter((F.col("whole") < cap) & (F.col("size") > 0))
    first = written(_crossing(open_, need, "bin1"), "mix-cut1")
    inside = (open_.alias("o").join(first.alias("f"), F.col("o.source").eqNullSafe(F.col("f.source"))
                                    & (F.col("o.bin1") == F.col("f.bin")))
              .select("o.source", "o.bin2", "o.size"))
    second = _crossing(inside, first, "bin2")
    cut = (need.alias("n").join(first.alias("f"), F.col("n.source").eqNullSafe(F.col("f.source")), "left")
           .join(second.alias("s"), F.col("n.source").eqNullSafe(F.col("s.source")), "left")
           .select("n.source", F.coalesce("f.bin", F.lit(BINS)).alias("c1"), F.coalesce("s.bin", F.lit(0)).alias("c2"),
                   # the last bin goes in if that comes nearer to the target
                   F.coalesce(F.col("s.left") * 2 >= F.col("s.w"), F.lit(False)).alias("last")))
    taken_too = F.coalesce(
        (F.col("whole") < cap) & ((F.col("bin1") < F.col("c1")) | ((F.col("bin1") == F.col("c1")) & (
            (F.col("bin2") < F.col("c2")) | ((F.col("bin2") == F.col("c2")) & F.col("last"))))), F.lit(False))
    out = (rated.alias("r").join(_small(written(cut, "mix-cut")).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left")
           .select("r.row", "r.size", "r.source_size", "r.target", "r.rate", "whole", taken_too.alias("more")))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.col("more").cast("int"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "source_size", "target", "rate",
                      copies.cast("int").alias("copies"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text, any more, of any names), each as often as
    the mix takes it; with 0 copies it goes.

    Ids may be null or repeated, so a row is known by its id, source and text;
    rows equal in all three share a number of copies. An empty table gives an
    empty result.
    """
    key = F.md5(F.to_json(F.struct("doc_id", "source", F.md5("text").alias("text"))))
    sized = docs.select(key.alias("key"), "source", word_count(F.col("text")).alias("size"))
    copies = mix(sized, key="key").select("key", "copies").dropDuplicates(["key"])
    times = F.expr("case when copies > 0 then sequence(1, copies) else cast(array() as array<int>) end")
    repeated = (docs.select(F.struct("*").alias("row"), key.alias("key")).join(copies, "key")
                .withColumn("copy", F.explode(times)))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the words each document gives to the mix."""
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(docs, apart=True)
    return out.select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "rate", "copies")

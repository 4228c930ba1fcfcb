"""Label resolution: generated text -> exactly one intent (RES-1..RES-7).

The cascade is one CASE expression over a lower-cased column that is
projected once; Catalyst keeps that projection (it is referenced by every
branch, so it is not re-inlined) and whole-stage codegen fuses the rest.
No join and no shuffle: resolution is a narrow, per-row map.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.functions.text import clean_generation, strip_ws
from intentspark.operators.sizing import ROW_OVERHEAD, broadcast_budget, fits_broadcast
from intentspark.session import stored

STAGES = ("prefix", "contains", "keyword", "default")


def sql_string(s: str) -> str:
    """A Spark SQL string literal for ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code_expr(lowered: str, categories, keywords: dict, default: str) -> Column:
    """First hit of prefix, then containment, then keyword rules, else default,
    as the stage's number times the number of categories plus the category's.

    Written as one SQL expression and parsed once in the JVM: the cascade has
    over a hundred predicates, and building it call by call from Python costs
    more than running it on a small table.
    """
    n = len(categories)
    col = f"`{lowered}`"
    whens = []
    for i, c in enumerate(categories):
        whens.append(f"WHEN startswith({col}, {sql_string(c.lower())}) THEN {i}")
    for i, c in enumerate(categories):
        whens.append(f"WHEN contains({col}, {sql_string(c.lower())}) THEN {n + i}")
    for i, cat in enumerate(categories):
        kws = keywords.get(cat, ())
        if kws:
            cond = " OR ".join(f"contains({col}, {sql_string(k)})" for k in kws)
            whens.append(f"WHEN {cond} THEN {2 * n + i}")
    dflt = 3 * n + list(categories).index(default)
    return F.expr("CASE " + " ".join(whens) + f" ELSE {dflt} END")


def resolve(df: DataFrame, generated: str = "generated", out: str = "Category",
            audit: bool = True, categories=domain.CATEGORIES,
            keywords=domain.KEYWORDS, default: str = domain.DEFAULT_CATEGORY) -> DataFrame:
    """RES-1..5 (+ RES-7 audit columns ``cleaned`` and ``resolved_by``).

    Null generated text behaves like empty text (cleans to '' -> default).
    """
    n = len(categories)
    cats = F.array(*[F.lit(c) for c in categories])
    stages = F.array(*[F.lit(s) for s in STAGES])
    out_df = (df
              .withColumn("cleaned", clean_generation(F.coalesce(F.col(generated), F.lit(""))))
              .withColumn("_lowered", F.lower(F.col("cleaned")))
              .withColumn("_code", _code_expr("_lowered", categories, keywords, default))
              .withColumn(out, F.element_at(cats, (F.col("_code") % n + 1).cast("int")))
              .withColumn("resolved_by", F.element_at(stages, (F.floor(F.col("_code") / n) + 1).cast("int")))
              .drop("_lowered", "_code"))
    if not audit:
        out_df = out_df.drop("cleaned", "resolved_by")
    return out_df


def resolve_api(df: DataFrame, generated: str = "generated", out: str = "Category",
                categories=domain.CATEGORIES, fallback: str = domain.API_FALLBACK) -> DataFrame:
    """RES-6: strip only, first category name contained (list order), else
    ``Unknown``. No newline/full-stop cut, no prefix stage, no keywords."""
    lowered = F.lower(strip_ws(F.coalesce(F.col(generated), F.lit(""))))
    df2 = df.withColumn("_lowered", lowered)
    chain = None
    for c in categories:
        cond = F.col("_lowered").contains(c.lower())
        chain = F.when(cond, F.lit(c)) if chain is None else chain.when(cond, F.lit(c))
    return df2.withColumn(out, chain.otherwise(F.lit(fallback))).drop("_lowered")


# -- keyword rules as a table (RES-4) ----------------------------------------

GRAM = 4  # characters of an index entry
CHUNK, PART, MARGIN = 4096, 128, 64  # characters of a text's pieces, of their parts, and beside those


def text_grams(texts: DataFrame, sizes: list[int], keep=()) -> DataFrame:
    """``(_tid, *keep, _part, _at, gram)`` of texts ``(_tid, _lowered)``: all
    substrings of the given sizes (and some shorter ones from the end), each with
    a part of the text that holds ``MARGIN`` characters on either side of it, and
    its place in that part.

    A long text is cut into pieces of ``CHUNK`` characters and those into parts
    of ``PART``, so that a substring is found near its part's start: the work is
    linear in the length of the text. The explodes of numbers compile, and what
    stands beside them is not copied."""
    cut = texts.select("_tid", *keep, F.when(F.length("_lowered") > CHUNK, F.regexp_extract_all(
        "_lowered", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array("_lowered")).alias("_cut"))
    lapped = F.transform("_cut", lambda c, i: F.struct(
        F.concat(F.when(i > 0, F.right(F.get("_cut", i - 1), F.lit(MARGIN))).otherwise(""), c,
                 F.coalesce(F.substring(F.get("_cut", i + 1), 1, MARGIN), F.lit(""))).alias("text"),
        F.when(i > 0, MARGIN).otherwise(0).alias("lead"), F.length(c).alias("core")))
    pieces = cut.select("_tid", *keep, F.explode(lapped).alias("_p")).select(
        "_tid", *keep, F.col("_p.text").alias("_text"), F.col("_p.lead").alias("_lead"), F.col("_p.core").alias("_core"))
    parts = pieces.select("*", F.explode(F.expr(f"sequence(0, greatest(_core - 1, 0) div {PART})")).alias("_i")) \
        .select("_tid", *keep, "_text", F.expr(f"least({PART}, _core - _i * {PART})").alias("_n"),
                F.expr(f"int(_lead + _i * {PART})").alias("_from")) \
        .select("_tid", *keep, "_n", F.expr(f"least(_from, {MARGIN})").alias("_before"),
                F.expr(f"substring(_text, greatest(_from - {MARGIN}, 0) + 1, least(_from, {MARGIN}) + {PART + MARGIN})").alias("_part"))
    places = parts.select("_tid", *keep, "_part", "_before", F.explode(F.expr("sequence(1, greatest(int(_n), 1))")).alias("_k")) \
        .select("_tid", *keep, "_part", F.expr("_before + _k").alias("_at"))
    places = places.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("_size")) if len(sizes) > 1 \
        else places.withColumn("_size", F.lit(sizes[0]))
    return places.select("_tid", *keep, "_part", "_at", F.expr("substring(_part, _at, _size)").alias("gram"))


class RuleIndex(NamedTuple):
    """``table``: ``(gram, off, keyword, ord, category)``, one row a keyword, with
    the gram of it that the fewest keywords hold, its place there (from 0) and
    the first rule that has the keyword. Grams have ``GRAM`` characters, or the whole of a shorter keyword; ``sizes``
    are those that occur. ``empty``: the first rule with the empty keyword,
    which every text contains. ``small``: the table may be broadcast."""

    table: DataFrame
    sizes: list[int]
    empty: tuple | None
    small: bool


def rule_index(rules: DataFrame) -> RuleIndex:
    """The index of a rule table ``(ord, category, keyword)``, stored in the
    shared folder. Rules without a keyword are left out."""
    first = (rules.filter(F.col("keyword").isNotNull()).groupBy("keyword")
             .agg(F.min(F.struct(F.col("ord").cast("long").alias("ord"), "category")).alias("_hit"))
             .select("keyword", "_hit.ord", "_hit.category"))
    size = F.least(F.length("keyword"), F.lit(GRAM))
    held = first.withColumn("_size", size).select("*", F.explode(F.expr("sequence(0, greatest(length(keyword) - _size, 0))")).alias("off")) \
        .select("keyword", "ord", "category", "off", F.expr("substring(keyword, off + 1, _size)").alias("gram"))
    shared = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    least = (held.join(shared, "gram").groupBy("keyword", "ord", "category")
             .agg(F.min(F.struct("_n", "gram", "off")).alias("_least"))
             .select("_least.gram", "_least.off", "keyword", "ord", "category"))
    table = stored(least, "rule-index")
    found = table.agg(F.collect_set(F.length("gram")).alias("sizes"), F.count(F.lit(1)).alias("rows"),
                      F.sum(F.octet_length("gram") + F.octet_length("keyword") + F.octet_length("category")).alias("bytes"),
                      F.min(F.when(F.col("keyword") == "", F.struct("ord", "category"))).alias("empty")).first()
    size = found["rows"] * (ROW_OVERHEAD + 40) + (found["bytes"] or 0)
    return RuleIndex(table, sorted(n for n in found["sizes"] if n), None if found["empty"] is None else tuple(found["empty"]),
                     size <= broadcast_budget(rules))


def keyword_hits(texts: DataFrame, index: RuleIndex) -> DataFrame:
    """``(_tid, _hit)``: the first rule whose keyword a text contains, for the
    texts ``(_tid, _lowered)`` that contain any.

    A keyword whose rarest gram is among a text's grams is a candidate. With a
    small index it is verified where the text is read, at its place beside the
    gram (a keyword of over ``MARGIN`` characters by ``contains``). Else only the
    texts' ids are shuffled by gram, and the candidates meet their texts by id
    and are verified by ``contains``.
    """
    rules = index.table.filter("keyword <> ''")
    holds = F.col("_lowered").contains(F.col("keyword"))
    if index.small:
        met = text_grams(texts, index.sizes, ("_lowered",)).join(F.broadcast(rules), "gram")
        here = F.expr("_at > off and substring(_part, _at - off, length(keyword)) = keyword")
        holds = F.when(F.length("keyword") <= MARGIN, here).otherwise(holds)
    else:
        met = text_grams(texts, index.sizes).join(rules, "gram").select("_tid", "keyword", "ord", "category").distinct() \
            .join(texts, "_tid")
    return (met.filter(holds)
            .groupBy("_tid").agg(F.min(F.struct("ord", "category")).alias("_hit")))


def resolve_with_rule_table(df: DataFrame, rules: DataFrame, generated: str = "generated", out: str = "Category",
                            categories=domain.CATEGORIES, default: str = domain.DEFAULT_CATEGORY) -> DataFrame:
    """RES-2..5 with the keyword stage driven by a rule table
    ``(ord, category, keyword)``: the lowest ``ord`` among rules whose keyword
    is contained in the cleaned text wins (the smallest category among rules of
    one ``ord``).

    One algorithm for any number of rules and categories: an inverted index of
    each keyword's rarest gram (:func:`rule_index`), met once per distinct
    cleaned text (:func:`keyword_hits`; the distinct is combined map-side, so a
    text repeated on a third of the rows is matched once). The hits go back to
    the rows by the text's digest, broadcast when measured small, else by a
    shuffle join that AQE splits at a hot text.
    """
    n = len(categories)
    stages = F.array(*[F.lit(s) for s in STAGES])
    base = (df
            .withColumn("cleaned", clean_generation(F.coalesce(F.col(generated), F.lit(""))))
            .withColumn("_lowered", F.lower(F.col("cleaned")))
            .withColumn("_tid", F.md5("_lowered")))
    index = rule_index(rules)
    if index.sizes:
        # no filter by the first two stages: it would be pushed below the cleaning and clean once for each of its predicates
        hits = stored(keyword_hits(base.select("_tid", "_lowered").distinct(), index), "rule-hits")
        flat = hits.select("_tid", F.col("_hit.ord").alias("_ord"), F.col("_hit.category").alias("_category"))
        joined = base.join(F.broadcast(flat) if fits_broadcast(flat) else flat, "_tid", "left")
        hit = F.when(F.col("_ord").isNotNull(), F.struct(F.col("_ord").alias("ord"), F.col("_category").alias("category")))
    else:
        joined, hit = base, F.lit(None).cast("struct<ord:bigint,category:string>")
    if index.empty is not None:
        always = F.struct(F.lit(index.empty[0]).cast("long").alias("ord"), F.lit(index.empty[1]).alias("category"))
        hit = F.least(hit, always)  # least() passes over null
    open_ = F.col("_code") >= 3 * n
    found = open_ & F.col("_found").isNotNull()
    return (joined.withColumn("_code", _code_expr("_lowered", categories, {}, default)).withColumn("_found", hit)
            .withColumn(out, F.when(found, F.col("_found.category")).when(open_, F.lit(default))
                        .otherwise(F.element_at(F.array(*[F.lit(c) for c in categories]), (F.col("_code") % n + 1).cast("int"))))
            .withColumn("resolved_by", F.element_at(stages, F.when(found, F.lit(3)).otherwise(
                (F.floor(F.col("_code") / n) + 1).cast("int"))))
            .select(*df.columns, "cleaned", out, "resolved_by"))

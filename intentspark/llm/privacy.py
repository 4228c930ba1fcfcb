"""Personal data, and terms that give it away; DataFrame functions only.

Base kinds are found by pattern in every whole text. Then, for each found
value (the protected entity c), the corpus tells how strongly the words t of
its documents reveal it: with N documents, n(c), n(t) and n(c, t) of them
holding c, t and both, and p(c) = n(c) / N,

    p(c|t) = (n(c,t) + PRIOR p(c)) / (n(t) + PRIOR)
    disclosure(c, t) = PMI(c; t) / IC(c) = log(p(c|t) / p(c)) / log(1 / p(c))

which nears 1 when t occurs with c only and is 0 when they are independent.
The prior weighs as much as ``PRIOR`` documents, so a value or a word seen
once counts, for less than one seen often. Terms whose disclosure of an entity
exceeds ``DISCLOSURE`` are spans of kind ``term`` in the documents that hold
the entity, wherever they stand. ``sanitised`` generalises base values to
their kind and removes terms.

Entities that occur in the same documents have the same terms, so pairs are
counted for sets of documents (told apart by 128 bits of their rows' hashes),
not for each of a document's values.

Spans are (start, end) in code points. A pattern's places come from the
lengths of its matches and of the text between them, both of which Spark's
regular expressions give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, name_free, written

DISCLOSURE = 0.9
PRIOR = 1.0  # documents that the independence of a term and an entity weighs
TERM_CHARS = 2  # shorter words are no terms

# Contract patterns, written so that no text makes them slow: a match can only
# begin where a run of its characters does (or where the last match ended), and
# runs are taken possessively where nothing that follows could need them back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match (a regular expression is far dearer).
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = (*PATTERNS, "term")
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,no:int,end:int,value:string>>"


def places(text: Column, pattern: Column, no: int) -> Column:
    """Leftmost, non-overlapping matches of ``pattern`` as an array of spans."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.arrays_zip(matches.alias("value"), gaps.alias("gap"))  # the last gap has no match
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), F.lit(no).alias("no"), end.alias("end"), x["value"].alias("value"))
        return F.when(F.isnull(x["value"]), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    return F.aggregate(pairs, start, step)["spans"]


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[ -]", ""))

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add)
    return n.between(14, 19) & (total % 10 == 0)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", ""))


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.when(F.length(v) >= 14, _luhn(v)).otherwise(False),
    "phone": lambda v: _digits(v).between(10, 15),
}


def _valid(kind: str):
    return lambda span: _VALID[kind](span["value"])


def of_kind(spans: Column, no: int) -> Column:
    """How many of the spans are of a kind (its place in KINDS)."""
    return F.size(F.filter(spans, lambda x: x["no"] == no)).cast("long")


def base_spans(text: Column) -> Column:
    """All valid base spans of a text, by start and then kind."""
    none = F.array().cast(_SPAN)
    parts = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        found = F.filter(places(text, F.lit(pattern), no), _valid(kind))
        need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        parts.append(F.when(need, found).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["no"]), x["start"].cast("string"), x["end"].cast("string"))))


def _terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) >= TERM_CHARS))


def _any_of(terms: Column) -> Column:
    """A pattern for any of the terms as a word. Terms are letters and digits
    only, so they stand as they are; those of one first character are tried
    together, for fewer trials a word."""
    firsts = F.array_distinct(F.transform(terms, lambda t: F.substring(t, 1, 1)))
    groups = F.transform(firsts, lambda c: F.concat(c, F.lit("(?:"), F.array_join(F.transform(
        F.filter(terms, lambda t: F.startswith(t, c)), lambda t: F.substring(t, F.lit(2), F.length(t))), "|"), F.lit(")")))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(groups, "|"), F.lit(r")(?![\p{L}\p{N}])"))


_SET = ("n_c", "set_a", "set_b")  # how many documents hold an entity, and which (hashed)


def _entity_sets(found: DataFrame) -> DataFrame:
    """(rid, _SET): the sets of documents of the entities that a document holds."""
    held = found.select("rid", F.explode(F.array_distinct(F.transform("spans", lambda x: F.concat_ws(
        ":", x["no"].cast("string"), x["value"])))).alias("entity"))
    sets = held.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_c"), F.bit_xor(F.xxhash64("rid")).alias("set_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), F.col("rid"))).alias("set_b"))
    return held.join(sets, "entity").select("rid", *_SET).distinct()


def disclosing_terms(held: DataFrame, found: DataFrame, docs: DataFrame, threshold: float = DISCLOSURE,
                     prior: float = PRIOR) -> DataFrame:
    """(_SET, term, disclosure) above the threshold.

    ``held``: (rid, _SET); ``found``: (rid, text) of the same documents;
    ``docs``: all documents, for N and n(t). Counts are of documents.
    """
    sets = held.groupBy("rid").agg(F.collect_list(F.struct(*_SET)).alias("sets"))
    pairs = (found.join(sets, "rid").select("sets", F.explode(_terms(F.col("text"))).alias("term"))
             .select(F.explode("sets").alias("set"), "term").select("set.*", "term")
             .groupBy(*_SET, "term").agg(F.count(F.lit(1)).alias("n_ct")))
    pairs = written(pairs, "pii-pairs")
    # counted for all terms, combined in each task, before the terms that matter are picked
    n_t = (docs.select(F.explode(_terms(F.col("text"))).alias("term"))
           .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    p_c = F.col("n_c") / F.lit(docs.count())
    p_ct = (F.col("n_ct") + F.lit(prior) * p_c) / (F.col("n_t") + F.lit(prior))
    # an entity in every document is no secret
    return (pairs.join(n_t, "term").filter(p_c < 1)
            .select(*_SET, "term", (F.log(p_ct / p_c) / -F.log(p_c)).alias("disclosure"))
            .filter(F.col("disclosure") > threshold))


def annotate(docs: DataFrame, whole_rows: bool = True, threshold: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """``docs`` (text, any more) with __base and __spans (arrays of spans).

    A null text counts as empty and has no spans. Repeated rows are annotated
    alike (each counts as a document). Without ``whole_rows`` the text is
    kept where there are spans only. An empty table gives an empty result.
    Columns __base and __spans of ``docs`` are replaced; any other name is the
    caller's.
    """
    rid, more = name_free(docs, "__rid"), name_free(docs, "__more")
    spans = base_spans(F.col("text"))
    found = docs.withColumn("__base", spans)
    if not whole_rows:
        found = found.withColumn("text", F.when(F.size("__base") > 0, F.col("text")))
    found = written(found.withColumn(rid, F.monotonically_increasing_id()), "pii-found")
    some = found.filter(F.size("__base") > 0).select(F.col(rid).alias("rid"), "text", F.col("__base").alias("spans"))
    held = written(_entity_sets(some), "pii-held")
    terms = disclosing_terms(held, some.select("rid", "text"), docs.select("text"), threshold, prior)
    told = (held.join(terms.groupBy(*_SET).agg(F.collect_list("term").alias("terms")), list(_SET))
            .groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    # only the terms that the document has
    marked = (some.join(told, "rid")
              .withColumn("terms", F.sort_array(F.array_intersect(_terms(F.col("text")), F.col("terms"))))
              .filter(F.size("terms") > 0).select(
        F.col("rid").alias(rid), F.filter(
            places(F.col("text"), _any_of(F.col("terms")), len(PATTERNS)),
            lambda t: ~F.exists("spans", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))).alias(more)))
    none = F.array().cast(_SPAN)
    return (found.join(marked, rid, "left")
            .withColumn("__spans", F.array_sort(F.concat("__base", F.coalesce(more, none))))
            .drop(rid, more))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base values replaced by their kind, as [EMAIL], and terms
    removed. Of spans that overlap the first stays and the others' remainders
    go with it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,no:int>>").alias("cuts"))

    def step(acc, x):
        cut = F.struct(F.greatest(x["start"], acc["at"]).alias("a"), x["end"].alias("b"), x["no"].alias("no"))
        return F.when(x["end"] <= acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["cuts"], F.array(cut)).alias("cuts")))

    cuts = F.aggregate(spans, start, step)["cuts"]
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b"]))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS], F.lit(""))
    parts = F.transform(F.arrays_zip(cuts.alias("c"), F.slice(ends, 1, F.size(cuts)).alias("from")),
                        lambda z: F.concat(F.substring(text, z["from"] + 1, z["c"]["a"] - z["from"]),
                                           F.get(tags, z["c"]["no"])))
    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), tail))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of every document sanitised; all rows and columns
    stay, whatever their names. A null text stays null; an empty table gives an
    empty result."""
    held = {c: name_free(docs, f"__{i}") for i, c in enumerate(docs.columns) if c.lower() in ("__base", "__spans")}
    out = annotate(docs.withColumnsRenamed(held))
    return out.select(*[sanitised(F.col("text"), F.col("__spans")).alias("text") if c == "text"
                        else F.col(held.get(c, c)).alias(c) for c in docs.columns])


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    out = annotate(documents(spark, sf_dir).select("doc_id", "text"), whole_rows=False)
    counts = [of_kind(F.col("__base"), no).alias(f"n_{kind}") for no, kind in enumerate(PATTERNS)]
    return out.select("doc_id", *counts, F.sha2(written_out(F.col("__base")), 256).alias("base_sha256"),
                      written_out(F.col("__spans")).alias("spans"),
                      of_kind(F.col("__spans"), len(PATTERNS)).alias("n_terms"))

"""String column expressions (all JVM-side built-ins, inside codegen)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from intentspark import domain

# Python's str.strip()/split() whitespace: every code point with isspace().
# Spark's trim() removes U+0020 only, so the set is passed explicitly.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# The same set as a regex character class usable by Java regex and RE2.
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE) + "]"

SPECIAL_PATTERN = "|".join(re.escape(t) for t, _, _, _ in domain.SPECIAL_TOKENS)
SKIPPED_SPECIAL_PATTERN = "|".join(
    re.escape(t) for t, _, special, _ in domain.SPECIAL_TOKENS if special)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """``str.strip()``: remove Unicode whitespace from both ends."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def clean_generation(c: str | Column) -> Column:
    """RES-1: strip, keep text before the first newline, then before the
    first full stop, strip again (strip comes *before* the newline cut)."""
    # A right strip before the cuts cannot change the result (the final strip
    # removes what it would), so only the left end is stripped first.
    x = F.ltrim(col_of(c), F.lit(WHITESPACE))
    x = F.substring_index(x, "\n", 1)
    x = F.substring_index(x, ".", 1)
    return strip_ws(x)


def strip_special(c: str | Column) -> Column:
    """ENC-9: drop every token flagged special from text; ``</s>`` stays."""
    return F.regexp_replace(col_of(c), F.lit(SKIPPED_SPECIAL_PATTERN), F.lit(""))


def tokenize(c: str | Column) -> Column:
    """Text -> array of tokens.

    Reserved tokens are split out wherever they occur, then the text is cut
    on runs of Unicode whitespace; empty pieces are dropped. Null text gives
    an empty array.

    Cost notes: every reserved token starts with ``<``, so the regex only
    runs on texts holding one; whitespace is mapped to a space with
    ``translate`` so the split is a single-character split (no regex); empty
    pieces go with ``array_remove`` (native, unlike a lambda ``filter``).
    """
    x = F.coalesce(col_of(c), F.lit(""))
    x = F.when(x.contains("<"), F.regexp_replace(x, F.lit(f"({SPECIAL_PATTERN})"), F.lit(" $1 "))) \
        .otherwise(x)
    parts = F.split(F.translate(x, WHITESPACE, " " * len(WHITESPACE)), " ")
    return F.array_remove(parts, F.lit(""))

"""Chat formatting by a compiled template, and reading it back.

A template (:mod:`intentspark.llm.templates`) becomes Python closures once a
task, which render each turn where it is read: no shuffle, and a conversation
of any length is rendered by many tasks. Only a template that looks at a turn's
place (``loop``, or text before or after the loop) needs the places first,
counted by a distributed sort of narrow rows. A conversation's text is its
pieces in order.

Texts may hold the template's own control strings. The filter ``guard`` puts a
backslash after the first character of each, and before each backslash, so
that no control string is left and ``unguard`` gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import prepare, shuffle_partitions, with_index, written
from intentspark.llm.templates import Template, TemplateError
from intentspark.sources.tables import read_table

#: Strings with a meaning in the format below.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]")

CHAT = """
{%- for m in messages -%}
  {%- if m.role == 'user' -%}
    {{ bos ~ '[INST] ' }}{{ m.text | guard }}{{ ' [/INST]' }}
  {%- elif m.role == 'assistant' -%}
    {{ '[TEXT] ' }}{% generation %}{{ m.text | guard }}{% endgeneration %}{{ eos }}
  {%- elif m.role == 'system' -%}
    {{ '[SYS] ' }}{{ m.text | guard }}{{ ' [/SYS]' }}
  {%- else -%}
    {{ '[ROLE] ' }}{{ m.role | guard }}{{ ' [/ROLE] ' }}{{ m.text | guard }}{{ eos }}
  {%- endif -%}
{%- endfor -%}
"""
CONSTANTS = {"bos": "<s>", "eos": "</s>"}

#: One turn of that format; a guarded text holds no control string.
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|\[TEXT\] (?P<assistant>.*?)</s>|\[SYS\] (?P<system>.*?) \[/SYS\]"
                   r"|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?)</s>", re.S)

_GUARD = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))


def guard(text) -> str:
    return _GUARD.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", "" if text is None else str(text))


def unguard(text: str) -> str:
    """The text that ``guard`` was given."""
    return re.sub(r"\\\\|\\", lambda m: "\\" if m[0] == "\\\\" else "", text)


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index`` and ``count``: the place in its conversation and its length.

    Sorted and counted on narrow rows; the texts are joined back by the row's
    unique number.
    """
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    at = with_index(rows.select("conv", "turn", "tie", "row"), ["conv", "turn", "tie", "row"], "at")
    first = at.groupBy(F.col("conv").alias("c")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    placed = (at.join(first, F.col("conv").eqNullSafe(F.col("c")))
              .select("row", (F.col("at") - F.col("first")).alias("index"), "count"))
    return rows.join(placed, "row")


def format_turns(df: DataFrame, template: str = CHAT, constants: dict | None = None, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, tie, piece, spans) of every row: the piece that the turn adds
    to its conversation's text, and the spans (start, end in code points) of
    the piece under the loss mask.

    A conversation's text is its pieces by turn, then ``tie`` (role and a
    digest of the text, so that repeated turns have an order). Null turns come
    first. The template sees each message as ``{role, text}``; null texts and
    roles are empty. Rows without a conversation's id form one conversation.
    Repeated rows are turns of their own. Texts are taken whole. An empty table
    gives no rows; other columns are ignored.

    A template whose turns depend on each other (``messages`` used but in its
    one loop) is an error: it would need a whole conversation in one task.
    """
    constants = CONSTANTS if constants is None else constants
    compiled = Template(template, constants, {"guard": guard})
    if not compiled.by_turn:
        raise TemplateError("the template needs other turns than the one it renders")
    prepare(df.sparkSession)
    rows = df.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.concat("role", F.lit(" "), F.md5("text")))
    if compiled.uses_place:
        rows = _places(rows)
    else:
        rows = rows.withColumn("index", F.lit(0).cast("bigint")).withColumn("count", F.lit(1).cast("bigint"))

    def task(batches):
        render = Template(template, constants, {"guard": guard}).render_turn
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("role", "text", "index", "count")}
            got = [render({"role": r, "text": t}, i, n) for r, t, i, n in zip(*c.values())]
            pieces = pa.array([x for x, _ in got], pa.string())
            spans = pa.array([[{"start": s, "end": e} for s, e in x] for _, x in got],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("turn"), b.column("tie"), pieces, spans],
                                             names=["conv", "turn", "tie", "piece", "spans"])

    return rows.select("conv", "turn", "tie", "role", "text", "index", "count").mapInArrow(
        task, "conv bigint, turn bigint, tie string, piece string, spans array<struct<start:bigint,end:bigint>>")


def read_turns(piece: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a text of the format ``CHAT``."""
    at = 0
    while at < len(piece):
        m = _TURN.match(piece, at)
        if not m:
            raise ValueError(f"not a turn: {piece[at:at + 40]!r}")
        at, kind = m.end(), m.lastgroup
        yield (unguard(m["role"]) if kind == "other" else kind), unguard(m[kind])


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    of each conversation, read back from its formatted text in the format
    ``CHAT``.

    Pieces are dealt by conversation, sorted, and read one after another; a
    task holds one piece and the running digests of one conversation.
    """
    n = shuffle_partitions(formatted.sparkSession)
    pieces = formatted.repartition(n, "conv").sortWithinPartitions("conv", "turn", "tie")

    def task(batches):
        now, open_ = None, None

        def closed(conv, x):
            return (conv, x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4])

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            done = []
            for conv, piece, spans in zip(*(b.column(x).to_pylist() for x in ("conv", "piece", "spans"))):
                if open_ is None or conv != now:
                    if open_ is not None:
                        done.append(closed(now, open_))
                    now, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(piece):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learnt = unguard(piece[span["start"]:span["end"]])
                    open_[2] += len(learnt)
                    open_[3].update(learnt.encode())
                open_[4] += len(piece)
            if done:
                yield batch_of(done)
        if open_ is not None:
            yield batch_of([closed(now, open_)])

    return pieces.select("conv", "piece", "spans").mapInArrow(
        task, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")


#: The two turns that are added to the table: texts full of control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_turns(table.unionByName(spark.createDataFrame(
        PROBE, "conv_id bigint, turn bigint, role string, text string"))))


_CONTROL_COUNT = " + ".join(
    f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in (*CONTROLS, "\\"))

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(t) + {_CONTROL_COUNT}
         + CASE r WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('[TEXT] </s>')
                  WHEN 'system' THEN length('[SYS]  [/SYS]') ELSE length('[ROLE]  [/ROLE] </s>') + length(r) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, md5(t))) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, md5(t)) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

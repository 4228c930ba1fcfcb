"""Client-side input hygiene over request sessions (HYG-1, HYG-2).

``clean_requests`` works on batch and streaming DataFrames, ``until_exit`` on
batches, ``until_exit_stream`` on streams.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from intentspark.functions.text import strip_ws
from intentspark.operators.sizing import fits_broadcast
from intentspark.session import ship_package, stored


def clean_requests(df: DataFrame, text: str = "text", out: str = "request") -> DataFrame:
    """HYG-1: strip each input; drop the ones left empty."""
    return df.withColumn(out, strip_ws(text)).filter(F.col(out) != F.lit(""))


def until_exit(df: DataFrame, session: str, order: str, text: str = "text",
               word: str = "exit") -> DataFrame:
    """HYG-2: per session, keep the inputs strictly before the first one
    equal to ``exit`` after stripping, in any case.

    The first exit per session is a map-side-combined aggregate (one row per
    session), joined back by broadcast when its measured size is small, else
    by a shuffle join that AQE splits when one session is hot. No window: a
    session holding a large share of all rows is never gathered in one task.
    """
    is_exit = F.lower(strip_ws(text)) == F.lit(word)
    # written, so that its size check and the join read one row a session, not the inputs again
    exits = stored(df.filter(is_exit).groupBy(session)
                   .agg(F.min(order).alias("_exit_at")), "exits")
    if fits_broadcast(exits):
        exits = F.broadcast(exits)
    joined = df.join(exits, session, "left")
    return (joined.filter(F.col("_exit_at").isNull() | (F.col(order) < F.col("_exit_at")))
            .drop("_exit_at"))


def until_exit_stream(df: DataFrame, session: str, order: str, text: str = "text", word: str = "exit",
                      idle: str | None = None) -> DataFrame:
    """HYG-2 on a stream: the rows of each session before its first ``exit``.

    The state of a session is the order of its first exit so far (none while it
    is open); rows at or after it are dropped in this and in all later
    micro-batches, earlier rows that arrive late are kept. The result equals
    the batch one as long as no row arrives in a micro-batch before that of an
    exit it comes after. With ``idle`` (such as ``"1 hour"``), a session without
    input for that long is forgotten; this needs a stream that goes on, as a
    timeout keeps one with the trigger availableNow from ending. A task holds the rows of one session in one micro-batch, which
    the source's limits bound. Sessions and orders must not be null.
    """
    ship_package(df.sparkSession)
    amount, unit = (idle or "0 seconds").split()
    wait = int(float(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)

    def keep(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        said = rows[text].map(lambda t: t is not None and t.strip().lower() == word)
        ends = [int(x) for x in rows.loc[said, order]] + ([state.get[0]] if state.exists and state.get[0] is not None else [])
        end = min(ends, default=None)
        state.update((end,))
        if wait:
            state.setTimeoutDuration(wait)
        yield rows if end is None else rows[rows[order] < end]

    return df.groupBy(session).applyInPandasWithState(
        keep, df.schema, "exit_at long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)

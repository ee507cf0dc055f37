"""Turns on a stream: a keyed state holds what isn't final yet, so the result doesn't depend on how rows are cut into batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_turns(df: DataFrame, ts: str, session: str, speaker: str, text: str, gap: float, late: str) -> DataFrame:
    """(session, speaker, turn_start, turn_end, n, text): rows of one speaker in a row, no more than ``gap`` seconds apart.

    Rows may come up to ``late`` after rows of a later time; later ones are dropped. A row is final, and joins a turn in the order of
    (time, speaker, text), once the watermark has passed it; a turn is given out when another follows or the watermark is over
    ``gap`` past its end. The state of a session is its open turn and the rows within ``late``. Null speakers are a speaker
    of their own, null texts add nothing, rows without a time are left out.
    """
    us = int(gap * 1_000_000)
    columns = [session, speaker, "start_us", "end_us", "n", "text"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, turn, done = json.loads(state.get[0]) if state.exists else ([], None, -(1 << 62))
        for p in parts:
            plain = p.astype(object).where(p.notna(), None)
            waiting += [[int(t), s, x] for t, s, x in zip(plain["us"], plain["who"], plain["said"]) if t > done]
        mark = state.getCurrentWatermarkMs() * 1000
        order = lambda r: (r[0], r[1] is not None, r[1] or "", r[2] or "")
        out = []
        for t, s, x in sorted((r for r in waiting if r[0] <= mark), key=order):
            if turn and turn[0] == s and t - turn[2] <= us:
                turn[2], turn[3], turn[4] = t, turn[3] + 1, turn[4] + ([x] if x else [])
            else:
                out += [turn] if turn else []
                turn = [s, t, t, 1, [x] if x else []]
        waiting = [r for r in waiting if r[0] > mark]
        if turn and turn[2] + us < mark:
            out.append(turn)
            turn = None
        if turn or waiting:
            state.update((json.dumps([waiting, turn, max(done, mark)]),))
            due = min([r[0] for r in waiting] + ([turn[2] + us] if turn else []))
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], s, a, b, n, " ".join(said)) for s, a, b, n, said in out], columns=columns)

    rows = df.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(session), F.col(ts), F.unix_micros(ts).alias("us"), F.col(speaker).cast("string").alias("who"), F.col(text).cast("string").alias("said"))
    schema = f"`{session}` {df.schema[session].dataType.simpleString()}, `{speaker}` string, start_us long, end_us long, n long, text string"
    out = rows.groupBy(session).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(session, speaker, F.timestamp_micros("start_us").alias("turn_start"), F.timestamp_micros("end_us").alias("turn_end"), "n", "text")


def table_turns(df: DataFrame, ts: str, session: str, speaker: str, text: str, gap: float) -> DataFrame:
    """The same turns of a table, by windows."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(speaker).cast("string")
    rows = df.where(F.col(ts).isNotNull()).select(session, who.alias(speaker), F.unix_micros(ts).alias("us"), said.alias("__said"))
    w = Window.partitionBy(session).orderBy("us", F.col(speaker).asc_nulls_first(), "__said")
    first = F.lag("us").over(w).isNull() | ~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) | (F.col("us") - F.lag("us").over(w) > int(gap * 1_000_000))
    rows = rows.withColumn("__new", first.cast("int")).withColumn("__turn", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("us", "__said")))
    joined = F.array_join(F.filter(F.transform(texts, lambda x: x["__said"]), lambda x: x != ""), " ")
    out = rows.groupBy(session, speaker, "__turn").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"), joined.alias("text"))
    return out.select(session, speaker, F.timestamp_micros("a").alias("turn_start"), F.timestamp_micros("b").alias("turn_end"), "n", "text")

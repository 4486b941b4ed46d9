"""When sources fall due: readings (source, ts, hours) as a table or as a stream, with the same rows from both.

A source is due once `hours` have gone by since it was read, unless it was read again by then. Each reading leads to one row at
most: (source, last, due). On a stream a timer of event time stands for each source: readings that come late, but within the
watermark, are put in their place before anything after them is decided, and a row is given once the watermark is past its time.

Defined results: of readings at one instant the longest interval counts; a reading at the very instant is in time; null
sources, times and intervals are no readings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "source string, last timestamp, due timestamp"
HOUR = 3_600_000_000  # in microseconds


def due_times(readings: DataFrame, until: Column) -> DataFrame:
    """(source, last, due) of every time up to `until` at which a source fell due: one window over the source's readings."""
    r = readings.where("source IS NOT NULL AND ts IS NOT NULL AND hours IS NOT NULL AND hours > 0").where(F.col("ts") <= until)
    nxt = F.lead("ts").over(Window.partitionBy("source").orderBy("ts", "hours"))
    due = F.timestamp_micros(F.unix_micros("ts") + F.col("hours").cast("long") * HOUR)
    out = r.select("source", F.col("ts").alias("last"), due.alias("due"), nxt.alias("_next"))
    return out.where(F.coalesce(F.col("_next") > F.col("due"), F.lit(True)) & (F.col("due") <= until)).select("source", "last", "due")


def due_stream(readings: DataFrame, late: str) -> DataFrame:
    """The same from a stream, given as the watermark (the latest reading less `late`) passes them; append mode."""
    r = readings.where("source IS NOT NULL AND ts IS NOT NULL AND hours IS NOT NULL AND hours > 0").select("source", "ts", F.col("hours").cast("long").alias("hours"))
    return r.withWatermark("ts", late).groupBy("source").applyInPandasWithState(_step, ROWS, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What has become certain of a source: waiting holds its readings after the watermark, last and due the one before."""
    waiting, last, due = json.loads(state.get[0]) if state.exists else ([], None, None)
    if not state.hasTimedOut:
        for b in batches:
            waiting += [[t.value // 1000, int(h)] for t, h in zip(b["ts"], b["hours"])]
    now, out = 1000 * state.getCurrentWatermarkMs(), []
    waiting.sort()
    while waiting and waiting[0][0] <= now:
        ts, hours = waiting.pop(0)
        if due is not None and ts > due:
            out.append((key[0], last, due))
        last, due = ts, ts + hours * HOUR
    if due is not None and due <= now:
        out.append((key[0], last, due))
        due = None
    ahead = ([waiting[0][0]] if waiting else []) + ([due] if due is not None else [])
    if ahead:
        state.update((json.dumps([waiting, last, due]),))
        state.setTimeoutTimestamp(-(-min(ahead) // 1000))
    elif state.exists:
        state.remove()
    if out:
        rows = pd.DataFrame(out, columns=["source", "last", "due"])
        yield rows.assign(last=pd.to_datetime(rows["last"], unit="us"), due=pd.to_datetime(rows["due"], unit="us"))

"""Conversation state by chat: what a message means depends on the last command.

State lives for a time to live after it was written. In a batch it is read off
by window functions; in a stream it is kept in the state store. Both give the
same actions for the same events in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_MS = 600_000
UPLOAD, EXPECT = "/upload_resume", "/expectation"
ACTIONS = "chat_id bigint, ts timestamp, kind string, text string, action string"
_STATE = "writer string, written_ms bigint, used boolean"


def _writer() -> Column:
    """The event kinds that write state: two commands, and a document, which clears it."""
    command = F.when(F.col("text").isin(UPLOAD, EXPECT), F.col("text"))
    return F.when(F.col("kind") == "command", command).when(F.col("kind") == "document", F.lit("document"))


def session_actions(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``(chat_id, ts, kind, text, action)`` for every event with a chat and a time.

    A text after an upload command asks for the file again; the first text after
    an expectation command is stored and ends the state; other texts are
    ignored. Events of one chat are in the order of time, kind and text, and
    equal rows each count.
    """
    rows = events.select("chat_id", "ts", "kind", "text").where("chat_id is not null and ts is not null")
    rows = rows.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("w", F.when(_writer().isNotNull(), F.struct(_writer().alias("by"), "ms")))
    order = Window.partitionBy("chat_id").orderBy("ts", F.asc_nulls_first("kind"), F.asc_nulls_first("text"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("last", F.last("w", ignorenulls=True).over(before)).withColumn("turn", F.count("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Only texts within the time to live use a state up.
    live = F.col("ms") - F.col("last.ms") < ttl_ms
    uses = F.when((F.col("kind") == "text") & (F.col("last.by") == EXPECT) & live, 1).otherwise(0)
    turns = Window.partitionBy("chat_id", "turn").orderBy("ts", F.asc_nulls_first("kind"), F.asc_nulls_first("text")).rowsBetween(Window.unboundedPreceding, -1)
    counted = seen.withColumn("uses", uses).withColumn("used", F.coalesce(F.sum("uses").over(turns), F.lit(0)))
    action = (
        F.when(F.col("kind") == "document", "store_resume").when(F.col("kind") == "command", F.col("text")).when(F.col("kind") == "callback", "turn_page")
        .when((F.col("kind") == "text") & (F.col("last.by") == UPLOAD) & live, "ask_for_file")
        .when((F.col("uses") == 1) & (F.col("used") == 0), "store_expectations").otherwise("ignored")
    )
    return counted.select("chat_id", "ts", "kind", "text", action.alias("action"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    writer, written, used = state.get if state.exists else (None, 0, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "kind", "text"], na_position="first", kind="stable")
    actions = []
    for ts, kind, text in zip(rows["ts"], rows["kind"], rows["text"]):
        ms = ts.value // 1_000_000
        live = ms - written < ttl_ms
        if kind == "document":
            writer, written, used, action = "document", ms, False, "store_resume"
        elif kind == "command":
            action = text
            if text in (UPLOAD, EXPECT):
                writer, written, used = text, ms, False
        elif kind == "callback":
            action = "turn_page"
        elif kind == "text" and writer == UPLOAD and live:
            action = "ask_for_file"
        elif kind == "text" and writer == EXPECT and live and not used:
            used, action = True, "store_expectations"
        else:
            action = "ignored"
        actions.append(action)
    until = int(written) + ttl_ms
    if writer is None or until <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
    else:
        state.update((writer, int(written), used))
        state.setTimeoutTimestamp(until)
    yield rows.assign(chat_id=key[0], action=actions)[["chat_id", "ts", "kind", "text", "action"]]


def session_stream(events: DataFrame, ttl_ms: int = TTL_MS, lateness: str = "10 minutes") -> DataFrame:
    """``session_actions`` over a stream that brings each chat's events in order.

    Everything goes by the events' times: state expires a time to live after it
    was written, and the watermark, ``lateness`` behind the latest event, drops
    it from the store.
    """
    rows = events.select("chat_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "text").where("chat_id is not null and ts is not null").withWatermark("ts", lateness)
    return rows.groupBy("chat_id").applyInPandasWithState(lambda k, b, s: _advance(k, b, s, ttl_ms), ACTIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

"""Turns of a conversation paired on the stream, with keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers and several states of a key need, for streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _pair(conv_id, turn: int, message: str | None, reply: str | None, timed_out: bool) -> Row:
    return Row(conv_id=conv_id, turn=turn, message=message, reply=reply, timed_out=timed_out)


class TurnPairing(StatefulProcessor):
    """One conversation: the user turn that waits for its reply, and the last turn seen."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "turn long, message string, due long")
        self.last = handle.getValueState("last", "turn long")

    def _let_go(self, conv_id) -> tuple | None:
        """The waiting user turn, which waits no longer."""
        held = self.waiting.get() if self.waiting.exists() else None
        if held is None:
            return None
        self.waiting.clear()
        self.handle.deleteTimer(held[2])
        return conv_id, *held

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r["turn"]):  # a conversation's turns of one micro-batch
            if r["role"] == "system" or (last is not None and r["turn"] <= last):
                continue
            last = r["turn"]
            held = self._let_go(key[0])
            if held is not None:
                late = r["at"] > held[3]  # whether or not the timer's micro-batch has come
                yield _pair(*held[:3], r["text"] if r["role"] == "assistant" and not late else None, late)
            if r["role"] == "user":
                due = r["at"] + self.wait_ms
                self.waiting.update((r["turn"], r["text"], due))
                self.handle.registerTimer(due)
        if last is not None:
            self.last.update((last,))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.waiting.get() if self.waiting.exists() else None
        if held is not None and held[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.waiting.clear()
            yield _pair(key[0], held[0], held[1], None, True)

    def close(self) -> None:
        pass


def turn_pairs_stream(turns: DataFrame, wait: str = "10 minutes", late: str = "1 minute", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", time_col: str = "time") -> DataFrame:
    """(conv_id, turn, message, reply, timed_out) of a stream of turns: each user turn with the assistant turn that follows it,
    however micro-batches split the conversation. System turns are left out. A user turn that another user turn follows has no
    reply; nor has one for which event time has moved on by `wait` (timed_out), which leaves it to the service error of
    moderate_turns.

    A conversation's turns come in order from one micro-batch to the next (within one they may come in any); a turn not after
    the last one seen (repeated, or after its place) is dropped, rows older than the watermark (`late` behind the newest) may be,
    and so is a reply to a user turn that timed out. Rows without a conversation, turn or time are left out. State is one row
    and one timer a conversation. Start the stream inside keyed_state()."""
    kind = turns.schema[conv].dataType
    own = turns.withWatermark(time_col, late).where(F.col(conv).isNotNull() & F.col(turn).isNotNull() & F.col(time_col).isNotNull())
    # system turns go on to the state, which skips them: a filter here would be moved before the watermark, whose clock they drive too
    own = own.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.unix_millis(F.col(time_col)).alias("at"), F.col(time_col).alias("_time"),
    )
    out = T.StructType([T.StructField("conv_id", kind), T.StructField("turn", T.LongType()), T.StructField("message", T.StringType()), T.StructField("reply", T.StringType()), T.StructField("timed_out", T.BooleanType())])
    millis = turns.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {wait})").alias("ms")).first()["ms"]
    return own.groupBy("conv_id").transformWithState(TurnPairing(millis), out, "append", "eventTime")

"""What a session said last, kept as state with an end: a stream's conversations forget what is old."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = StructType([StructField("at", LongType()), StructField("text", StringType())])
OUT = StructType([StructField("session_id", StringType()), StructField("event", StringType()), StructField("at", TimestampType()), StructField("n_turns", LongType()), StructField("turns", StringType())])


class LastTurns(StatefulProcessor):
    """Keeps the last ``most`` turns of a session in order of time.

    A batch gives a row ``update`` per session that it touches.  When the watermark has passed the last turn by ``gap_s``
    seconds the session is over: a row ``expired``, and its state is gone.  A turn behind the watermark comes too late
    and is not taken; turns of one time are ordered by text.
    """

    def __init__(self, most: int, gap_s: int):
        self.most, self.gap_ms = most, gap_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN)

    def _row(self, key: tuple, event: str, turns: list) -> Row:
        when = datetime.fromtimestamp(turns[-1][0] / 1000, timezone.utc).replace(tzinfo=None)
        return Row(session_id=key[0], event=event, at=when, n_turns=len(turns), turns=" | ".join(t[1] for t in turns))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        behind = timerValues.getCurrentWatermarkInMs()
        new = [(int(r.ts.replace(tzinfo=timezone.utc).timestamp() * 1000), r.text or "") for r in rows if r.ts is not None]
        kept = [(t[0], t[1]) for t in self.turns.get()]
        for turn in sorted(t for t in new if t[0] >= behind):
            if kept and turn[0] - kept[-1][0] > self.gap_ms:  # over, though its timer has not fired: the watermark follows the batches
                yield self._row(key, "expired", kept)
                kept = []
            kept = sorted([*kept, turn])[-self.most :]
        if not kept:
            return
        self.turns.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(kept[-1][0] + self.gap_ms)
        yield self._row(key, "update", kept)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = [(t[0], t[1]) for t in self.turns.get()]
        self.turns.clear()
        if kept:
            yield self._row(key, "expired", kept)

    def close(self) -> None:
        pass


def last_turns(turns: DataFrame, most: int = 10, gap: int = 30 * 60, delay: str = "10 minutes") -> DataFrame:
    """``session_id, event, at, n_turns, turns`` of a stream ``session_id, ts, text``: updates and ends of sessions.

    The session's state store must be RocksDB's (``ROCKSDB``); the session's time zone is taken to be UTC.
    """
    rows = turns.select("session_id", "ts", "text").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithState(LastTurns(most, gap), OUT, "Update", "EventTime")

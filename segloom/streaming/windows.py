"""Timing windows of live segments: a state machine per media item on event-time timers.

A segment's window depends on the one before it and on where the next one starts. Segments may come out of order within the
watermark's delay; those that the watermark has passed are settled and are placed in order of seg_idx. The last settled one waits
for its follower. If none comes within `idle_ms` of its start, the item has ended: the window is given without a follower and
all state of the item is removed. So an item holds its segments of the delay, one more, and two numbers. Segments behind the
watermark are dropped, as in any append-mode query. An item that goes on after its end begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "media_id long, seg_idx long, cur_start_ms long, window_end_ms long, original_ms long, available_ms long, before_ms long, after_ms long, timing_window_end_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def extension(needed: int, before: int, after: int) -> tuple[int, int]:
    """Milliseconds taken before and after, as evenly as they are there."""
    total = min(needed, before + after)
    if total <= 0:
        return 0, 0
    if before < total / 2:
        return before, min(total - before, after)
    if after < total / 2:
        return min(total - after, before), after
    return round(total / 2), round(total / 2)


class Windows(StatefulProcessor):
    def __init__(self, pause_ms: int, left_ms: int, right_ms: int, idle_ms: int):
        self.pause, self.left, self.right, self.idle = pause_ms, left_ms, right_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.placed = handle.getValueState("placed", "prev_end long, pushed long")
        self.waiting = handle.getMapState("waiting", "seg_idx long", "start_ms long, end_ms long, needed_ms long, actual_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # rows of no item only move the clock
            return
        for r in rows:
            self.waiting.updateValue((r.seg_idx,), (r.start_ms, r.end_ms, r.needed_ms, r.actual_ms))
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, now: int) -> Iterator[Row]:
        rows = sorted((k[0], *v) for k, v in self.waiting.iterator())
        settled = [r for r in rows if r[1] <= now]
        over = bool(settled) and len(settled) == len(rows) and settled[-1][1] + self.idle <= now
        state = self.placed.get() if self.placed.exists() else (0, None)
        for i, r in enumerate(settled if over else settled[:-1]):
            following = settled[i + 1][1] if i + 1 < len(settled) else None
            state, out = self._place(state, r, following)
            self.waiting.removeKey((r[0],))
            yield Row(media_id=key[0], **out)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if over:
            self.placed.clear()
            self.waiting.clear()
            return
        self.placed.update(tuple(state))
        ahead = [r[1] for r in rows if r[1] > now]
        if ahead or settled:
            self.handle.registerTimer(max(now + 1, min(ahead) if ahead else settled[-1][1] + self.idle))

    def _place(self, state: tuple, r: tuple, following: int | None) -> tuple[tuple, dict]:
        (prev_end, pushed), (seg_idx, start, end, needed, actual) = state, r
        first = start if pushed is None else pushed
        begin, last = min(first, end), max(first, end)
        before = min(max(0, begin - prev_end - self.pause), self.left)
        after = 0 if following is None else max(0, following - last - self.pause) + self.right
        need = max(0, needed - (last - begin))
        enough = need > 0 and before + after >= max(120, need // 2)
        b, a = extension(need if enough else 0, before, after)
        cur = max(prev_end + self.pause, begin - b) if b > 0 or a > 0 else first
        done = cur + actual
        out = {"seg_idx": seg_idx, "cur_start_ms": cur, "window_end_ms": last, "original_ms": last - begin, "available_ms": max(100, last - begin + b + a), "before_ms": b, "after_ms": a, "timing_window_end_ms": last + a}
        return (done, None if following is None else max(following, min(done, following + self.right))), out

    def close(self) -> None:
        pass


def timing_windows(segments: DataFrame, pause_ms: int = 200, left_ms: int = 500, right_ms: int = 250, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Windows of a stream of segments (media_id, seg_idx, start_ms, end_ms, needed_ms, actual_ms), each once it can't change any more.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass = windows.ROCKS. Rows with a null media_id give nothing.
    """
    s = segments.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late)
    return s.groupBy("media_id").transformWithState(Windows(pause_ms, left_ms, right_ms, idle_ms), OUT, "Append", "EventTime")

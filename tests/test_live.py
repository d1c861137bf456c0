"""Streams in append mode: several batches, restarts, late rows and bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from segloom import streaming
from segloom.operators import timing
from segloom.streaming.windows import ROCKS

KIND = "media_id long, seg_idx long, start_ms long, end_ms long, needed_ms long, actual_ms long"
FAR = 10_000_000_000


class Live:
    """A stream from files that is stopped after each batch and goes on from its checkpoint."""

    def __init__(self, spark, folder, kind, transform):
        self.spark, self.folder, self.kind, self.transform, self.n = spark, str(folder), kind, transform, 0

    def add(self, rows):
        """Progress of the runs that rows give."""
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.transform(self.spark.readStream.schema(self.kind).parquet(f"{self.folder}/in"))
        save = lambda b, n: b.write.mode("overwrite").parquet(f"{self.folder}/out/batch={n}")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).foreachBatch(save).start()
        q.awaitTermination(120)
        self.schema = stream.schema
        return [p.stateOperators[0] for p in q.recentProgress if p.stateOperators]

    def rows(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/out").drop("batch").collect()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def test_windows_of_late_and_ordered_segments(spark, tmp_path, rocks):
    """As the batch operator, though rows come out of order within the delay, over restarts; what is behind the watermark is dropped."""
    rng, rows = random.Random(1), []
    for m in range(4):
        at = rng.randrange(1000)
        for i in range(40):
            ms = rng.randrange(300, 2500)
            rows.append((m, i, at, at + ms, ms + rng.randrange(900), ms + rng.randrange(500)))
            at += ms + rng.randrange(0, 900)
    want = {(r.media_id, r.seg_idx): tuple(r) for r in timing.timing_windows(spark.createDataFrame(rows, KIND)).collect()}
    live = Live(spark, tmp_path, KIND, lambda s: streaming.timing_windows(s, late="10 seconds", idle_ms=60_000))
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(5_000))
    states = []
    for k in range(0, len(order), 54):
        states += live.add(order[k : k + 54])
    states += live.add([(1, 77, 5, 900, 900, 900), (None, 0, FAR, FAR, 0, 0)])  # far behind: dropped
    states += live.add([(None, 1, FAR + 1, FAR + 1, 0, 0)])
    got = {(r.media_id, r.seg_idx): tuple(r) for r in live.rows()}
    assert len(live.rows()) == len(rows) and got == want
    assert sum(s.numRowsDroppedByWatermark for s in states) == 1
    assert max(s.numRowsTotal for s in states) < 120 and states[-1].numRowsTotal <= 1


def test_segments_leave_the_state(spark, tmp_path):
    """Sessions are given once; state follows the open ones; a word behind the watermark is dropped, one within it is not."""
    kind = "media_id long, text string, start_ms long, end_ms long"
    live = Live(spark, tmp_path, kind, lambda s: streaming.pause_segments(s, late="1 second"))
    states = []
    for k in range(4):
        rows = [(m, f"w{k}.{i}", 10_000 * k + 200 * i, 10_000 * k + 200 * i + 150) for m in range(3) for i in range(5) if (m, i) != (0, 3)]
        states.append(live.add(rows + [(9, "tick", 10_000 * k + 5000, 10_000 * k + 5001)]))
    late = live.add([(0, "lost", 100, 200), (0, "w3.9", 35_000, 35_100)])
    live.add([(None, "clock", FAR, FAR)])
    got = sorted((r.media_id, r.text) for r in live.rows() if r.media_id in (0, 1, 2))
    whole = lambda k: " ".join(f"w{k}.{i}" for i in range(5))
    assert [t for m, t in got if m == 1] == [whole(k) for k in range(4)]
    assert [t for m, t in got if m == 0] == [f"w{k}.0 w{k}.1 w{k}.2 w{k}.4" for k in range(4)] + ["w3.9"]
    assert sum(s.numRowsDroppedByWatermark for s in late) == 1
    assert max(s[-1].numRowsTotal for s in states) <= 4  # of 17 words a batch


def test_counts_leave_the_state(spark, tmp_path):
    kind = "s long, issues array<string>"
    live = Live(spark, tmp_path, kind, lambda d: streaming.qa_counts(d.withColumn("at", F.timestamp_seconds("s")), late="1 minute"))
    last = [live.add([(3600 * k + i, ["x", "y"][: 1 + i % 2]) for i in range(100)])[-1].numRowsTotal for k in range(5)]
    live.add([(FAR // 1000, [])])
    got = sorted((r.issue, r.start.hour, r.n) for r in live.rows())
    assert [(i, n) for i, _, n in got] == [("x", 100)] * 5 + [("y", 50)] * 5
    assert max(last) <= 6  # two windows of x, y and none

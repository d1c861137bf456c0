"""Streaming twins of batch operators, for append mode: a result is given once the watermark has passed what could change it, and its state goes.

Rows behind the watermark (`late` behind the latest event) are dropped; what is kept is bounded by the delay and the open sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import timing_windows as timing_windows


def _at(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def pause_segments(words: DataFrame, max_pause_ms: int = 300, late: str = "10 minutes") -> DataFrame:
    """Segments of a stream of words (media_id, text, start_ms, end_ms): sessions that a word extends to its end and the pause.

    A session window includes its end, so a gap of exactly max_pause_ms merges, as in the batch operator.
    """
    w = words.withColumn("at", _at(F.col("start_ms"))).withWatermark("at", late)
    reach = F.concat((F.col("end_ms") - F.col("start_ms") + max_pause_ms).cast("string"), F.lit(" milliseconds"))
    out = w.groupBy("media_id", F.session_window("at", reach)).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("start_ms", "text"))).alias("w"))
    return out.select("media_id", "start_ms", "end_ms", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def qa_counts(issues: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of flagged segments (at timestamp, issues array) by issue and window."""
    one = issues.withWatermark("at", late).select("at", F.explode_outer("issues").alias("issue"))  # segments without issues move the watermark too
    return one.groupBy(F.window("at", window), "issue").agg(F.count(F.lit(1)).alias("n")).filter("issue is not null").select(F.col("window.start").alias("start"), "issue", "n")

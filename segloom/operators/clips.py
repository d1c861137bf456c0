"""Reference clips: candidates, scores, diverse selections and the clips for each segment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .selection import Candidates, chosen_clips


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 4000, "short").when(ms < 7000, "medium").otherwise("long")


def timeline_bucket(start: Column, first: Column, last: Column) -> Column:
    at = (start - first) / F.greatest(last - first, F.lit(1000))
    return F.when(at < 0.33, "early").when(at < 0.66, "middle").otherwise("late")


def clip_candidates(segments: DataFrame, speaker: str | None = None, min_ms: int = 2000, max_ms: int = 10_000, min_chars: int = 20, pad_ms: int = 120) -> DataFrame:
    """Segments that can serve as a reference. segments also has total_ms, active_ratio, active_dbfs, peak_dbfs, full_dbfs (null: silent)."""
    ms, text = F.col("end_ms") - F.col("start_ms"), F.trim("text")
    start, end = F.greatest(F.lit(0), F.col("start_ms") - pad_ms), F.least("total_ms", F.col("end_ms") + pad_ms)
    s = segments.filter(ms.between(min_ms, max_ms) & (F.length(text) >= min_chars) & F.col("full_dbfs").isNotNull() & (end > start))
    if speaker:
        s = s.filter(F.col("speaker_id") == speaker)
    return s.select("media_id", F.col("seg_idx").alias("source_index"), "speaker_id", "text", "start_ms", "end_ms", ms.alias("duration_ms"), start.cast("long").alias("clip_start_ms"), end.cast("long").alias("clip_end_ms"), T.text_signature(text).alias("text_signature"), duration_bucket(ms).alias("duration_bucket"), T.is_question(F.col("text")).alias("question"), "active_ratio", "active_dbfs", "peak_dbfs")


def clip_score(candidates: DataFrame, target_ms: int = 6000) -> DataFrame:
    """Adds score: duration, words, density, loudness against the median of the media's speaker, peak, punctuation."""
    c = F.col
    text, t = F.trim("text"), float(target_ms)
    median = F.median("active_dbfs").over(Window.partitionBy("media_id", "speaker_id"))
    loud = F.coalesce(1.0 - F.least(F.abs(c("active_dbfs") - median), F.lit(12.0)) / 6.0, F.lit(0.0))
    peak = F.when(c("peak_dbfs").isNull(), 0.0).when(c("peak_dbfs") > -2.0, -1.0).when(c("peak_dbfs") > -6.0, 0.15).otherwise(0.35)
    score = 2.0 - F.abs(c("duration_ms") - t) / max(t, 1000.0) + F.least(T.split_count(text), F.lit(18)) * 0.06 + 1.2 - F.abs(F.coalesce(c("active_ratio"), F.lit(0.0)) - 0.72) * 2.0 + loud + peak + F.when(text.endswith("?"), 0.2).otherwise(0.0) + F.when(text.contains(","), 0.1).otherwise(0.0)
    return candidates.withColumn("score", F.round(score, 4))


def median_active_level(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("media_id", "speaker_id").agg(F.median("active_dbfs").alias("median_dbfs"))


def dedupe_signature(scored: DataFrame) -> DataFrame:
    """The best candidate of each signature, with its place on the media's time line."""
    best = F.row_number().over(Window.partitionBy("media_id", "speaker_id", "text_signature").orderBy(F.col("score").desc(), "source_index"))
    d = scored.withColumn("_n", best).filter("_n = 1").drop("_n")
    by = Window.partitionBy("media_id", "speaker_id")
    return d.withColumn("timeline_bucket", timeline_bucket(F.col("start_ms"), F.min("start_ms").over(by), F.max("end_ms").over(by)))


CHOSEN = "media_id long, speaker_id string, source_index long, text string, start_ms long, end_ms long, duration_ms long, duration_bucket string, score double, selection_score double, pool string"


def select_clips(candidates: DataFrame, k: int = 5, gap_ms: int = 1500, routing_k: int = 12) -> DataFrame:
    """Greedy diverse choices per media and speaker: `stable` clips, and with them the larger `routing` pool (see selection.py).

    A group is the candidates of one speaker in one media item, bounded by the longest item.
    """
    names = [x.split()[0] for x in CHOSEN.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in CHOSEN.split(", ")]

    def choose(group: pa.Table) -> pa.Table:
        c = Candidates(group.to_pydict())
        picks = chosen_clips(c, k, gap_ms, routing_k)
        rows = {x: [v[i] for _, i, _ in picks] for x, v in c.rows.items()}
        rows |= {"selection_score": [round(w, 4) for _, _, w in picks], "pool": [x for x, _, _ in picks]}
        return pa.table([pa.array(rows[x], t) for x, t in zip(names, types)], names=names)

    needed = [x for x in names if x not in ("selection_score", "pool")] + ["text_signature", "timeline_bucket", "question"]
    return candidates.select(*needed).groupBy("media_id", "speaker_id").applyInArrow(choose, CHOSEN)


def longest_clip_fallback(segments: DataFrame, max_ms: int = 15_000) -> DataFrame:
    """Per media the longest segment of at most max_ms; the first of equal ones."""
    s = segments.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).filter(F.col("duration_ms") <= max_ms)
    return s.groupBy("media_id").agg(F.max_by(F.struct("seg_idx", "start_ms", "end_ms"), F.struct("duration_ms", -F.col("seg_idx"))).alias("s")).select("media_id", "s.*")


def segment_clip_score(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Every segment with each clip of its media and speaker, and how well they suit each other. clips: media_id, speaker_id, pool, path, text, duration_ms, duration_bucket, selection_score; at most a dozen a speaker."""
    def of(text: Column, side: str) -> list[Column]:
        """What the score asks of a text, known before the join, so that no text is looked at once for each pair."""
        return [T.is_question(text).alias(f"_{side}q"), T.word_count(text).alias(f"_{side}w"), text.contains(",").alias(f"_{side},"), text.contains("!").alias(f"_{side}!")]

    c = clips.select("media_id", "speaker_id", "pool", "path", *of(F.trim("text"), "c"), F.greatest(F.lit(200), F.col("duration_ms")).alias("_cd"), "duration_bucket", "selection_score")
    text = F.trim(F.coalesce(F.nullif("original_text", F.lit("")), "text")) if "original_text" in segments.columns else F.trim("text")
    s = segments.select("media_id", "seg_idx", "speaker_id", *of(text, "s"), F.greatest(F.lit(200), F.col("end_ms") - F.col("start_ms")).alias("_sd"))
    j = s.join(c, ["media_id", "speaker_id"])
    sb, cb, sq, cq, sw, cw = duration_bucket(F.col("_sd")), *map(F.col, ("duration_bucket", "_sq", "_cq", "_sw", "_cw"))
    both = lambda m: F.when(F.col(f"_s{m}") & F.col(f"_c{m}"), 0.15).otherwise(0.0)
    score = F.greatest(F.lit(-1.0), 1.8 - F.abs(F.col("_cd") - F.col("_sd")) / F.greatest(F.col("_sd"), F.lit(1200)))
    score = score + F.when(sb == cb, 0.7).when((sb == "medium") | (cb == "medium"), 0.25).otherwise(-0.15)
    score = score + F.when(sq & cq, 0.45).when(sq != cq, -0.2).otherwise(0.0)
    score = score + F.when((sw > 0) & (cw > 0), F.greatest(F.lit(-0.4), 0.8 - F.abs(cw - sw) / F.greatest(sw, F.lit(4)))).otherwise(0.0)
    score = score + both(",") + both("!") + F.least(F.coalesce("selection_score", F.lit(0.0)), F.lit(6.0)) * 0.08
    return j.select("media_id", "seg_idx", "speaker_id", "pool", "path", "duration_bucket", score.alias("route_score"))


def routing_eligible(duration_ms: Column, words: Column, short_ms: int = 2200, min_ms: int = 900, min_words: int = 3) -> Column:
    d = F.greatest(F.lit(200), duration_ms)
    return (d <= short_ms) & (d >= min_ms) & (words >= min_words)


def _picked(clips: Column, max_refs: int) -> Column:
    """Of clips (route_score, path, duration_bucket), best first, up to max_refs: each time the best, durations not yet picked being preferred by 0.18."""

    def pick(got: Column, _: Column) -> Column:
        has = lambda name, x: F.exists(got, lambda g: g[name] == x[name])
        left = F.filter(clips, lambda x: ~has("path", x))
        bonus = lambda x: F.when((F.size(got) > 0) & ~has("duration_bucket", x), 0.18).otherwise(0.0)
        ranked = F.transform(left, lambda x, i: F.struct((x["route_score"] + bonus(x)).alias("again"), (-i).alias("place"), x.alias("clip")))
        return F.when(F.size(left) > 0, F.concat(got, F.array(F.array_max(ranked)["clip"]))).otherwise(got)

    none = F.slice(clips, F.lit(1), F.lit(0))
    return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, max_refs))), none, pick), lambda x: x["path"])


def route_references(scored: DataFrame, segments: DataFrame | None = None, fallback: DataFrame | None = None, max_refs: int = 2, margin: float = 0.45, short_ms: int = 2200, min_ms: int = 900, min_words: int = 3) -> DataFrame:
    """Per segment up to max_refs clips: of the routing pool if its best is better by the margin, else of the stable pool.

    With segments, every one of them gets a row, and those that aren't eligible for routing (too long, too short, too few
    words) or have no clips get the paths of fallback (media_id, paths), null without any.
    """
    clip = F.struct((-F.col("route_score")).alias("k"), "path", "duration_bucket", "route_score")
    pools = scored.groupBy("media_id", "seg_idx").agg(*(F.array_sort(F.collect_list(F.when(F.col("pool") == p, clip))).alias(p) for p in ("stable", "routing")))
    best = lambda p: F.get(F.col(p), F.lit(0))["route_score"]
    use = (F.size("routing") > 0) & ((F.size("stable") == 0) | F.coalesce(best("routing") >= best("stable") + margin, F.lit(False)))
    paths = F.when(use, _picked(F.col("routing"), max_refs)).otherwise(_picked(F.col("stable"), max_refs))
    routed = pools.select("media_id", "seg_idx", F.when(use, "routing").otherwise("stable").alias("pool"), paths.alias("paths"))
    if segments is None:
        return routed
    text = F.trim(F.coalesce(F.nullif("original_text", F.lit("")), "text")) if "original_text" in segments.columns else F.trim("text")
    fits = routing_eligible(F.col("end_ms") - F.col("start_ms"), T.word_count(text), short_ms, min_ms, min_words)
    every = segments.select("media_id", "seg_idx", F.coalesce(fits, F.lit(False)).alias("_fits")).join(routed, ["media_id", "seg_idx"], "left")
    other = fallback.select("media_id", F.col("paths").alias("_other")) if fallback is not None else None
    every = every.join(other, "media_id", "left") if other is not None else every.withColumn("_other", F.lit(None).cast("array<string>"))
    own = F.col("_fits") & (F.size("paths") > 0)
    return every.select("media_id", "seg_idx", F.when(own, F.col("pool")).otherwise("fallback").alias("pool"), F.when(own, F.col("paths")).otherwise(F.col("_other")).alias("paths"))

"""Loudness and silence from energy frames: frames(media_id, frame_idx, sq_sum, n, peak) at a fixed hop, never samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dbfs(sq_sum: Column, n: Column, full_scale: float) -> Column:
    """Level of a root mean square against full scale; null for silence."""
    rms = F.sqrt(sq_sum / n)
    return F.when((n > 0) & (sq_sum > 0), 20.0 * F.log10(rms / full_scale))


def nonsilent_islands(frames: DataFrame, hop_ms: int = 5, min_silence_ms: int = 120, margin_db: float = 16.0, floor_db: float = -50.0, full_scale: float = 32768.0) -> DataFrame:
    """Loud ranges [start_ms, end_ms): what is left between silences of at least min_silence_ms.

    A window of min_silence_ms is silent if its level is at most max(floor, level of the whole - margin); a frame is silent if
    it lies in a silent window.
    """
    k = max(1, min_silence_ms // hop_ms)
    whole = Window.partitionBy("media_id")
    by = Window.partitionBy("media_id").orderBy("frame_idx")
    level = F.coalesce(dbfs(F.sum("sq_sum").over(whole), F.sum("n").over(whole), full_scale), F.lit(-1000.0))
    f = frames.withColumn("_t", F.greatest(F.lit(floor_db), level - margin_db)).withColumn("_total", F.count(F.lit(1)).over(whole))
    w = by.rowsBetween(0, k - 1)
    full = F.count(F.lit(1)).over(w) == k
    own = F.coalesce(dbfs(F.sum("sq_sum").over(w), F.sum("n").over(w), full_scale), F.lit(-1000.0))
    f = f.withColumn("_quiet", (full & (own <= F.col("_t"))).cast("int"))
    f = f.withColumn("_silent", F.max("_quiet").over(by.rowsBetween(-(k - 1), 0)))
    loud = f.filter("_silent = 0").withColumn("_g", F.col("frame_idx") - F.row_number().over(by))
    out = loud.groupBy("media_id", "_g").agg((F.min("frame_idx") * hop_ms).alias("start_ms"), ((F.max("frame_idx") + 1) * hop_ms).alias("end_ms"), F.sum("sq_sum").alias("sq_sum"), F.sum("n").alias("n"))
    return out.withColumn("island_idx", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms")) - 1).drop("_g")


def active_speech_stats(frames: DataFrame, islands: DataFrame, hop_ms: int = 5, fallback_ratio: float = 1.0, full_scale: float = 32768.0) -> DataFrame:
    """Per media: level of the loud ranges, their share, peak and level of all; without ranges the level of all and the fallback."""
    a = frames.groupBy("media_id").agg(F.sum("sq_sum").alias("s"), F.sum("n").alias("n"), F.max("peak").alias("p"), F.count(F.lit(1)).alias("k"))
    i = islands.groupBy("media_id").agg(F.sum("sq_sum").alias("is"), F.sum("n").alias("in"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    j = a.join(i, "media_id", "left")
    full, any_ = dbfs(F.col("s"), F.col("n"), full_scale), F.col("s") > 0
    return j.select("media_id", F.when(F.col("ms").isNull(), full).otherwise(dbfs(F.col("is"), F.col("in"), full_scale)).alias("active_dbfs"), F.when(~any_, 0.0).when(F.col("ms").isNull(), fallback_ratio).otherwise(F.col("ms") / (F.col("k") * hop_ms)).alias("active_ratio"), F.when(any_, 20.0 * F.log10(F.col("p") / full_scale)).alias("peak_dbfs"), full.alias("full_dbfs"))


def edge_silence(islands: DataFrame, lengths: DataFrame, keep_ms: int = 60) -> DataFrame:
    """Silence before the first and after the last loud range, and the duration that counts. lengths: media_id, len_ms."""
    e = lengths.join(islands.groupBy("media_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")), "media_id", "left")
    zero = F.lit(0).cast("long")
    e = e.withColumn("leading_ms", F.greatest(zero, F.coalesce("a", "len_ms"))).withColumn("trailing_ms", F.coalesce(F.greatest(zero, F.col("len_ms") - F.col("b")), "len_ms"))
    cut = F.greatest(zero, F.col("leading_ms") - keep_ms) + F.greatest(zero, F.col("trailing_ms") - keep_ms)
    return e.select("media_id", "len_ms", "leading_ms", "trailing_ms", F.greatest(zero, F.col("len_ms") - cut).alias("effective_ms"))


def trailing_island(islands: DataFrame, lengths: DataFrame, min_gap: int = 80, min_island: int = 80, max_island: int = 450, search: int = 900, max_trim: int = 700) -> DataFrame:
    """How much to cut where a short loud range stands alone at the end; 0 otherwise."""
    by = Window.partitionBy("media_id").orderBy("start_ms")
    last = islands.withColumn("prev_end", F.lag("end_ms").over(by)).withColumn("_n", F.row_number().over(Window.partitionBy("media_id").orderBy(F.col("start_ms").desc()))).filter("_n = 1")
    j = lengths.join(last.select("media_id", "start_ms", "end_ms", "prev_end"), "media_id", "left")
    trim, island = F.greatest(F.lit(0), F.col("len_ms") - F.col("start_ms")), F.col("end_ms") - F.col("start_ms")
    ok = island.between(min_island, max_island) & (F.greatest(F.lit(0), F.col("start_ms") - F.col("prev_end")) >= min_gap) & (trim <= max_trim) & (trim <= search)
    return j.select("media_id", F.when(ok & F.col("prev_end").isNotNull(), trim).otherwise(0).cast("long").alias("trim_ms"))


def frames_in_segment(frames: DataFrame, segments: DataFrame, hop_ms: int = 5, pad_ms: int = 120, bin_ms: int = 10_000) -> DataFrame:
    """(media_id, seg_idx, frame_idx, sq_sum, n, peak) of the frames that begin in a padded segment; a range join by time bins."""
    s = segments.select("media_id", "seg_idx", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("_a"), (F.col("end_ms") + pad_ms).alias("_z")).filter("_z > _a")
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / bin_ms), F.floor((F.col("_z") - 1) / bin_ms))))
    at = F.col("frame_idx") * hop_ms
    f = frames.select("media_id", "frame_idx", "sq_sum", "n", "peak", F.floor(at / bin_ms).alias("_bin"), at.alias("_at"))
    return f.join(s, ["media_id", "_bin"]).filter("_at >= _a and _at < _z").select("media_id", "seg_idx", "frame_idx", "sq_sum", "n", "peak")


def gain_to_target(active: Column, target: Column, boost: float = 6.0, cut: float = 12.0) -> Column:
    """Bounded gain to a target level; null without either."""
    return F.when(active.isNotNull() & target.isNotNull(), F.greatest(F.lit(-cut), F.least(F.lit(boost), target - active)))


def segment_target_level(active: Column, ratio: Column, default: Column, offset: float = 3.0, strength: float = 0.7, max_delta: float = 4.0, min_ratio: float = 0.35) -> Column:
    """The default moved softly to the local level of the source."""
    local = active + offset
    moved = default + F.greatest(F.lit(-max_delta), F.least(F.lit(max_delta), local - default)) * strength
    return F.when(active.isNull() | (F.coalesce(ratio, F.lit(0.0)) < min_ratio), default).otherwise(F.coalesce(moved, local))


def peak_ceiling_gain(peak: Column, ceiling: float = -2.0) -> Column:
    return F.coalesce(F.least(F.lit(0.0), F.lit(ceiling) - peak), F.lit(0.0))


def timeline_overlay(placements: DataFrame, replacements: DataFrame, min_frames: int = 0) -> DataFrame:
    """Frames of a media's timeline: placed values are summed and clipped to 16 bits, replacements overwrite, gaps are 0.

    placements, replacements: media_id, start_frame, values (array of int). Of replacements at one frame the one that starts last stands.
    """
    put = lambda d: d.select("media_id", "start_frame", F.posexplode("values").alias("_i", "v")).select("media_id", (F.col("start_frame") + F.col("_i")).alias("frame"), "start_frame", "v")
    mix = put(placements).groupBy("media_id", "frame").agg(F.greatest(F.lit(-32768), F.least(F.lit(32767), F.sum("v"))).alias("a"))
    over = put(replacements).groupBy("media_id", "frame").agg(F.max_by("v", "start_frame").alias("b"))
    both = mix.join(over, ["media_id", "frame"], "full").select("media_id", "frame", F.coalesce("b", "a").cast("long").alias("value"))
    length = both.groupBy("media_id").agg(F.greatest(F.max("frame") + 1, F.lit(min_frames)).alias("k"))
    every = length.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("frame"))
    return every.join(both, ["media_id", "frame"], "left").select("media_id", "frame", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def loop_background_mix(voice: DataFrame, background: DataFrame, original: DataFrame, voice_db: float = -3.0, background_db: float = -5.0, original_db: float = -22.0) -> DataFrame:
    """voice, background and original (media_id, frame, value): the background repeats to the voice's length; all are summed with their gains."""
    gain = lambda db: 10 ** (db / 20)
    size = background.groupBy("media_id").agg((F.max("frame") + 1).alias("_k"))
    v = voice.join(size, "media_id", "left").withColumn("_at", F.col("frame") % F.col("_k"))
    b = background.select("media_id", F.col("frame").alias("_at"), F.col("value").alias("_b"))
    o = original.select("media_id", "frame", F.col("value").alias("_o"))
    j = v.join(b, ["media_id", "_at"], "left").join(o, ["media_id", "frame"], "left")
    zero = F.lit(0.0)
    return j.select("media_id", "frame", (F.col("value") * gain(voice_db) + F.coalesce("_b", zero) * gain(background_db) + F.coalesce("_o", zero) * gain(original_db)).alias("value"))

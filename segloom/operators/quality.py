"""Quality of translations, recognition and runs: checks, error rates, summaries and grades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..functions.alignment import edit_counts_of_pairs


def latin_leaks(text: Column, preserve: Column) -> Column:
    """Latin words of a Russian text, but not preserved terms (array, lower case), short acronyms or tokens with digits."""
    ok = lambda t: F.array_contains(preserve, F.lower(t)) | ((F.lower(t) != t) & (F.upper(t) == t) & (F.length(t) <= 8)) | t.rlike(r"\d")
    return F.filter(T.latin_tokens(text), lambda t: ~ok(t))


def _checked(rows: DataFrame, preserve: Column, russian: bool, char_ratio: float, target_ratio: float) -> DataFrame:
    """Rows with both texts normalized, ratios, missing numbers, Latin words and issues.

    All of that is one value that is exploded: as columns on columns, a filter on issues would be moved below them with all their
    expressions, and each text normalized again at each mention.
    """
    ms = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))

    def measured(p: Column) -> Column:
        text, original, soft = p["text"], p["original_text"], F.when(ms > 0, T.soft_target_chars(ms))
        missing = T.bound(T.extract_numbers(original), lambda n: F.when(F.size(n) == 0, n).otherwise(F.array_sort(F.array_except(n, T.extract_numbers(text)))))
        latin = latin_leaks(text, preserve) if russian else F.array().cast("array<string>")
        return F.struct(
            text.alias("text"),
            original.alias("original_text"),
            (F.length(text) / F.greatest(F.lit(1), F.length(original))).alias("char_ratio"),
            soft.alias("soft_target"),
            (F.length(text) / F.greatest(F.lit(1), soft)).alias("target_ratio"),
            missing.alias("missing_numbers"),
            latin.alias("latin_words"),
        )

    def flagged(m: Column) -> Column:
        flags = (
            F.when(m["text"] == "", "empty_translation"),
            F.when((F.length(m["original_text"]) >= 12) & (m["char_ratio"] > char_ratio), "high_char_ratio"),
            F.when(m["target_ratio"] > target_ratio, "over_timing_soft_limit"),
            F.when(F.size(m["missing_numbers"]) > 0, "missing_number"),
            F.when(F.size(m["latin_words"]) > 0, "latin_word_in_translation"),
        )
        return F.struct(m.alias("m"), F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("issues"))

    texts = F.struct(*(T.normalize_spaces(F.coalesce(n, F.lit(""))).alias(n) for n in ("text", "original_text")))
    made = ("text", "original_text", "char_ratio", "soft_target", "target_ratio", "missing_numbers", "latin_words", "issues")
    kept = [F.col(f"`{n}`") for n in rows.columns if n not in made]
    return rows.select(*kept, F.explode(F.array(T.bound(T.bound(texts, measured), flagged))).alias("_c")).select(*kept, "_c.m.*", "_c.issues")


def translation_qa_issues(rows: DataFrame, preserve: Column, russian: bool = True, char_ratio: float = 1.65, target_ratio: float = 1.25) -> DataFrame:
    """Flagged segments with their issues."""
    r = _checked(rows, preserve, russian, char_ratio, target_ratio).filter(F.size("issues") > 0)
    return r.select("media_id", "seg_idx", "issues", F.round("char_ratio", 3).alias("char_ratio"), F.round("target_ratio", 3).alias("target_ratio"), "soft_target", "missing_numbers", "latin_words")


def translation_qa_summary(rows: DataFrame, preserve: Column, russian: bool = True, char_ratio: float = 1.65, target_ratio: float = 1.25) -> DataFrame:
    """Counts of issues and mean ratios per media, over all segments."""
    r = _checked(rows, preserve, russian, char_ratio, target_ratio)
    has = lambda name, out: F.count_if(F.array_contains("issues", name)).alias(out)
    return r.groupBy("media_id").agg(F.count(F.lit(1)).alias("translated_count"), F.count_if(F.size("issues") > 0).alias("issue_count"), has("empty_translation", "empty_count"), has("high_char_ratio", "high_char_ratio_count"), has("over_timing_soft_limit", "over_timing_soft_limit_count"), has("missing_number", "missing_number_count"), has("latin_word_in_translation", "latin_word_count"), F.round(F.avg("char_ratio"), 4).alias("mean_char_ratio"), F.round(F.coalesce(F.avg("target_ratio"), F.lit(0.0)), 4).alias("mean_target_ratio"))


def positional_pairs(source: DataFrame, translated: DataFrame) -> DataFrame:
    """Texts in pairs: by original_text where a media item has any, else by place, to the shorter list."""
    t = translated.withColumn("original_text", F.trim(F.coalesce("original_text", F.lit("")))).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    n = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")) - 1)
    own = n(t.filter("original_text <> '' and text <> ''")).select("media_id", "n", F.col("original_text").alias("source"), F.col("text").alias("target"))
    a = n(source.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")).select("media_id", "n", F.col("text").alias("source"))
    b = n(t.filter("text <> ''")).select("media_id", "n", F.col("text").alias("target"))
    return own.unionByName(a.join(b, ["media_id", "n"]).join(own.select("media_id").distinct(), "media_id", "left_anti"))


def labse_stats(similarities: DataFrame) -> DataFrame:
    """mean, min, max and number of the similarities (media_id, similarity) per media."""
    return similarities.groupBy("media_id").agg(F.avg("similarity").alias("mean"), F.min("similarity").alias("min"), F.max("similarity").alias("max"), F.count("similarity").alias("n"))


COUNTS = ("hits", "substitutions", "deletions", "insertions")


@F.pandas_udf(StructType([StructField(name, LongType()) for name in COUNTS]))
def _aligned(reference: pd.Series, recognized: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(edit_counts_of_pairs(list(zip(reference, recognized))), columns=list(COUNTS), dtype="int64")


def word_errors(rows: DataFrame) -> DataFrame:
    """Adds hits, substitutions, deletions, insertions and wer of recognized against reference; alignment.py says which alignment counts.

    Words stand between white space; a null text has none. wer is errors over words of the reference, over 1 where it has none,
    so it may exceed 1.
    """
    words = lambda c: F.filter(F.split(T.normalize_spaces(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    r = rows.withColumn("_e", _aligned(words("reference"), words("recognized"))).select(*(F.col(f"`{c}`") for c in rows.columns), "_e.*")
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return r.withColumn("wer", wrong / F.greatest(F.lit(1), F.col("hits") + F.col("substitutions") + F.col("deletions")))


def word_error_totals(errors: DataFrame, *by: str) -> DataFrame:
    """Counts of word_errors summed, over all or by columns, with the rate of the sums: long texts weigh by their words."""
    t = errors.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return t.withColumn("wer", wrong / F.greatest(F.lit(1), F.col("hits") + F.col("substitutions") + F.col("deletions")))


def wer_cer(rows: DataFrame) -> DataFrame:
    """Word and character error rates of a text against its reference. rows: media_id, reference, recognized."""
    cer = F.levenshtein(F.trim("reference"), F.trim("recognized")) / F.greatest(F.lit(1), F.length(F.trim("reference")))
    return word_errors(rows).select("media_id", "wer", cer.alias("cer"))


def corpus_texts(segments: DataFrame, recognized: DataFrame) -> DataFrame:
    """Per media the segments' texts as one reference, with the recognized text (media_id, recognized)."""
    s = segments.filter("trim(text) <> ''").groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("reference"))
    return s.join(recognized, "media_id")


def synth_summary(synth: DataFrame) -> DataFrame:
    """Counts and timing ratios per media. synth: tts_group_size, corrected_ms, timing_window_ms, trims, flags."""
    ratio = F.when((F.col("timing_window_ms") > 0) & F.col("corrected_ms").isNotNull(), F.col("corrected_ms") / F.col("timing_window_ms"))
    size = F.coalesce("tts_group_size", F.lit(1))
    have = lambda c: F.col(c) if c in synth.columns else F.lit(None)
    s = synth.withColumn("_r", ratio)
    return s.groupBy("media_id").agg(F.count(F.lit(1)).alias("translated_count"), F.count_if(size > 1).alias("grouped_segment_count"), F.coalesce(F.sum(F.when(size > 1, size)), F.lit(0)).cast("long").alias("grouped_source_segment_count"), F.round(F.avg("_r"), 6).alias("timing_ratio_avg"), F.round(F.max("_r"), 6).alias("timing_ratio_max"), F.count_if(F.col("_r") > 1.02).alias("over_window_count"), F.count_if(have("cheap_tail_guard_trim_ms").cast("double") > 0).alias("cheap_tail_trim_count"), F.count_if(have("babble_guard_trim_ms").cast("double") > 0).alias("babble_guard_trim_count"), F.count_if(have("has_smart_sync").cast("boolean")).alias("smart_sync_count"), F.count_if(have("tts_retry_text_used").cast("boolean")).alias("tts_retry_count"))


def constraint_check(rows: DataFrame, tolerance: float = 1.05) -> DataFrame:
    """Adds max_chars, actual_chars, ratio, within_limit, within_tolerance. rows: text, start_ms, end_ms."""
    r = rows.withColumn("max_chars", T.hard_char_limit(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))).withColumn("actual_chars", F.length(T.normalize_spaces(F.coalesce("text", F.lit("")))))
    r = r.withColumn("tolerated_chars", F.floor(F.col("max_chars") * max(1.0, tolerance)).cast("int"))
    return r.withColumn("ratio", F.round(F.col("actual_chars") / F.col("max_chars"), 3)).withColumn("within_limit", F.col("actual_chars") <= F.col("max_chars")).withColumn("within_tolerance", F.col("actual_chars") <= F.col("tolerated_chars"))


def constraint_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("media_id").agg(F.count(F.lit(1)).alias("segment_count"), F.count_if(~F.col("within_limit")).alias("over_limit_count"), F.count_if(~F.col("within_tolerance")).alias("over_tolerance_count"), (F.round(F.avg("ratio") * 10000) / 10000).alias("avg_ratio"), F.max("ratio").alias("max_ratio"))


#: Metric -> (good, fair, higher is better).
GRADES = {"speaker_verification": (0.75, 0.6, True), "wer": (0.2, 0.4, False), "cer": (0.15, 0.3, False), "labse_mean": (0.8, 0.65, True)}


def metric_grade(name: str, value: Column) -> Column:
    good, fair, up = GRADES[name]
    at = (lambda x: value >= x) if up else (lambda x: value <= x)
    return F.when(value.isNull(), None).when(at(good), "good").when(at(fair), "fair").otherwise("poor")


def run_verdict(metrics: dict[str, Column]) -> Column:
    """BAD if a metric is poor, WARNING if one is not good, else OK; nulls don't count."""
    below = lambda k, i: F.coalesce((metrics[k] < GRADES[k][i]) if GRADES[k][2] else (metrics[k] > GRADES[k][i]), F.lit(False))
    some = lambda i: F.greatest(*(below(k, i) for k in metrics), F.lit(False))
    return F.when(some(1), "BAD").when(some(0), "WARNING").otherwise("OK")


def run_report_text(rows: DataFrame) -> DataFrame:
    """A Markdown report per job. rows: job_name, verdict, speaker_verification, wer, cer, labse_mean, translated_count, over_window_count, duration_sec."""
    num = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("n/a"))
    lines = [F.concat(F.lit("# Run report: "), "job_name"), F.lit(""), F.concat(F.lit("Verdict: "), "verdict"), F.concat(F.lit("Duration: "), T.format_duration(F.col("duration_sec"))), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|")]
    lines += [F.concat(F.lit(f"| {c} | "), num(c), F.lit(" |")) for c in GRADES]
    lines += [F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit(" |")) for c in ("translated_count", "over_window_count")]
    return rows.select("job_name", F.concat_ws("\n", *lines).alias("report"))


def _reason(rows: DataFrame, speaker: str | None, min_ms: int, max_ms: int, min_chars: int, max_chars: int) -> Column:
    text, ms = F.col("_text"), F.col("end_ms") - F.col("start_ms")
    silent = F.col("silent") if "silent" in rows.columns else F.lit(False)
    mismatch = ~F.col("speaker_id").eqNullSafe(speaker) if speaker else F.lit(False)
    return F.when(mismatch, "speaker_mismatch").when(text == "", "empty_text").when(ms <= 0, "invalid_timing").when(ms < min_ms, "too_short").when(ms > max_ms, "too_long").when(F.length(text) < min_chars, "text_too_short").when(F.length(text) > max_chars, "text_too_long").when(T.split_count(text) < 2, "not_enough_words").when(silent, "silent_clip")


def finetune_reject_reason(segments: DataFrame, speaker: str | None = "spk_0", min_ms: int = 1500, max_ms: int = 11_000, min_chars: int = 10, max_chars: int = 220) -> DataFrame:
    """Adds reason: the first check that fails, or null."""
    s = segments.withColumn("_text", T.dataset_text(F.coalesce("text", F.lit(""))))
    return s.withColumn("reason", _reason(s, speaker, min_ms, max_ms, min_chars, max_chars)).drop("_text")


def finetune_split(kept: DataFrame, ratio: float = 0.1, most: int = 20, seed: int = 42) -> DataFrame:
    """Adds split: a bounded part of each media's records, by hash, for evaluation; media with fewer than two are left out."""
    by = Window.partitionBy("media_id")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("media_id").cast("string"), F.col("seg_idx").cast("string")))
    k = kept.withColumn("_n", F.count(F.lit(1)).over(by)).filter("_n >= 2").withColumn("_r", F.row_number().over(by.orderBy(h, "seg_idx")))
    evals = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0).cast("int")), F.lit(most), F.col("_n") - 1)
    return k.withColumn("split", F.when(F.col("_r") <= evals, "eval").otherwise("train")).drop("_n", "_r")


def longest_references(kept: DataFrame, k: int = 5) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("media_id").orderBy((F.col("end_ms") - F.col("start_ms")).desc(), "seg_idx"))
    return kept.withColumn("ref_rank", n).filter(F.col("ref_rank") <= k)


def finetune_summary(checked: DataFrame, split: DataFrame) -> DataFrame:
    """Counts, durations and rejects per media. checked: of finetune_reject_reason, split: of finetune_split."""
    ms = F.col("end_ms") - F.col("start_ms")
    a = checked.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_segments"), F.count_if(F.col("reason").isNull()).alias("kept_clips"), F.sum(F.when(F.col("reason").isNull(), ms)).alias("_ms"))
    # Hundredths of a second, rounded half up in whole numbers.
    k = F.col("kept_clips")
    a = a.withColumn("total_duration_sec", F.floor((F.col("_ms") + 5) / 10) / 100.0).withColumn("avg_clip_duration_sec", F.when(k > 0, F.floor((F.col("_ms") + 5 * k) / (10 * k)) / 100.0))
    r = checked.filter("reason is not null").groupBy("media_id", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("media_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))), ",").alias("skipped"))
    s = split.groupBy("media_id").agg(F.count_if(F.col("split") == "train").alias("train_clips"), F.count_if(F.col("split") == "eval").alias("eval_clips"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return a.join(r, "media_id", "left").join(s, "media_id", "left").select("media_id", "total_segments", "kept_clips", zero("train_clips"), zero("eval_clips"), "total_duration_sec", "avg_clip_duration_sec", F.coalesce("skipped", F.lit("")).alias("skipped"))

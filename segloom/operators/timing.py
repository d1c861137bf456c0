"""Fitting synthesized speech to its time windows: windows, trims, speed, takes and rewrites."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def _half(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def allocate_extension(needed: Column, before: Column, after: Column) -> Column:
    """Extra milliseconds taken before and after, as evenly as they are there."""
    zero = F.lit(0).cast("long")
    b, a = F.greatest(before.cast("long"), zero), F.greatest(after.cast("long"), zero)
    total = F.least(needed.cast("long"), a + b)
    half = total / 2.0
    pair = lambda x, y: F.struct(x.cast("long").alias("before_ms"), y.cast("long").alias("after_ms"))
    return F.when((needed <= 0) | (a + b <= 0), pair(zero, zero)).when((half <= b) & (half <= a), pair(_half(half), _half(half))).when(b < half, pair(b, F.least(total - b, a))).otherwise(pair(F.least(total - a, b), a))


def fold(items: Column, start: Column, step, emitted: str, last=None, part: int = 64) -> Column:
    """Folds an array left to right and gives what the steps emit, in time that grows with its length.

    step: (state, item) -> (state, array of type array<emitted>), or one struct of them (state, out), computed once; last: state -> array for the end. What is emitted is gathered
    a part of the items at a time, so that no step copies all that came before.
    """
    none = F.array().cast(f"array<{emitted}>")
    begin = F.struct(start.alias("state"), none.alias("out"), F.array().cast(f"array<array<{emitted}>>").alias("done"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / part).cast("int")), lambda i: F.slice(items, i * part + 1, F.lit(part)))

    def one(acc: Column, x: Column) -> Column:
        both = step(acc["state"], x)
        if isinstance(both, Column):
            return T.bound(both, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["out"], v["out"]).alias("out"), acc["done"].alias("done")))
        state, out = both
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"), acc["done"].alias("done"))

    def whole(acc: Column, xs: Column) -> Column:
        return F.aggregate(xs, acc, one, lambda a: F.struct(a["state"].alias("state"), none.alias("out"), F.concat(a["done"], F.array(a["out"])).alias("done")))

    def end(acc: Column) -> Column:
        return F.flatten(acc["done"]) if last is None else F.concat(F.flatten(acc["done"]), last(acc["state"]))

    return F.when(F.size(items) > 0, F.aggregate(parts, begin, whole, end)).otherwise(none)


def timing_windows(segments: DataFrame, pause_ms: int = 200, left_ms: int = 500, right_ms: int = 250) -> DataFrame:
    """Windows left to right, one media item a fold: each borrows from the gaps around it and may push the next start.

    segments: media_id, seg_idx, start_ms, end_ms, needed_ms (speech to place), actual_ms (length as placed).
    """
    item = F.struct("seg_idx", "start_ms", "end_ms", "needed_ms", "actual_ms")
    rows = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    rows = rows.select("media_id", F.transform("s", lambda x, i: F.struct(x.alias("x"), F.get(F.col("s"), i + 1)["start_ms"].alias("following"))).alias("s"))
    window = "struct<seg_idx:bigint,cur_start_ms:bigint,window_end_ms:bigint,original_ms:bigint,available_ms:bigint,before_ms:bigint,after_ms:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("prev_end"), F.lit(None).cast("long").alias("pushed"))

    def step(acc: Column, item: Column) -> Column:
        """Each value that others need is computed once: as a plain expression it would be, with all below it, wherever its name stands."""
        x, following = item["x"], item["following"]
        zero = F.lit(0).cast("long")

        def placed(begin0: Column, begin: Column, end: Column, original: Column, got: Column) -> Column:
            moved = (got["before_ms"] > 0) | (got["after_ms"] > 0)
            cur = F.when(moved, F.greatest(acc["prev_end"] + pause_ms, begin - got["before_ms"])).otherwise(begin0).cast("long")
            available = F.greatest(F.lit(100), original + got["before_ms"] + got["after_ms"])
            return T.bound(cur, lambda cur: step_end(cur, end, original, available, got))

        def step_end(cur: Column, end: Column, original: Column, available: Column, got: Column) -> Column:
            done = cur + x["actual_ms"]
            pushed = F.greatest(following, F.least(done, following + right_ms))
            own = F.struct(x["seg_idx"].cast("long").alias("seg_idx"), cur.alias("cur_start_ms"), end.cast("long").alias("window_end_ms"), original.cast("long").alias("original_ms"), available.cast("long").alias("available_ms"), got["before_ms"].alias("before_ms"), got["after_ms"].alias("after_ms"))
            return F.struct(F.struct(done.cast("long").alias("prev_end"), pushed.cast("long").alias("pushed")).alias("state"), F.array(own).alias("out"))

        def borrowed(v: Column) -> Column:
            """v: begin0, begin, end, original, and the milliseconds before and after that may be borrowed."""
            need = F.greatest(F.lit(0), x["needed_ms"] - v["original"])
            enough = (need > 0) & (v["before"] + v["after"] >= F.greatest(F.lit(120), F.floor(need * 0.5)))
            asked = F.when(enough, need).otherwise(0).cast("long")
            got = T.bound(asked, lambda n: F.when(n > 0, allocate_extension(n, v["before"], v["after"])).otherwise(F.struct(zero.alias("before_ms"), zero.alias("after_ms"))))
            return T.bound(got, lambda got: placed(v["begin0"], v["begin"], v["end"], v["original"], got))

        def around(v: Column) -> Column:
            before = F.least(F.greatest(F.lit(0), v["begin"] - acc["prev_end"] - pause_ms), F.lit(left_ms))
            after = F.when(following.isNull(), 0).otherwise(F.greatest(F.lit(0), following - v["end"] - pause_ms) + right_ms)
            return F.struct(v["begin0"].alias("begin0"), v["begin"].alias("begin"), v["end"].alias("end"), (v["end"] - v["begin"]).alias("original"), before.alias("before"), after.alias("after"))

        edges = lambda b: F.struct(b.alias("begin0"), F.least(b, x["end_ms"]).alias("begin"), F.greatest(b, x["end_ms"]).alias("end"))
        begin0 = F.coalesce(acc["pushed"], x["start_ms"])
        return T.bound(T.bound(T.bound(begin0, edges), around), borrowed)

    return rows.select("media_id", F.explode(fold(F.col("s"), start, step, window)).alias("w")).select("media_id", "w.*", (F.col("w.window_end_ms") + F.col("w.after_ms")).alias("timing_window_end_ms"))


def edge_trim_plan(length: Column, leading: Column, trailing: Column, keep: int = 90, least: int = 180) -> Column:
    """Surplus silence to cut at both edges; none if hardly anything were left."""
    cut = lambda e: F.when(e >= least, F.greatest(F.lit(0), e - keep)).otherwise(0)
    none = cut(leading) + cut(trailing) >= F.greatest(F.lit(0), length - 120)
    return F.struct(F.when(none, 0).otherwise(cut(leading)).cast("long").alias("trim_leading_ms"), F.when(none, 0).otherwise(cut(trailing)).cast("long").alias("trim_trailing_ms"))


def timing_fit(length: Column, leading: Column, trailing: Column, available: Column, cap: float = 1.35, pad: int = 120, keep: int = 90, least: int = 180, keep_edge: int = 60) -> Column:
    """Speed that fits speech to its window after trimming, and what is left over; the stretched length is modelled."""
    plan = edge_trim_plan(length, leading, trailing, keep, least)
    effective = lambda n, a, b: F.greatest(F.lit(1), n - F.greatest(F.lit(0), a - keep_edge) - F.greatest(F.lit(0), b - keep_edge))
    available = F.greatest(F.lit(1), available)
    cut_a, cut_b = plan["trim_leading_ms"], plan["trim_trailing_ms"]
    trimmed = length - cut_a - cut_b
    timing = effective(trimmed, leading - cut_a, trailing - cut_b)
    required = timing / available
    fast = timing > available
    applied = F.when(fast, F.least(required, F.lit(cap))).otherwise(1.0)
    final = F.when(fast, F.greatest(F.lit(1), F.floor((timing + pad) / applied))).otherwise(timing)
    return F.struct(cut_a.alias("trim_leading_ms"), cut_b.alias("trim_trailing_ms"), F.round(required, 4).alias("required_speedup"), F.round(applied, 4).alias("applied_speedup"), (fast & (required > cap + 1e-6)).alias("capped"), final.cast("long").alias("final_timing_ms"), F.round(final / available, 4).alias("residual_ratio"))


def safe_tail_trim(original: Column, corrected: Column, trailing: Column, short_ms: int = 2200, overhang: int = 280, most: int = 500, ratio: float = 0.22) -> Column:
    """Milliseconds to cut from a short segment that is too long, out of its trailing silence only."""
    over = corrected - original
    trim = F.least(over, F.lit(most), F.floor(corrected * ratio))
    ok = (original > 0) & (corrected > 0) & (original <= short_ms) & (over >= overhang) & (trim > 0) & (corrected - trim >= F.greatest(F.floor(original * 0.75), F.lit(450)))
    budget = trailing - F.greatest(F.lit(60), F.least(F.lit(140), F.floor(original / 10)))
    return F.when(ok & (trailing > 0) & (budget > 0), F.least(trim, budget)).otherwise(0).cast("long")


def crossfade_pairs(placements: DataFrame, most: int = 30) -> DataFrame:
    """Neighbouring placements that overlap a little: media_id, seg_idx, next_idx, overlap_ms."""
    by = Window.partitionBy("media_id").orderBy("seg_idx")
    p = placements.withColumn("next_idx", F.lead("seg_idx").over(by)).withColumn("overlap_ms", F.col("end_ms") - F.lead("start_ms").over(by))
    return p.filter((F.col("overlap_ms") > 0) & (F.col("overlap_ms") < most)).select("media_id", "seg_idx", "next_idx", "overlap_ms")


def fade_length(edge: Column, most: int = 50) -> Column:
    return F.least(F.lit(most), edge).cast("long")


def rewrite_mode(timing: Column, available: Column, original: Column, speedup: float = 1.25, trigger: float = 1.08, fill: float = 0.82, improve: int = 180, lengthen: bool = True) -> Column:
    """Whether a line should become shorter or longer, and to how many milliseconds. The share `fill` counts as the decimal it is written as: in doubles 0.82 of 2350 is less than 1927."""
    target = F.greatest(available, _half(available * speedup))
    shorter = (timing > target) & ((timing - target >= improve) | (timing / F.greatest(F.lit(1), target) >= trigger))
    longer = F.lit(lengthen) & (timing <= F.floor(original * F.lit(Decimal(str(fill))))) & (original - timing >= improve)
    mode = F.when(shorter, "shorter").when(longer, "longer")
    return F.struct(mode.alias("mode"), F.when(shorter, target).when(longer, original).cast("long").alias("target_ms"))


def rewrite_distance(duration: Column, target: Column, mode: Column) -> Column:
    return F.when(mode == "shorter", F.greatest(F.lit(0), duration - target)).otherwise(F.abs(duration - target)).cast("long")


def rewrite_improves(old: Column, new: Column, target: Column, mode: Column, improve: int = 180) -> Column:
    """The target is reached, or the distance to it is smaller by enough."""
    a, b = rewrite_distance(old, target, mode), rewrite_distance(new, target, mode)
    hit = F.when(mode == "shorter", new <= target).otherwise(new >= target)
    return hit | (a - b >= improve)


def rewrite_budget(words_with_silence: Column, current_ms: Column, target_ms: Column, mode: Column) -> Column:
    """What a rewrite may change: words to remove, words and characters to add, pauses."""
    pauses = F.transform(F.regexp_extract_all(F.coalesce(words_with_silence, F.lit("")), F.lit(r"<\s*([0-9]*\.?[0-9]+)\s*s?\s*>"), F.lit(1)), lambda p: p.cast("double"))
    none = F.coalesce(F.array_max(pauses), F.lit(0.0)) < 0.08
    delta = F.greatest(F.lit(0), F.when(mode == "shorter", current_ms - target_ms).otherwise(target_ms - current_ms)) / 1000.0
    short = mode == "shorter"
    i = lambda c: c.cast("int")
    return F.struct(F.when(short, i(F.least(F.lit(10), F.floor(delta * 1.8 + 0.999)))).alias("max_words_removed"), F.when(~short, i(F.greatest(F.lit(2), F.floor(delta * 4.0 + 0.999)))).alias("max_words_added"), F.when(~short, i(F.greatest(F.lit(18), F.floor(delta * 28.0 + 0.5)))).alias("max_chars_added"), F.when(~short, F.when(none, 0).when(delta <= 0.6, 1).when(delta <= 1.2, 2).otherwise(3)).alias("allowed_breaks"), F.when(~short, delta <= 0.28).alias("punctuation_only"))


def rewrite_gate(rows: DataFrame, fill: float = 0.8, similarity: float = 0.55, word_ratio: float = 0.66, precision: float = 0.72, score: float = 0.9, drop: float = 0.03) -> DataFrame:
    """Adds metrics, reject_reason and accepted. rows: source, rewritten, mode, baseline_ms, rewritten_ms, target_ms, baseline_score, rewritten_score, has_extra_tail, has_suffix (scores null without an evaluation).

    source_words, the word tokens of source, may come with the rows: they are then not found again for each rewrite.
    """
    words = F.col("source_words") if "source_words" in rows.columns else T.word_tokens(F.col("source"))
    kept = [F.col(f"`{n}`") for n in rows.columns if n != "source_words"]
    # Exploded, so that the words are found once and not again for each metric.
    r = rows.select(*kept, F.explode(F.array(F.struct(words.alias("a"), T.word_tokens(F.col("rewritten")).alias("b")))).alias("_w"))
    a, b = F.col("_w.a"), F.col("_w.b")
    found = V.token_precision(a, b)  # not read back from its column, which would be filled for rows that are rejected before
    r = r.withColumn("_n", F.size(a)).withColumn("text_similarity", V.words_ratio(a, b)).withColumn("token_precision", found)
    r = r.withColumn("word_ratio", F.size(b) / F.greatest(F.lit(1), F.col("_n"))).withColumn("fill_ratio", F.col("rewritten_ms") / F.greatest(F.lit(1), F.col("target_ms"))).withColumn("duration_ratio", F.col("rewritten_ms") / F.greatest(F.lit(1), F.col("baseline_ms")))
    c, short, scored, base = F.col, F.col("mode") == "shorter", F.col("rewritten_score").isNotNull(), F.col("baseline_score").isNotNull()
    reason = (
        F.when(short & (c("fill_ratio") < fill), "underfill")
        .when(short & (c("_n") >= 5) & (c("word_ratio") < word_ratio), "word_ratio")
        .when(short & (c("_n") >= 4) & (c("text_similarity") < similarity), "text_similarity")
        .when(short & (c("_n") >= 4) & (found < precision), "token_precision")
        .when(scored & c("has_extra_tail"), "extra_tail")
        .when(scored & ~c("has_suffix"), "missing_suffix")
        .when(scored & (c("rewritten_score") < score), "asr_score")
        .when(scored & base & (c("rewritten_score") < c("baseline_score") - drop), "asr_drop")
        .when(scored & base & (c("mode") == "longer") & (c("rewritten_score") + 0.01 < c("baseline_score")), "asr_not_preserved")
    )
    return r.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull()).drop("_n", "_w")


def candidate_rank(rows: DataFrame, keep: int = 5) -> DataFrame:
    """Rewrites in order of a score from lengths and shared words. rows: media_id, seg_idx, cand_idx, original_text, candidate, current_ms, target_ms, mode.

    original_words, the word tokens of original_text, may come with the rows: they are then not found again for each candidate.
    """
    norm = lambda x: F.lower(T.normalize_spaces(x))
    words = F.col("original_words") if "original_words" in rows.columns else T.word_tokens(F.col("original_text"))
    # Exploded, so that the filter stays behind the words and they are not found for it again.
    kept = [F.col(f"`{n}`") for n in rows.columns if n != "original_words"]
    r = rows.select(*kept, F.explode(F.array(F.struct(words.alias("a"), T.word_tokens(F.col("candidate")).alias("b")))).alias("_w"))
    a, b = F.col("_w.a"), F.col("_w.b")
    # Texts that are equal but for case and spaces have equal words, so only those with equal words are compared.
    r = r.filter(F.when(a != b, True).otherwise(norm(F.col("candidate")) != norm(F.col("original_text"))))
    short = F.col("mode") == "shorter"
    raw = F.col("target_ms") / F.greatest(F.col("current_ms"), F.lit(1))
    want = F.when(short, F.greatest(F.lit(0.52), F.least(F.lit(0.98), raw))).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1.28), raw)))
    shared = F.size(F.array_intersect(a, b))
    r = r.withColumn("char_ratio", F.length("candidate") / F.greatest(F.lit(1), F.length("original_text"))).withColumn("target_char_ratio", want)
    r = r.withColumn("token_precision", shared / F.greatest(F.lit(1), F.size(F.array_distinct(b)))).withColumn("token_recall", shared / F.greatest(F.lit(1), F.size(F.array_distinct(a)))).withColumn("word_ratio", F.size(b) / F.greatest(F.lit(1), F.size(a))).drop("_w")
    over0 = lambda x, k: F.greatest(F.lit(0.0), x) * k
    c = F.col("char_ratio")
    under = F.when(short, over0(0.62 - c, 2.5)).otherwise(over0(1.0 - c, 2.0))
    over = F.when(short, over0(c - 1.0, 2.0)).otherwise(over0(c - 1.3, 2.5))
    score = F.abs(c - F.col("target_char_ratio")) + under + over + over0(0.72 - F.col("token_precision"), 1.6) + over0(0.66 - F.col("word_ratio"), 1.6)
    r = r.withColumn("score", F.round(score * 10000) / 10000)
    rank = F.row_number().over(Window.partitionBy("media_id", "seg_idx").orderBy("score", "cand_idx"))
    return r.withColumn("rank", rank).filter(F.col("rank") <= keep)


def best_retry_take(takes: DataFrame, perfect: float = 0.995) -> DataFrame:
    """The best of the takes up to the first perfect one: no extra tail, suffix, score, similarity; earlier ones on ties."""
    by = Window.partitionBy("media_id", "seg_idx")
    done = F.when((F.col("score") >= perfect) & ~F.col("has_extra_tail") & F.col("has_suffix"), F.col("attempt"))
    t = takes.withColumn("_stop", F.min(done).over(by)).filter(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
    similarity = F.col("similarity") if "similarity" in takes.columns else F.lit(0.0)
    order = by.orderBy((~F.col("has_extra_tail")).desc(), F.col("has_suffix").desc(), F.col("score").desc(), similarity.desc(), "attempt")
    return t.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_stop")


def retry_eligible(duration_ms: Column, group_size: Column, text: Column, most_ms: int = 2500) -> Column:
    return (F.coalesce(group_size, F.lit(1)) == 1) & (duration_ms <= most_ms) & T.ends_terminal(text)


def retry_reason(score: Column, extra_tail: Column, suffix: Column, least: float = 0.94) -> Column:
    """Why a take should be tried again; empty if it needn't."""
    return F.filter(F.array(F.when(score < least, "low_score"), F.when(extra_tail, "extra_tail"), F.when(~suffix, "missing_suffix")), lambda x: x.isNotNull())


def babble_trim_gate(rows: DataFrame, gain: float = 0.08) -> DataFrame:
    """Accepts a cut tail if recognition got better by enough. rows: trim_ms, score_, similarity_, extra_, suffix_ with before and after."""
    c = F.col
    suspicious = (c("trim_ms") > 0) | c("extra_before") | ~c("suffix_before")
    plain = (c("score_after") >= c("score_before") + gain) & (c("similarity_after") >= c("similarity_before"))
    tail = (c("score_after") >= c("score_before") + gain * 0.5) & (c("similarity_after") + 0.02 >= c("similarity_before"))
    ok = suspicious & (c("trim_ms") > 0) & ~c("extra_after") & c("suffix_after") & F.when(c("extra_before"), tail).otherwise(plain)
    return rows.withColumn("accepted", ok).withColumn("reason", F.when(ok, F.when(c("extra_before"), "extra_tail").otherwise("score_gain")))

"""Words, speaker turns and segments of media: segmentation at pauses, speakers by overlap, sentences, groups and chunks.

Every function is DataFrame to DataFrame; windows and groups are by media item, so that work and state are bounded by the
longest item. Times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .timing import fold


def _gap_mark(ms: Column) -> Column:
    cs = F.floor((ms + 5) / 10).cast("long")
    return F.concat(F.lit(" <"), F.floor(cs / 100).cast("string"), F.lit("."), F.lpad((cs % 100).cast("string"), 2, "0"), F.lit("s>"))


def words_with_silence(words: Column, min_gap_ms: int = 40) -> Column:
    """Words (array of text, start_ms, end_ms in order) joined by spaces, gaps as `<0.15s>`."""

    def mark(w: Column, i: Column) -> Column:
        gap = F.greatest(F.get(words, i + 1)["start_ms"] - w["end_ms"], F.lit(0))
        return F.concat(w["text"], F.when(F.coalesce(gap >= min_gap_ms, F.lit(False)), _gap_mark(gap)).otherwise(""))

    return F.array_join(F.transform(words, mark), " ")


def _segments(words: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """One row per keys from cleaned word rows: text, times, words and what follows from them."""
    w = F.array_sort(F.collect_list(F.struct("word_idx", "text", "start_ms", "end_ms")))
    rows = words.groupBy(*keys).agg(w.alias("w"), F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"), *extra)
    rows = rows.withColumn("words", F.transform("w", lambda x: F.struct(x["text"], x["start_ms"], x["end_ms"])))
    rows = rows.withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " ")).withColumn("words_with_silence", words_with_silence(F.col("words")))
    return rows.withColumn("source_duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).withColumn("source_word_count", F.size("words").cast("long")).drop("w")


def segment_words(words: DataFrame, max_pause_ms: int = 300) -> DataFrame:
    """Words that aren't blank with their segment (seg_idx), the gaps before and after them, and the text with single spaces."""
    by = Window.partitionBy("media_id").orderBy("word_idx")
    w = words.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(by)).withColumn("after", F.lead("start_ms").over(by) - F.col("end_ms"))
    w = w.withColumn("seg_idx", F.sum(F.coalesce(F.col("gap") > max_pause_ms, F.lit(False)).cast("long")).over(by))
    return w.withColumn("text", T.normalize_spaces(F.col("text"))).filter("text <> ''")


def pause_segments(words: DataFrame, max_pause_ms: int = 300, speaker: str = "spk_0") -> DataFrame:
    """Segments split where the gap to the word before is longer than max_pause_ms."""
    w, zero = segment_words(words, max_pause_ms), F.lit(0).cast("long")
    extra = [F.greatest(zero, F.coalesce(F.min_by("gap", "word_idx"), zero)).alias("pause_before_ms"), F.greatest(zero, F.coalesce(F.max_by("after", "word_idx"), zero)).alias("pause_after_ms")]
    return _segments(w, ["media_id", "seg_idx"], extra).withColumn("speaker_id", F.lit(speaker))


def segmented_words(words: DataFrame, max_pause_ms: int = 300) -> DataFrame:
    """Words as given, those that aren't blank, with seg_idx and the pauses around their segment (pause_before_ms, pause_after_ms), as pause_segments has them."""
    zero, by = F.lit(0).cast("long"), Window.partitionBy("media_id", "seg_idx").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = segment_words(words.withColumn("_text", F.col("text")), max_pause_ms)
    w = w.withColumn("pause_before_ms", F.greatest(zero, F.coalesce(F.first("gap").over(by), zero))).withColumn("pause_after_ms", F.greatest(zero, F.coalesce(F.last("after").over(by), zero)))
    return w.withColumn("text", F.col("_text")).drop("_text", "gap", "after")


def normalize_turns(turns: DataFrame, prefix: str = "spk") -> DataFrame:
    """Turns with speaker ids by first appearance; ids that already have the prefix are kept. turns: media_id, start_ms, end_ms, speaker_label [, label, speaker, speaker_id]."""
    have = [c for c in ("speaker_label", "label", "speaker", "speaker_id") if c in turns.columns]
    label = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in have), F.lit("SPEAKER_00"))
    own = F.when(F.col("speaker_id").startswith(f"{prefix}_"), F.col("speaker_id")) if "speaker_id" in have else F.lit(None).cast("string")
    t = turns.filter("end_ms > start_ms").select("media_id", "start_ms", "end_ms", label.alias("speaker_label"), own.alias("_own"))
    first = t.groupBy("media_id", "speaker_label").agg(F.min("start_ms").alias("_first"), F.min_by("_own", "start_ms").alias("_kept"))
    rank = F.row_number().over(Window.partitionBy("media_id").orderBy("_first", "speaker_label")) - 1
    ids = first.select("media_id", "speaker_label", F.coalesce("_kept", F.concat(F.lit(f"{prefix}_"), rank.cast("string"))).alias("_id"))
    return t.join(ids, ["media_id", "speaker_label"]).select("media_id", "start_ms", "end_ms", "speaker_label", F.coalesce("_own", "_id").alias("speaker_id"))


def speaker_overlap(spans: DataFrame, turns: DataFrame, key: str, default: str = "spk_0", bin_ms: int = 10_000) -> DataFrame:
    """spans (media_id, key, start_ms, end_ms, ...) with the speaker that overlaps each for longest, and for how long.

    Spans and turns are dealt out once, by media item; in a window of each time bin the spans see the turns of that bin, each
    pair in its first common bin. Ties go to the speaker whose first overlapping turn is earliest. Spans without overlap get the
    default. What follows by media item finds its rows where they are.
    """
    def bins(start: str, end: str) -> Column:
        each = F.sequence(F.floor(F.col(start) / bin_ms), F.floor(F.greatest(F.col(start), F.col(end) - 1) / bin_ms))
        return F.posexplode(F.coalesce(each, F.array(F.lit(None).cast("long")))).alias("_i", "_bin")

    rest = [c for c in spans.columns if c not in ("media_id", key, "speaker_id", "overlap_ms")]
    turn = F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "speaker_id", F.floor(F.col("start_ms") / bin_ms).alias("b0"))
    left = spans.select("media_id", key, F.struct(*rest).alias("_span"), bins("start_ms", "end_ms"))
    right = turns.select("media_id", turn.alias("_turn"), bins("start_ms", "end_ms")).drop("_i")
    both = left.unionByName(right, allowMissingColumns=True).repartition("media_id")
    near = both.withColumn("_near", F.collect_list("_turn").over(Window.partitionBy("media_id", "_bin"))).filter("_i is not null")  # the spans
    start, end = F.col("_span.start_ms"), F.col("_span.end_ms")
    met = F.filter("_near", lambda t: (F.col("_bin") == F.greatest(F.floor(start / bin_ms), t["b0"])) & (t["s"] < end) & (start < t["e"]))
    met = F.when(F.col("media_id").isNotNull() & F.col(key).isNotNull(), F.transform(met, lambda t: F.struct((F.least(end, t["e"]) - F.greatest(start, t["s"])).alias("ms"), (-t["s"]).alias("first"), t["speaker_id"].alias("speaker_id"))))
    each = near.withColumn("_met", met).groupBy("media_id", key).agg(F.collect_list(F.when(F.col("_i") == 0, F.col("_span"))).alias("_spans"), F.flatten(F.collect_list("_met")).alias("_met"))

    def of_speaker(v: Column, name: Column) -> Column:
        own = F.filter(v, lambda t: t["speaker_id"].eqNullSafe(name))
        return T.bound(own, lambda o: F.struct(F.aggregate(o, F.lit(0).cast("long"), lambda a, t: a + t["ms"]).alias("ms"), F.array_max(F.transform(o, lambda t: t["first"])).alias("first"), name.alias("speaker_id")))

    several = F.array_max(F.transform(F.array_distinct(F.transform("_met", lambda t: t["speaker_id"])), lambda name: of_speaker(F.col("_met"), name)))
    each = each.withColumn("_best", F.when(F.size("_met") > 1, several).otherwise(F.get("_met", F.lit(0))))
    out = each.select("media_id", key, F.explode("_spans").alias("_span"), "_best")
    return out.select("media_id", key, *(F.col("_span")[c].alias(c) for c in rest), F.coalesce("_best.speaker_id", F.lit(default)).alias("speaker_id"), F.coalesce("_best.ms", F.lit(0).cast("long")).alias("overlap_ms"))


def diarized_segments(words: DataFrame, segments: DataFrame | None = None, max_pause_ms: int = 300) -> DataFrame:
    """Segments split where the assigned speaker changes or a pause is long. words: media_id, seg_idx, word_idx, text, start_ms, end_ms, speaker_id; outer pauses come from segments, or without them from pause_before_ms and pause_after_ms of words."""
    by = Window.partitionBy("media_id", "seg_idx").orderBy("word_idx")
    least0 = lambda x: F.when(x < 0, 0).otherwise(x)  # noqa: E731  null stays null, which greatest() would make 0
    w = words.filter("end_ms > start_ms").withColumn("gap", least0(F.col("start_ms") - F.lag("end_ms").over(by)))
    w = w.withColumn("after", least0(F.lead("start_ms").over(by) - F.col("end_ms")))
    cut = (F.col("speaker_id") != F.lag("speaker_id").over(by)) | (F.col("gap") > max_pause_ms)
    w = w.withColumn("split_idx", F.sum(F.coalesce(cut, F.lit(False)).cast("long")).over(by))
    extra = [F.min_by("gap", "word_idx").alias("_before"), F.max_by("after", "word_idx").alias("_after"), F.first("speaker_id").alias("speaker_id")]
    if segments is None:
        extra += [F.first("pause_before_ms").alias("_pb"), F.first("pause_after_ms").alias("_pa")]
    parts = _segments(w, ["media_id", "seg_idx", "split_idx"], extra)
    parts = parts.withColumn("split_count", F.count(F.lit(1)).over(Window.partitionBy("media_id", "seg_idx")))
    if segments is not None:
        outer = segments.select("media_id", "seg_idx", F.col("pause_before_ms").alias("_pb"), F.col("pause_after_ms").alias("_pa"))
        parts = parts.join(outer, ["media_id", "seg_idx"], "left")
    return parts.withColumn("pause_before_ms", F.coalesce("_before", "_pb", F.lit(0).cast("long"))).withColumn("pause_after_ms", F.coalesce("_after", "_pa", F.lit(0).cast("long"))).drop("_before", "_after", "_pb", "_pa")


def diarization_summary(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Per media: counts, and seconds and counts by speaker as maps in order of speakers."""
    per_turn = turns.groupBy("media_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    as_map = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_id", v))))
    a = per_turn.groupBy("media_id").agg(F.sum("n").alias("turn_count"), F.count(F.lit(1)).alias("speaker_count"), as_map("ms").alias("turn_ms_by_speaker"))
    per_seg = segments.groupBy("media_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms"), F.count_if(F.col("split_count") > 1).alias("s"))
    b = per_seg.groupBy("media_id").agg(F.sum("n").alias("segment_count"), F.sum("s").alias("split_segment_count"), as_map("n").alias("segment_count_by_speaker"), as_map("ms").alias("segment_ms_by_speaker"))
    return a.join(b, "media_id", "full")


def speaker_layers(segments: DataFrame, default: str = "spk_0") -> DataFrame:
    """Per media and speaker: segments and end of the last."""
    who = F.coalesce(F.nullif("speaker_id", F.lit("")), F.lit(default)).alias("speaker_id")
    return segments.groupBy("media_id", who).agg(F.count(F.lit(1)).alias("segment_count"), F.max("end_ms").alias("layer_ms"))


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Layers as one list, in order of start and speaker."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "speaker_id", "seg_idx")) - 1
    return out.withColumn("merged_idx", order)


def filter_nonempty_text(segments: DataFrame) -> DataFrame:
    return segments.filter(F.trim("text") != "")


def sentence_projection(segments: DataFrame, pause_ms: int = 500) -> DataFrame:
    """Segments with their sentence: group_idx, group_index (place), group_size, source_sentence, times of the sentence."""
    by = Window.partitionBy("media_id").orderBy("seg_idx")
    s = filter_nonempty_text(segments)
    cut = F.lag(F.trim("text")).over(by).rlike(r"[.!?]\s*$") | (F.col("start_ms") - F.lag("end_ms").over(by) >= pause_ms)
    s = s.withColumn("group_idx", F.sum(F.coalesce(cut, F.lit(False)).cast("long")).over(by))
    g = Window.partitionBy("media_id", "group_idx").orderBy("seg_idx")
    whole = g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("group_index", F.row_number().over(g) - 1).withColumn("group_size", F.count(F.lit(1)).over(whole))
    s = s.withColumn("source_sentence", F.array_join(F.collect_list(F.trim("text")).over(whole), " "))
    return s.withColumn("sentence_start_ms", F.first("start_ms").over(whole)).withColumn("sentence_end_ms", F.last("end_ms").over(whole))


def sentence_groups(segments: DataFrame, pause_ms: int = 500) -> DataFrame:
    """One row per sentence."""
    p = sentence_projection(segments, pause_ms)
    return p.filter("group_index = 0").select("media_id", "group_idx", F.col("source_sentence").alias("text"), F.col("sentence_start_ms").alias("start_ms"), F.col("sentence_end_ms").alias("end_ms"), F.col("group_size"))


def context_neighbours(segments: DataFrame, min_pause_ms: int = 200) -> DataFrame:
    """Previous and next text where the gap is small and the speaker may be the same."""
    by, most = Window.partitionBy("media_id").orderBy("seg_idx"), max(500, min_pause_ms)
    same = lambda f: F.coalesce(f("speaker_id").over(by) == F.col("speaker_id"), F.lit(True))
    before = F.col("start_ms") - F.lag("end_ms").over(by)
    after = F.lead("start_ms").over(by) - F.col("end_ms")
    clean = F.coalesce("cleaned_text", "text") if "cleaned_text" in segments.columns else F.col("text")
    previous = F.when((before <= most) & same(F.lag), F.lag(clean).over(by))
    following = F.when((after <= most) & same(F.lead), F.lead("text").over(by))
    return segments.withColumn("previous_text", F.coalesce(previous, F.lit(""))).withColumn("next_text", F.coalesce(following, F.lit("")))


def request_batches(segments: DataFrame, size: int = 8, context: int = 2) -> DataFrame:
    """Batches of a media item's segments with the texts of `context` rows before and after."""
    by = Window.partitionBy("media_id").orderBy("seg_idx")
    s = segments.withColumn("_n", F.row_number().over(by) - 1).withColumn("batch_idx", F.floor(F.col("_n") / size))
    before = F.transform(F.array_sort(F.collect_list(F.struct("_n", "text")).over(by.rowsBetween(-context, -1))), lambda x: x["text"])
    after = F.transform(F.array_sort(F.collect_list(F.struct("_n", "text")).over(by.rowsBetween(1, context))), lambda x: x["text"])
    s = s.withColumn("_before", before).withColumn("_after", after)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_n", "seg_idx", "text"))), lambda x: F.struct(x["seg_idx"], x["text"]))
    return s.groupBy("media_id", "batch_idx").agg(items.alias("items"), F.min_by("_before", "_n").alias("context_before"), F.max_by("_after", "_n").alias("context_after"))


def continuation_groups(segments: DataFrame, max_gap_ms: int = 600, max_segments: int = 2, max_chars: int = 180, max_ms: int = 8500) -> DataFrame:
    """Neighbouring segments merged where the next goes on with the sentence; a fold, since each merge changes what the next sees.

    The state is the open group, of at most max_segments segments; closed groups leave it, so time grows with the segments.
    """
    item = F.struct("seg_idx", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("original_text", F.lit("")).alias("original_text"), F.nullif("speaker_id", F.lit("")).alias("speaker_id"))
    rows = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("s"))

    def one(x: Column) -> Column:
        return F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"), x["original_text"].alias("original_text"), x["speaker_id"].alias("speaker_id"), F.array(x["seg_idx"]).alias("indices"), F.lit(0).cast("long").alias("gap_ms"))

    def joins(g: Column, x: Column) -> Column:
        gap, same = x["start_ms"] - g["end_ms"], F.coalesce(g["speaker_id"] == x["speaker_id"], F.lit(True))
        gt, go, xt, xo = F.trim(g["text"]), F.trim(g["original_text"]), F.trim(x["text"]), F.trim(x["original_text"])
        lower = T.starts_lower(xt) | T.starts_lower(xo)
        goes_on = T.ends_continuation(gt) | T.ends_continuation(go) | lower
        ended = T.ends_terminal(gt) & T.ends_terminal(go) & ~lower
        fits = (F.size(g["indices"]) < max_segments) & gap.between(0, max_gap_ms) & (F.greatest(x["end_ms"] - g["start_ms"], F.lit(0)) <= max_ms)
        return fits & same & (F.length(T.join_segment_text(gt, xt)) <= max_chars) & goes_on & ~ended

    def merged(g: Column, x: Column) -> Column:
        return F.struct(g["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), T.join_segment_text(g["text"], x["text"]).alias("text"), T.join_segment_text(g["original_text"], x["original_text"]).alias("original_text"), F.coalesce(g["speaker_id"], x["speaker_id"]).alias("speaker_id"), F.concat(g["indices"], F.array(x["seg_idx"])).alias("indices"), (g["gap_ms"] + F.greatest(x["start_ms"] - g["end_ms"], F.lit(0))).alias("gap_ms"))

    group = "struct<start_ms:bigint,end_ms:bigint,text:string,original_text:string,speaker_id:string,indices:array<bigint>,gap_ms:bigint>"
    none = F.array().cast(f"array<{group}>")

    def step(g: Column, x: Column) -> tuple[Column, Column]:
        goes_on = g.isNotNull() & joins(g, x)
        return F.when(goes_on, merged(g, x)).otherwise(one(x)).cast(group), F.when(g.isNull() | goes_on, none).otherwise(F.array(g))

    folded = fold(F.col("s"), F.lit(None).cast(group), step, group, lambda g: F.array(g))
    out = rows.select("media_id", F.posexplode(folded).alias("group_idx", "g")).select("media_id", "group_idx", "g.*")
    return out.withColumn("group_size", F.size("indices"))


def text_chunks(x: Column, max_chars: int = 150) -> Column:
    """A text in chunks of at most max_chars: at ends of sentences, else of clauses, else between words."""
    text = T.normalize_spaces(x)
    parts = lambda v, marks: F.filter(F.transform(F.split(v, rf"(?<=[{marks}])\s+"), lambda p: F.trim(p)), lambda p: p != "")

    def pack(units: Column) -> Column:
        """Units joined by spaces as long as they fit; the state is the open chunk."""

        def step(open_: Column, u: Column) -> tuple[Column, Column]:
            fits = open_.isNotNull() & (F.length(open_) + F.length(u) < max_chars)
            return F.when(fits, F.concat_ws(" ", open_, u)).otherwise(u), F.when(fits | open_.isNull(), F.array().cast("array<string>")).otherwise(F.array(open_))

        return T.bound(units, lambda v: fold(v, F.lit(None).cast("string"), step, "string", lambda last: F.array(last)))

    by_words = lambda v: pack(F.split(v, " "))
    clause = lambda v: F.when(F.length(v) <= max_chars, F.array(v)).otherwise(by_words(v))
    sentence = lambda v: F.when(F.length(v) <= max_chars, F.array(v)).otherwise(F.flatten(F.transform(parts(v, ",;:"), clause)))
    units = F.flatten(F.transform(parts(text, ".!?"), sentence))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= max_chars, F.array(text)).otherwise(pack(units))


def chunk_word_split(segments: DataFrame, max_chars: int = 150) -> DataFrame:
    """Long segments in chunks, the words dealt to them in proportion; times from words, else by the chunks' lengths."""
    s = segments.withColumn("_c", text_chunks(F.col("text"), max_chars)).filter(F.size("_c") > 0)
    sizes = F.transform("_c", lambda c: F.greatest(F.lit(1), T.split_count(c)))
    n, total = F.size("words"), F.aggregate(sizes, F.lit(0), lambda a, v: a + v)

    def take(acc: Column, size: Column) -> Column:
        left, chunks_left = n - acc["at"], F.size("_c") - F.size(acc["out"])
        share = F.greatest(F.lit(1), F.bround(n * (size / total), 0).cast("int"))
        k = F.when(chunks_left == 1, left).otherwise(F.least(share, F.greatest(F.lit(1), left - (chunks_left - 1))))
        return F.struct((acc["at"] + k).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + 1).alias("first"), F.greatest(k, F.lit(0)).alias("n")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,n:int>>").alias("out"))
    s = s.withColumn("_t", F.aggregate(sizes, start, take, lambda a: a["out"])).withColumn("_times", interpolated_chunk_times(F.col("_c"), F.col("start_ms"), F.col("end_ms")))
    rows = s.select("media_id", "seg_idx", "words", "start_ms", "end_ms", "pause_before_ms", "pause_after_ms", "_t", "_times", F.size("_c").alias("chunk_count"), F.posexplode("_c").alias("chunk_idx", "text"))
    i = F.col("chunk_idx")
    own = F.slice(F.col("words"), F.element_at("_t", i + 1)["first"], F.element_at("_t", i + 1)["n"])
    rows = rows.withColumn("_w", F.when((F.col("chunk_count") > 1) & (F.size("words") > 0), own).otherwise(F.col("words")))
    has = (F.size("_w") > 0) & (F.col("chunk_count") > 1)
    begin = F.when(has, F.element_at("_w", 1)["start_ms"]).otherwise(F.element_at("_times", i + 1)["start_ms"])
    end = F.when(has, F.element_at("_w", -1)["end_ms"]).otherwise(F.element_at("_times", i + 1)["end_ms"])
    zero = F.lit(0).cast("long")
    return rows.select("media_id", "seg_idx", "chunk_idx", "chunk_count", "text", begin.alias("start_ms"), end.alias("end_ms"), F.col("_w").alias("words"), words_with_silence(F.col("_w")).alias("words_with_silence"), F.when(F.size("_w") > 0, F.size("_w")).otherwise(F.greatest(F.lit(1), T.split_count(F.col("text")))).alias("source_word_count"), F.when(i == 0, F.col("pause_before_ms")).otherwise(zero).alias("pause_before_ms"), F.when(i == F.col("chunk_count") - 1, F.col("pause_after_ms")).otherwise(zero).alias("pause_after_ms"))


def interpolated_chunk_times(chunks: Column, start_ms: Column, end_ms: Column) -> Column:
    """Times of chunks in proportion to their characters; the last ends with the segment."""
    span = F.greatest(end_ms - start_ms, F.lit(0))
    sizes = F.transform(chunks, lambda c: F.greatest(F.length(c), F.lit(1)))
    total = F.aggregate(sizes, F.lit(0), lambda a, v: a + v)
    upto = lambda i: start_ms + F.bround(span * F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, v: a + v) / total, 0).cast("long")
    return F.transform(chunks, lambda c, i: F.struct(upto(i).alias("start_ms"), F.when(i == F.size(chunks) - 1, end_ms).otherwise(upto(i + 1)).alias("end_ms")))


def dedupe_keep_first(rows: DataFrame, scope: list[str], order: str, text: str) -> DataFrame:
    """The first of rows that differ in case only."""
    first = F.row_number().over(Window.partitionBy(*scope, F.lower(text)).orderBy(order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")

"""Jobs, artifacts, configurations and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Steps in order and the artifacts that each leaves, with their kinds.
STEP_ARTIFACTS = {
    "preprocess": (("original_audio", "file"), ("vocals", "file"), ("background", "file"), ("vocals_processed", "file")),
    "asr": (("segments", "json_list"), ("speaker_ref", "file")),
    "translate": (("translated_segments", "json_list"),),
    "tts": (("final_voice", "file"), ("translated_segments", "json_list")),
    "postprocess": (("final_mix", "file"), ("final_video", "file")),
    "metrics": (("metrics_summary", "json_object"), ("run_report", "file")),
}
#: Patterns of artifacts that are listed, in order.
ARTIFACT_PATTERNS = ("final_video.mp4", "final_mix.wav", "final_dubbing.wav", "metrics.json", "run_report.md", "segments.json", "translated_segments.json", "translated_segments.clean.json", "translation_quality.json", "elevenlabs_voice.json", "subtitles/*")


def latest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs; ties by job_id."""
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def job_merge(updates: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Partial updates as one row per job: the latest value that isn't null."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return updates.groupBy("job_id").agg(*latest)


def missing_artifacts(artifacts: DataFrame, jobs: DataFrame, contract: DataFrame) -> DataFrame:
    """Per job and step the artifacts of the contract (step, artifact, kind) that aren't there (job_id, artifact, size, items)."""
    ready = F.when(F.col("kind") == "file", F.col("size") >= 1).otherwise(F.col("items") >= 1)
    fixed = F.broadcast(contract)  # a short fixed list
    have = artifacts.filter("job_id is not null").join(fixed, "artifact").select("job_id", "step", "artifact", F.coalesce(ready, F.lit(False)).alias("_ready"), F.lit(False).alias("_asked"))
    want = jobs.select("job_id").crossJoin(fixed).select("job_id", "step", "artifact", F.lit(None).cast("boolean").alias("_ready"), F.lit(True).alias("_asked"))
    # one deal, by job: what follows by job finds its rows where they are
    each = have.unionByName(want).repartition("job_id").groupBy("job_id", "step", "artifact").agg(F.count_if(F.col("_asked")).alias("_n"), F.count("_ready").alias("_k"), F.count_if(~F.col("_ready")).alias("_bad")).filter("_n > 0")
    times = (F.col("_n") * F.when(F.col("_k") == 0, 1).otherwise(F.col("_bad"))).cast("int")  # a job or artifact that is given more than once counts as often
    return each.groupBy("job_id", "step").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("artifact", times)))).alias("missing"))


def contract(spark, subtitle_mode: str | None = None) -> DataFrame:
    rows = [(s, a, k) for s, specs in STEP_ARTIFACTS.items() for a, k in specs]
    if subtitle_mode:
        rows += [("subtitles", f"subtitles_{x}", "file") for x in ("srt", "vtt", "ass")]
        if subtitle_mode in ("soft", "hard"):
            rows.append(("subtitles", f"video_{subtitle_mode}", "file"))
    return spark.createDataFrame(rows, "step string, artifact string, kind string")


def resume_plan(missing: DataFrame, forced: DataFrame, steps: list[str], skip_metrics: bool = False) -> DataFrame:
    """Which steps run: incomplete or forced ones, and all behind one that runs. forced: job_id, step."""
    steps = [s for s in steps if not (skip_metrics and s == "metrics")]
    number = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    m = missing.filter(F.col("step").isin(steps)).withColumn("step_no", number).join(forced.groupBy("job_id").agg(F.collect_set("step").alias("_steps")), "job_id", "left")
    m = m.withColumn("_f", F.array_contains("_steps", F.col("step")))
    by = Window.partitionBy("job_id").orderBy("step_no")
    own = (F.size("missing") > 0) | F.coalesce("_f", F.lit(False))
    m = m.withColumn("_own", own).withColumn("_up", F.coalesce(F.max(own).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    reason = F.when(F.coalesce("_f", F.lit(False)), "forced").when(F.col("_up"), "upstream").when(F.size("missing") > 0, "incomplete").otherwise("complete")
    return m.select("job_id", "step", "step_no", (F.col("_own") | F.col("_up")).alias("run"), reason.alias("reason"))


def artifact_first_match(files: DataFrame, patterns: tuple[str, ...] = ARTIFACT_PATTERNS) -> DataFrame:
    """Files (job_id, path) with the first pattern they match; `*` stands for anything but a slash. Others are left out."""
    rx = lambda p: "^" + p.replace(".", r"\.").replace("*", "[^/]*") + "$"
    first = F.coalesce(*(F.when(F.col("path").rlike(rx(p)), i) for i, p in enumerate(patterns)))
    return files.withColumn("pattern_no", first).filter("pattern_no is not null")


def config_flatten(configs: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Named settings of a nested JSON configuration as columns; null where missing."""
    return configs.select(*[c for c in configs.columns if c != column], *(F.get_json_object(column, f"$.{path}").alias(name) for name, path in fields.items()))


def config_rows(flat: DataFrame, key: str) -> DataFrame:
    """The same as rows (key, setting, value)."""
    names = [c for c in flat.columns if c != key]
    return flat.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), F.col(n).cast("string").alias("value")) for n in names))).alias("s")).select(key, "s.*")


def profile_results(metrics: DataFrame, config: DataFrame, summary: DataFrame) -> DataFrame:
    """Metrics, settings and synthesis summary of each job."""
    return metrics.join(config, "job_name").join(summary, "job_name", "left")


def answer_reconcile(answers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejected): a batch is taken only if its answer has the requested ids in order, each with a text. answers: batch_id, answer; requests: batch_id, item_id (0..n-1)."""
    parsed = F.from_json(T.parse_answer_json(F.col("answer")), "array<struct<id:bigint,translation:string>>")
    a = answers.select("batch_id", F.posexplode_outer(parsed).alias("pos", "x")).select("batch_id", F.col("pos").cast("long").alias("item_id"), F.col("x.id").alias("id"), F.trim("x.translation").alias("text"))
    a = a.withColumn("_there", F.lit(True))
    r = requests.select("batch_id", F.col("item_id").cast("long").alias("item_id")).withColumn("_asked", F.lit(True))
    j = a.filter("item_id is not null").join(r, ["batch_id", "item_id"], "full")
    count_ok = F.col("_there").isNotNull() & F.col("_asked").isNotNull()
    checks = j.groupBy("batch_id").agg(F.bool_and(count_ok).alias("n"), F.bool_and(F.coalesce(F.col("id") == F.col("item_id"), F.lit(False))).alias("i"), F.bool_and(F.coalesce(F.col("text") != "", F.lit(False))).alias("t"))
    reason = F.when(~F.col("n"), "item_count").when(~F.col("i"), "item_order").when(~F.col("t"), "empty_text")
    checks = checks.select("batch_id", reason.alias("reason"))
    good = j.join(checks.filter("reason is null"), "batch_id", "left_semi").select("batch_id", "item_id", "text")
    return good, checks.filter("reason is not null")


def subtitle_cues(segments: DataFrame, kind: str, use_original: bool = False) -> DataFrame:
    """Numbered cues (media_id, cue_no, cue) of non-empty texts, as `srt`, `vtt` or `ass`."""
    text = F.trim(F.coalesce(F.col("original_text" if use_original else "text"), F.lit("")))
    s = segments.withColumn("_t", text).filter("_t <> ''").withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")))
    return s.select("media_id", "cue_no", _cue(kind).alias("cue"))


def _cue(kind: str) -> Column:
    a, z = F.col("start_ms"), F.col("end_ms")
    if kind == "srt":
        return F.concat(F.col("cue_no").cast("string"), F.lit("\n"), T.srt_time(a), F.lit(" --> "), T.srt_time(z), F.lit("\n"), F.col("_t"), F.lit("\n"))
    if kind == "vtt":
        return F.concat(T.vtt_time(a), F.lit(" --> "), T.vtt_time(z), F.lit("\n"), F.col("_t"), F.lit("\n"))
    safe = F.replace(F.replace(F.replace(F.col("_t"), F.lit("\n"), F.lit("\\N")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.concat(F.lit("Dialogue: 0,"), T.ass_time(a), F.lit(","), T.ass_time(z), F.lit(",Default,,0,0,0,,"), safe)


#: Fixed values of the format: what stands before the events of an ASS file.
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\nStyle: Default,{font},{size},&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,30,1\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def subtitle_documents(cues: DataFrame, kind: str, font: str = "Arial", size: int = 24) -> DataFrame:
    """One document per media."""
    head = {"srt": "", "vtt": "WEBVTT\n\n"}.get(kind)
    if head is None:
        head = ASS_HEAD.format(font=font, size=size)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "cue"))), lambda x: x["cue"]), "\n")
    return cues.groupBy("media_id").agg(F.concat(F.lit(head), body, F.lit("\n" if kind == "ass" else "")).alias("document"))

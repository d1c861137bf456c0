"""Text functions, timing rules and other expressions on single values."""

import difflib

import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import vectors as V
from segloom.operators import audio as A
from segloom.operators import jobs as J
from segloom.operators import quality as Q
from segloom.operators import timing as M


@pytest.fixture(scope="module")
def val(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


def test_times(val):
    assert val(T.srt_time(F.lit(3_599_999))) == "00:59:59,999"
    assert val(T.srt_time(F.lit(-5))) == "00:00:00,000"
    assert val(T.vtt_time(F.lit(360_000_000))) == "100:00:00.000"
    assert val(T.ass_time(F.lit(59_996))) == "0:01:00.00"


def test_terminal_marks(val):
    assert val(T.ends_terminal(F.lit('He said "yes." ')))
    assert val(T.ends_continuation(F.lit("and then -")))
    assert val(T.starts_lower(F.lit("«да")))
    assert not val(T.starts_lower(F.lit("42")))
    assert val(T.replace_terminal(F.lit("Well..."), "!")) == "Well!"
    assert val(T.preferred_terminal(F.lit("Why?»"))) == "?"


def test_stabilize(val):
    go = lambda *a, **k: val(T.stabilize_text(*(F.lit(x) for x in a), **k))
    assert go("Go on,", "Go on.", "", None, 0, 1) == "Go on."
    assert go("Go on", "Go on", "and on", None, 900, 1) == "Go on"
    assert go("Go on", "", "", None, 300, 1) == "Go on."
    assert go("Go on", "Go on.", "", None, 0, 2) == "Go on"


def test_retry_variants(val):
    v = T.retry_variants(F.lit("Are you sure?"), F.lit("Sure?"), F.lit(""), F.lit(None).cast("long"), F.lit(0), F.lit(1), F.lit("XTTS"))
    assert val(v) == ["Are you sure?", "Are you sure!", "Are you sure_"]


def test_answers(val):
    assert val(T.clean_model_answer(F.lit('{"translation": "Перевод: да"}'), "rus_Cyrl")) == "да"
    assert val(T.parse_answer_json(F.lit("<think>[1]</think> so: [{\"id\": 0}] ok"))) == '[{"id": 0}]'
    assert val(T.extract_candidates(F.lit('{"candidates": ["One", "one", "Two"]}'))) == ["One", "Two"]
    assert val(T.extract_candidates(F.lit("- a\n2) b"))) == ["a", "b"]


def test_names_and_durations(val):
    assert val(T.job_name(F.lit("/x/video_My clip.v2.mp4"))) == "My_clip.v2"
    assert val(T.job_name(F.lit("/x/...mp4"))) in (None, "mp4")
    assert val(T.format_duration(F.lit(75.25))) in ("1m 15.2s", "1m 15.3s")
    assert val(T.format_duration(F.lit(None).cast("double"))) == "n/a"
    assert val(T.language_name(F.lit("rus_Cyrl"))) == "Russian"


def test_pairs_and_replacements(val):
    p = T.parse_pairs(F.array(F.lit("a.b -> c$1"), F.lit("none")))
    assert val(T.apply_replacements(F.lit("x A.B aXb"), p)) == "x c$1 aXb"


@pytest.mark.parametrize("f", [0.1, 0.5, 0.9, 1.0, 2.0, 2.5, 9.0])
def test_tempo(val, f):
    chain = val(T.tempo_chain(F.lit(f)))
    product = 1.0
    for x in chain:
        assert 0.5 <= x <= 2.0
        product *= x
    assert product == pytest.approx(f)


def test_extension(val):
    go = lambda n, b, a: tuple(val(M.allocate_extension(F.lit(n), F.lit(b), F.lit(a))))
    assert go(200, 500, 500) == (100, 100)
    assert go(400, 50, 500) == (50, 350)
    assert go(400, 500, 50) == (350, 50)
    assert go(0, 5, 5) == (0, 0)


def test_windows_push_the_next_start(spark):
    s = spark.createDataFrame([(1, 0, 1000, 2000, 1500, 1400), (1, 1, 2100, 3000, 900, 900)], "media_id long, seg_idx long, start_ms long, end_ms long, needed_ms long, actual_ms long")
    got = M.timing_windows(s).orderBy("seg_idx").collect()
    assert (got[0].before_ms, got[0].after_ms, got[0].cur_start_ms) == (250, 250, 750)
    assert got[1].cur_start_ms == 2150


def test_trims(val):
    assert val(M.safe_tail_trim(F.lit(1000), F.lit(1500), F.lit(400))) == 300
    assert val(M.safe_tail_trim(F.lit(3000), F.lit(3500), F.lit(400))) == 0
    assert tuple(val(M.edge_trim_plan(F.lit(1000), F.lit(300), F.lit(100)))) == (210, 0)


def test_gate_order(spark):
    rows = [("one two three four five", "one", "shorter", 1000, 900, 1000, 0.95, 0.95, False, True), ("one two three four five", "one two three four five", "shorter", 1000, 500, 1000, 0.95, 0.95, False, True), ("a b", "a b", "longer", 1000, 1200, 1000, 0.95, 0.91, False, True)]
    d = spark.createDataFrame(rows, "source string, rewritten string, mode string, baseline_ms long, rewritten_ms long, target_ms long, baseline_score double, rewritten_score double, has_extra_tail boolean, has_suffix boolean")
    assert [r.reject_reason for r in M.rewrite_gate(d).collect()] == ["word_ratio", "underfill", "asr_drop"]


def test_sequence_functions(val, spark):
    d = spark.createDataFrame([("Hello big world", "hello world again now")], "a string, b string")
    r = d.select(V.recognition_score("a", "b").alias("s"), V.sequence_ratio("a", "b").alias("q")).first()
    assert r.q == pytest.approx(difflib.SequenceMatcher(None, "hello big world", "hello world again now").ratio())
    assert not r.s.has_suffix and not r.s.has_extra_tail
    tokens = lambda t: F.split(F.lit(t), " ")
    assert val(V.suffix_anchor(tokens("a b c"), tokens("x b c d")))
    assert val(V.extra_trailing(tokens("a b c"), tokens("a b c d")))
    assert tuple(val(V.token_overlap(tokens("a a b"), tokens("a c")))) == (1, 1 / 3, 0.5)


def test_word_error_rate(spark):
    d = spark.createDataFrame([(1, "a b c d", "a x c"), (2, "same", "same")], "media_id long, reference string, recognized string")
    assert [(r.wer, round(r.cer, 4)) for r in Q.wer_cer(d).orderBy("media_id").collect()] == [(0.5, 0.4286), (0.0, 0.0)]


def test_levels(val):
    assert val(A.gain_to_target(F.lit(-50.0), F.lit(-20.0))) == 6.0
    assert val(A.gain_to_target(F.lit(None).cast("double"), F.lit(-20.0))) is None
    assert val(A.peak_ceiling_gain(F.lit(-1.0))) == -1.0


def test_overlay_sums_clips_and_overwrites(spark):
    p = spark.createDataFrame([(1, 0, [30000, 1]), (1, 0, [30000, 1]), (1, 3, [5])], "media_id long, start_frame long, values array<int>")
    r = spark.createDataFrame([(1, 1, [9])], "media_id long, start_frame long, values array<int>")
    assert [x.value for x in A.timeline_overlay(p, r, 6).orderBy("frame").collect()] == [32767, 9, 0, 5, 0, 0]


def test_islands(spark):
    f = spark.createDataFrame([(1, i, 100.0 if i in (2, 3, 12) else 0.0, 1, 10.0) for i in range(20)], "media_id long, frame_idx long, sq_sum double, n long, peak double")
    got = A.nonsilent_islands(f, hop_ms=5, min_silence_ms=20, full_scale=100.0).orderBy("start_ms").collect()
    assert len(got) == 2 and got[0].start_ms <= 10 < 20 <= got[0].end_ms


def test_answers_are_all_or_nothing(spark):
    a = spark.createDataFrame([(1, '[{"id":0,"translation":"a"},{"id":1,"translation":"b"}]'), (2, '[{"id":0,"translation":"a"}]'), (3, "no json"), (4, '[{"id":1,"translation":"a"}]'), (5, '[{"id":0,"translation":" "}]')], "batch_id long, answer string")
    r = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0)], "batch_id long, item_id long")
    good, bad = J.answer_reconcile(a, r)
    assert [tuple(x) for x in good.orderBy("item_id").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert {x.batch_id: x.reason for x in bad.collect()} == {2: "item_count", 3: "item_count", 4: "item_order", 5: "empty_text"}


def test_resume(spark):
    jobs = spark.createDataFrame([(1,)], "job_id long")
    have = spark.createDataFrame([(1, a, 1, 1) for s, specs in J.STEP_ARTIFACTS.items() for a, _ in specs if a != "final_voice"], "job_id long, artifact string, size long, items long")
    forced = spark.createDataFrame([], "job_id long, step string")
    plan = J.resume_plan(J.missing_artifacts(have, jobs, J.contract(spark)), forced, list(J.STEP_ARTIFACTS)).orderBy("step_no").collect()
    assert [r.reason for r in plan] == ["complete", "complete", "complete", "incomplete", "upstream", "upstream"]


def test_subtitles(spark):
    s = spark.createDataFrame([(1, 0, "a{b}", 0, 1500), (1, 1, " ", 1500, 1600), (1, 2, "c", 2000, 3000)], "media_id long, seg_idx long, text string, start_ms long, end_ms long")
    doc = J.subtitle_documents(J.subtitle_cues(s, "srt"), "srt").first().document
    assert doc == "1\n00:00:00,000 --> 00:00:01,500\na{b}\n\n2\n00:00:02,000 --> 00:00:03,000\nc\n"
    assert "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,a\\{b\\}" in J.subtitle_documents(J.subtitle_cues(s, "ass"), "ass").first().document


def test_batches_are_halved(spark):
    from segloom.operators.models import batched_model_map

    def many(x):
        if "bad" in x:
            raise ValueError
        return [v + "!" for v in x]

    d = spark.createDataFrame([(v,) for v in ("a", "bad", "c")], "t string").coalesce(1)
    assert [r.result for r in batched_model_map(d, "t", many, lambda v: v + "?").collect()] == ["a?", "bad?", "c?"]


def test_a_window_computes_each_value_once(spark):
    """The plan of a step holds each value once; it had 4,647 names of lambda variables, and a segment took as long."""
    s = spark.createDataFrame([(1, 0, 0, 1000, 1500, 1200)], "media_id long, seg_idx long, start_ms long, end_ms long, needed_ms long, actual_ms long")
    assert M.timing_windows(s)._jdf.queryExecution().optimizedPlan().toString().count("lambda") < 500

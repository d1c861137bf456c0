"""Streams, plans, readers and writers."""

import json

from pyspark.sql import functions as F

from segloom import plans, streaming
from segloom.sources import transcripts as R

W = "media_id long, word_idx long, text string, start_ms long, end_ms long"
ROWS = [(1, 0, "a", 0, 100), (1, 1, "b", 400, 500), (1, 2, "c", 801, 900), (2, 0, "d", 0, 50)]


def test_stream_of_words(spark, tmp_path):
    spark.createDataFrame(ROWS, W).write.json(str(tmp_path / "in"))
    stream = streaming.pause_segments(spark.readStream.schema(W).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("segs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.media_id, r.text) for r in spark.table("segs").collect()} == {(1, "a b"), (1, "c"), (2, "d")}


def test_issue_counts(spark):
    d = spark.createDataFrame([(0, ["x", "y"]), (10, ["x"]), (4000, ["x"])], "s long, issues array<string>").withColumn("at", F.timestamp_seconds("s"))
    assert {(r.issue, r.n) for r in streaming.qa_counts(d).collect()} == {("x", 2), ("y", 1), ("x", 1)}


def test_plan(spark):
    turns = spark.createDataFrame([(1, 0, 450, "A"), (1, 450, 900, "B")], "media_id long, start_ms long, end_ms long, speaker_label string")
    t, s = plans.diarized(spark.createDataFrame(ROWS, W), turns)
    assert t.count() == 2
    assert [(r.text, r.speaker_id) for r in s.filter("media_id = 1").orderBy("start_ms").collect()] == [("a b", "spk_0"), ("c", "spk_1")]


def test_files(spark, tmp_path):
    for m, body in (("m1", [{"text": "hi", "start": 0.1, "end": 1.25, "speaker_id": "x"}, {"text": "yo", "start": 2, "end": 3}]), ("m2", [])):
        (tmp_path / "s" / m).mkdir(parents=True)
        (tmp_path / "s" / m / "segments.json").write_text(json.dumps(body))
    s = R.read_segments(spark, f"{tmp_path}/s/*/segments.json")
    assert [(r.media_id, r.seg_idx, r.start_ms, r.end_ms) for r in s.orderBy("seg_idx").collect()] == [("m1", 0, 100, 1250), ("m1", 1, 2000, 3000)]
    want = spark.createDataFrame([("m1",), ("m2",)], "media_id string")
    assert [r.media_id for r in R.missing_media(s, want).collect()] == ["m2"]
    R.write_segments(s.drop("words"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    many = spark.range(300).selectExpr("id % 100 as media_id", "id as seg_idx", "'x' as text")
    R.write_segments(many, f"{tmp_path}/many", files=5)
    assert 1 < len(list((tmp_path / "many").glob("*.json"))) <= 5
    homes = spark.read.json(f"{tmp_path}/many").select("media_id", F.input_file_name().alias("f")).distinct()
    assert homes.count() == 100
    (tmp_path / "t" / "m1").mkdir(parents=True)
    (tmp_path / "t" / "m1" / "turns.json").write_text('{"turns": [{"start": 0, "end": 1.5, "speaker": "A"}]}')
    (tmp_path / "t" / "m2").mkdir()
    (tmp_path / "t" / "m2" / "turns.json").write_text('"none"')
    t, bad = R.read_turns(spark, f"{tmp_path}/t/*/turns.json")
    assert [(r.media_id, r.end_ms, r.speaker) for r in t.collect()] == [("m1", 1500, "A")] and [r.media_id for r in bad.collect()] == ["m2"]
    (tmp_path / "w" / "m1").mkdir(parents=True)
    (tmp_path / "w" / "m1" / "a.json").write_text('{"segments": [{"words": []}], "words": [{"text": "flat", "start": 0.5, "end": 1}]}')
    assert [(r.text, r.start_ms) for r in R.read_transcript_words(spark, f"{tmp_path}/w/*/a.json").collect()] == [("flat", 500)]


def test_small_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for n in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / "v" / n).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in R.list_media(spark, f"{tmp_path}/v", ["mp4", ".mkv"]).collect()] == ["a.mkv", "b.MP4"]
    (tmp_path / "p.json").write_text('{"profiles": {"Drama": {"tone": "soft"}, "bad": 1}}')
    assert [(r.profile, r.settings) for r in R.read_profiles(spark, f"{tmp_path}/p.json").collect()] == [("drama", '{"tone":"soft"}')]
    (tmp_path / "m.json").write_text('{"job_name": "j", "metrics": {"wer": 0.1}, "tts_config": 3}')
    assert tuple(R.read_run_metrics(spark, f"{tmp_path}/m.json").select("job_name", "metrics", "tts_config").first()) == ("j", '{"wer":0.1}', "{}")
    R.write_manifests(spark.createDataFrame([("train", "a.wav", "t", "n")], "split string, audio_file string, text string, speaker_name string"), f"{tmp_path}/man")
    assert spark.read.text(f"{tmp_path}/man").select("value").first()[0] == "a.wav|t|n"

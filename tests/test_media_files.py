"""The data source of media documents: rows, rejected documents, pushed filters, ranges, and what a failed job leaves."""

import json

import pytest
from pyspark.sql import functions as F

from segloom.sources import media_files as M
from segloom.sources import transcripts as R

SEGMENTS = [{"text": "hi", "start": 0.1, "end": 1.25, "speaker_id": "x"}, {"text": 5, "start": 2, "end": True}, "odd", {"word": "w", "text": "t"}]


def put(root, media_id, body, name="a.json"):
    (root / media_id).mkdir(parents=True, exist_ok=True)
    (root / media_id / name).write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for media_id, body in (("m1", SEGMENTS), ("media_id=7", [{"text": "ä\n "}]), ("empty", []), ("broken", b"[{"), ("object", {"a": 1}), ("bytes", b"\xff\xfe"), ("deep", b"[" * 100_000), ("nothing", b"")):
        put(root, media_id, body)
    put(root, "m1", [{"text": "no"}], "notes.csv")
    put(root, "m1", [{"text": "no"}], "_log.json")
    return root


def test_rows_and_rejected_documents(spark, folder):
    rows = M.read_media(spark, str(folder)).cache()
    got = {(r.media_id, r.idx, r.text, r.start_ms, r.end_ms, r.speaker_id) for r in rows.filter("reason is null").collect()}
    assert got == {("m1", 0, "hi", 100, 1250, "x"), ("m1", 1, "5", 2000, None, None), ("m1", 3, "w", None, None, None), ("7", 0, "ä\n ", None, None, None)}
    bad = {(r.media_id, r.idx, r.reason) for r in rows.filter("reason is not null").collect()}
    assert bad == {("m1", 2, "no_object"), ("broken", None, "invalid_json"), ("object", None, "no_list"), ("bytes", None, "unreadable"), ("deep", None, "invalid_json"), ("nothing", None, "invalid_json")}
    rows.unpersist()


def test_filters_choose_files(spark, folder):
    for how, want in ((F.col("media_id") == "7", {"7"}), (F.col("media_id").isin("m1", "7"), {"m1", "7"}), ((F.col("media_id") == "m1") & (F.col("idx") > 0), {"m1"}), (F.col("media_id") == "no", set())):
        df = M.read_media(spark, str(folder)).filter(how)
        assert {r.media_id for r in df.collect()} == want
    plan = M.read_media(spark, str(folder)).filter("media_id = '7' and idx = 0")._jdf.queryExecution().executedPlan().toString()
    spark_does = plan.split("Filter", 1)[1].split("\n")[0]
    assert "idx" in spark_does and "= 7" not in spark_does
    reader = M.MediaReader({"path": str(folder)})
    assert [f for f in reader.pushFilters([M.EqualTo(("media_id",), "7"), M.EqualTo(("idx",), 0)])] == [M.EqualTo(("idx",), 0)]
    assert [x for p in reader.partitions() for x in p.files] == [("7", f"{folder}/media_id=7/a.json")]


def test_small_files_share_tasks(tmp_path):
    for i in range(50):
        put(tmp_path, f"m{i}", [{"text": "x" * 100}])
    size = len(json.dumps([{"text": "x" * 100}]))
    parts = M.MediaReader({"path": str(tmp_path), "task_bytes": str(size * 10)}).partitions()
    assert [len(p.files) for p in parts] == [10] * 5


def test_turns_and_words(spark, tmp_path):
    put(tmp_path / "t", "a", {"turns": [{"start": 1, "speaker": "A"}]})
    put(tmp_path / "t", "b", [{"start": 0, "end": 1.5, "label": "B"}])
    put(tmp_path / "t", "c", {"other": []})
    assert {(r.media_id, r.start_ms, r.end_ms, r.speaker, r.label, r.reason) for r in M.read_media(spark, str(tmp_path / "t"), "turns").collect()} == {("a", 1000, 1000, "A", None, None), ("b", 0, 1500, None, "B", None), ("c", None, None, None, None, "no_list")}
    put(tmp_path / "w", "a", {"segments": [{"words": [{"word": "n", "start": 0.5, "end": 1}]}, {"words": None}, 3], "words": [{"text": "flat"}]})
    put(tmp_path / "w", "b", {"segments": [{"words": []}], "words": [{"text": "flat"}]})
    put(tmp_path / "w", "c", [1])
    assert {(r.media_id, r.idx, r.text, r.start_ms, r.reason) for r in M.read_media(spark, str(tmp_path / "w"), "words").collect()} == {("a", 0, "n", 500, None), ("b", 0, "flat", None, None), ("c", None, None, None, "no_object")}


def test_packed_files(spark, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.range(200).select("id", F.concat(F.lit('[{"text": "é\\n'), F.repeat(F.col("id").cast("string"), 40), F.lit('"}]')).alias("document")).withColumnRenamed("id", "media_id")
    want = {str(i): "é\n" + str(i) * 40 for i in range(200)}
    M.write_media(docs, out, files=5)
    assert len(list((tmp_path / "out").glob("part-*"))) <= 5
    for size in ("37", "1000", "1000000"):  # ranges cut lines anywhere
        rows = M.read_media(spark, out, task_bytes=size).collect()
        assert {r.media_id: r.text for r in rows} == want and len(rows) == 200
    assert [r.text for r in M.read_media(spark, out).filter("media_id = '42'").collect()] == [want["42"]]
    M.write_media(spark.createDataFrame([("x", "[]"), (None, None)], "media_id string, document string"), out, files=5)
    got = M.read_media(spark, out, "documents")
    assert got.count() == 202 and [(r.media_id, r.reason) for r in got.filter("reason is not null").collect()] == [(None, "unreadable")]
    M.write_media(docs.limit(0), out, mode="overwrite")
    assert M.read_media(spark, out).count() == 0 and not list((tmp_path / "out").glob("part-*"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    M.write_media(spark.createDataFrame([("a", "[]")], "media_id string, document string"), str(out))
    before = sorted(p.name for p in out.iterdir())
    broken = spark.range(100).select(F.col("id").alias("media_id"), F.when(F.col("id") == 77, F.raise_error("no")).otherwise("[]").alias("document"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            M.write_media(broken, str(out), mode=mode)
        assert sorted(p.name for p in out.iterdir()) == before


def test_attempts_that_do_not_count(tmp_path):
    import pyarrow as pa

    batch = pa.record_batch({"media_id": ["a"], "document": ["[]"]})
    w = M.MediaWriter({"path": str(tmp_path)}, False)
    lost, counted = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.name != counted.name
    w.commit([counted])
    assert [f.name for f in tmp_path.glob("part-*")] == [counted.name]

    def fails():
        yield batch
        raise RuntimeError

    with pytest.raises(RuntimeError):
        w.write(fails())
    assert [f.name for f in tmp_path.glob("part-*")] == [counted.name]


def test_same_rows_as_the_json_reader(spark, tmp_path):
    put(tmp_path, "a", [{"text": "x", "start": 0.0005, "end": 1.0005}, {"text": "y", "start": 2.5, "end": 3}])
    cols = ["media_id", "text", "start_ms", "end_ms"]
    assert M.read_media(spark, str(tmp_path)).select(cols).collect() == R.read_segments(spark, f"{tmp_path}/*/*.json").select(cols).collect()

"""Documents that are written and read back need no file each, and texts are cut by many tasks."""

import glob

from segloom import queries as Q
from segloom.sources import transcripts as R


def test_packed_documents(spark, tmp_path):
    d = spark.createDataFrame([(i, f'{{"job_name": "j{i}", "metrics": {{"wer": {i}}}, "note": "a\\nb"}}') for i in range(300)], "media_id long, document string")
    R.write_packed(d, f"{tmp_path}/p", files=4)
    assert len(glob.glob(f"{tmp_path}/p/part-*")) <= 4
    got = R.run_metrics_of(R.read_packed(spark, f"{tmp_path}/p")).select("job_name", "metrics", "tts_config").collect()
    assert sorted(map(tuple, got)) == sorted((f"j{i}", f'{{"wer":{i}}}', "{}") for i in range(300))


def test_scans_make_a_bounded_number_of_files(spark, sf, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(R, "shared_folder", lambda spark, label: made.append(f"{tmp_path}/{label}{len(made)}") or made[-1])
    spark.range(500).selectExpr("id + 1 as s_suppkey", "cast(id % 25 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert Q.QUERIES["scan_run_metrics"](spark, str(tmp_path)).count() == 500
    for name in ("scan_segments", "scan_turns"):
        assert Q.QUERIES[name](spark, sf).count() > 0
    assert len(made) == 3
    assert all(0 < len(glob.glob(f"{folder}/**/part-*", recursive=True)) <= 64 for folder in made)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"m{i}").mkdir()
        (tmp_path / f"m{i}" / "a.txt").write_text("x")
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, group = spark.conf.get(listing), "list_media"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert R.list_media(spark, str(tmp_path), ["TXT"], deep=True).count() == 200
    finally:
        spark.sparkContext.setJobGroup("", "")
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(x) for j in status.getJobIdsForGroup(group) for x in status.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) <= 64 and spark.conf.get(listing) == before


def test_texts_are_dealt_out_before_they_are_cut(spark, sf):
    from segloom.fixtures import fixture

    plan = fixture(spark, sf, "pairs_fx")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan

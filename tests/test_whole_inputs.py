"""The inputs of the queries hold whole texts and all rows."""

from segloom.fixtures import fixture


def test_pairs_hold_whole_texts(spark, sf):
    """Pieces in order are the document but for the breaks; the other side has the same pieces."""
    texts = {r.doc_id: r.text for r in fixture(spark, sf, "documents").collect()}
    pieces = {}
    for r in sorted(fixture(spark, sf, "pairs_fx").collect(), key=lambda r: (r.media_id, r.seg_idx)):
        pieces.setdefault(r.media_id, []).append((r.original_text, r.text))
    flat = lambda x: x.replace("\n", " ")
    assert max(map(len, texts.values())) > 10_000
    assert {k: flat(" ".join(a for a, _ in v)) for k, v in pieces.items()} == {k: flat(x) for k, x in texts.items()}
    assert all(sorted(a for a, _ in v) == sorted(b for _, b in v) for v in pieces.values())


def test_rows_of_all_languages(spark, sf):
    """Rows with other than ASCII characters are there, with the values of a plain version."""
    import re
    from difflib import SequenceMatcher

    from segloom.queries import QUERIES

    pairs = {(r.media_id, r.seg_idx): r.text for r in fixture(spark, sf, "pairs_fx").collect()}
    assert not all(x.isascii() for x in pairs.values())
    got = {(r.media_id, r.seg_idx): r.value for r in QUERIES["normalize_spaces"](spark, sf).collect()}
    assert got == {k: " ".join(x.split()) for k, x in pairs.items()}
    for name in ("retry_variants", "segment_payload_json", "clean_model_answer", "extract_candidates", "constraint_check", "normalize_translation", "text_signature", "clean_spoken_text", "word_count", "starts_lower", "replace_terminal", "stabilize_text", "latin_tokens", "latin_leaks"):
        assert QUERIES[name](spark, sf).count() == len(pairs), name
    assert QUERIES["rewrite_gate"](spark, sf).count() == 3 * len(pairs)
    recog = {r.media_id: r for r in fixture(spark, sf, "recog_fx").collect()}
    assert not all(r.expected.isascii() for r in recog.values())
    words = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    got = {r.media_id: r.ratio for r in QUERIES["sequence_ratio"](spark, sf).collect()}
    assert got == {k: round(SequenceMatcher(None, words(r.expected), words(r.recognized)).ratio(), 6) for k, r in recog.items()}
    for name in ("wer", "wer_cer", "token_overlap", "recognition_score", "suffix_anchor", "extra_trailing"):
        assert QUERIES[name](spark, sf).count() == len(recog), name


def test_latin_tokens_end_at_other_letters(spark):
    """Words with other letters hold no token; DuckDB's form marks them."""
    import duckdb
    from pyspark.sql import functions as F

    from segloom.functions.text import latin_tokens
    from segloom.queries import _latin

    texts = ["", "naïve plan", "foo.naïve.bar x1", "self-évident-self", "да no-да v2.0 é", "a_b c+ d. 9z"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(latin_tokens(F.col("x")).alias("t")).collect()]
    assert got == [duckdb.execute(f"select {_latin('x')} from (select ? as x) t", [x]).fetchone()[0] for x in texts]
    assert got[1:4] == [["plan"], ["foo.", "bar", "x1"], ["self-", "self"]]


def test_references_are_of_chosen_clips(spark, sf):
    """Every segment has a row; routed ones name chosen clips of their pool, the others the longest segment of their medium."""
    from segloom.queries import QUERIES

    clips = {(r.media_id, r.pool, f"clip_{r.source_index}") for n in ("select_reference_clips", "select_routing_clips") for r in QUERIES[n](spark, sf).collect()}
    longest = {r.media_id: f"clip_{r.seg_idx}" for r in QUERIES["longest_clip_fallback"](spark, sf).collect()}
    segments = sorted((r.media_id, r.seg_idx) for r in QUERIES["pause_segments"](spark, sf).collect())
    got = QUERIES["route_references"](spark, sf).collect()
    assert sorted((r.media_id, r.seg_idx) for r in got) == segments
    assert {r.pool for r in got} > {"fallback"}
    for r in got:
        if r.pool == "fallback":
            assert r.paths == longest.get(r.media_id)
        else:
            assert {(r.media_id, r.pool, p) for p in r.paths.split(",")} <= clips


def test_answers_are_of_each_row(spark, sf):
    import json

    from segloom.queries import QUERIES

    pairs = {(r.media_id, r.seg_idx): r.text for r in fixture(spark, sf, "pairs_fx").collect()}
    got = {(r.media_id, r.seg_idx): r.value for r in QUERIES["parse_answer_json"](spark, sf).collect()}
    assert got.keys() == pairs.keys()
    plain = {k for k, x in pairs.items() if "```" not in x and "<think>" not in x}
    assert plain and all(json.loads(got[k]) == [{"id": k[1], "text": pairs[k]}] for k in plain)


def test_overlays_of_all_events(spark, sf):
    """Each event lays three frames over the mix, the first at every seventh."""
    from segloom.queries import QUERIES

    n = spark.read.parquet(f"{sf}/events.parquet").count()
    got = QUERIES["timeline_overlay"](spark, sf).filter("value = 5 and frame % 7 = 0").count()
    assert got >= n


def test_profiles_are_in_files_of_bounded_size(spark):
    import json

    from segloom.queries import profile_documents

    got = [json.loads(r.document)["profiles"] for r in profile_documents(spark.range(2500).selectExpr("id as s_suppkey", "id % 25 as s_nationkey")).collect()]
    assert sorted(map(len, got)) == [500, 1000, 1000]
    assert {k: v["nation"] for p in got for k, v in p.items()} == {f"S{i}": i % 25 for i in range(2500)}


def test_a_plan_deals_jobs_out_once(spark):
    """By job, and the forced steps to them; it was once for each join, count and window before. Repeated jobs and artifacts count as often."""
    from segloom.operators import jobs as J

    have = spark.createDataFrame([(1, "segments", None, 0), (1, "segments", None, 0), (1, "speaker_ref", 5, None), (2, "segments", None, 1), (2, "speaker_ref", 1, None), (None, "segments", None, 1)], "job_id long, artifact string, size long, items long")
    jobs = spark.createDataFrame([(1,), (2,), (2,), (3,)], "job_id long")
    missing = J.missing_artifacts(have, jobs, J.contract(spark))
    got = {r.job_id: r.missing for r in missing.filter("step = 'asr'").collect()}
    assert got == {1: ["segments", "segments"], 2: [], 3: ["segments", "speaker_ref"]}
    assert len(next(r.missing for r in missing.filter("job_id = 2 and step = 'translate'").collect())) == 2
    plan = J.resume_plan(missing, spark.createDataFrame([(2, "asr"), (2, "asr")], "job_id long, step string"), list(J.STEP_ARTIFACTS))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert [(r.run, r.reason) for r in plan.filter("job_id = 2 and step = 'asr'").collect()] == [(True, "forced")]

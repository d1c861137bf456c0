"""Segmentation, speakers, groups and chunks on small inputs with known results."""

from pyspark.sql import functions as F

from segloom.operators import segments as S

W = "media_id long, word_idx long, text string, start_ms long, end_ms long"


def words(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], W)


def test_pause_is_strict(spark):
    w = words(spark, ("a", 0, 100), ("b", 400, 500), ("c", 801, 900))
    got = S.pause_segments(w).orderBy("seg_idx").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.pause_before_ms, r.pause_after_ms) for r in got] == [("a b", 0, 500, 0, 301), ("c", 801, 900, 301, 0)]
    assert got[0].words_with_silence == "a <0.30s> b"


def test_small_gaps_are_not_marked(spark):
    w = words(spark, ("a", 0, 100), ("b", 139, 200), ("c", 240, 300))
    assert S.pause_segments(w).first().words_with_silence == "a b <0.04s> c"


def test_empty_words(spark):
    assert S.pause_segments(words(spark, ("  ", 0, 10)).limit(0)).count() == 0
    assert S.pause_segments(words(spark, (" ", 0, 10), (" b ", 20, 30))).first().text == "b"


def test_turns_keep_ids_and_drop_empty_ones(spark):
    t = spark.createDataFrame([(1, 500, 900, "B"), (1, 0, 400, "A"), (1, 950, 950, "C")], "media_id long, start_ms long, end_ms long, speaker_label string")
    got = {r.speaker_label: r.speaker_id for r in S.normalize_turns(t).collect()}
    assert got == {"A": "spk_0", "B": "spk_1"}


def test_overlap_and_default(spark):
    w = words(spark, ("a", 0, 100), ("b", 150, 300), ("c", 9_990, 20_020), ("d", 50_000, 50_010))
    t = spark.createDataFrame([(1, 0, 200, "x"), (1, 200, 290, "y"), (1, 9_000, 10_000, "x"), (1, 10_000, 20_000, "y")], "media_id long, start_ms long, end_ms long, speaker_id string")
    got = [(r.speaker_id, r.overlap_ms) for r in S.speaker_overlap(w, t, "word_idx").orderBy("word_idx").collect()]
    assert got == [("x", 100), ("y", 90), ("y", 10_000), ("spk_0", 0)]


def test_split_where_the_speaker_changes(spark):
    w = spark.createDataFrame([(1, 0, 0, "a", 0, 100, "x"), (1, 0, 1, "b", 120, 200, "y"), (1, 0, 2, "c", 210, 300, "y")], "media_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, speaker_id string")
    s = spark.createDataFrame([(1, 0, 7, 9)], "media_id long, seg_idx long, pause_before_ms long, pause_after_ms long")
    got = [(r.text, r.speaker_id, r.pause_before_ms, r.pause_after_ms, r.split_count) for r in S.diarized_segments(w, s).orderBy("split_idx").collect()]
    assert got == [("a", "x", 7, 20, 2), ("b c", "y", 20, 9, 2)]


def test_sentences(spark):
    s = spark.createDataFrame([(1, 0, "Hello", 0, 100), (1, 1, "there.", 200, 300), (1, 2, "New", 310, 400), (1, 3, "one", 900, 950)], "media_id long, seg_idx long, text string, start_ms long, end_ms long")
    assert [r.text for r in S.sentence_groups(s).orderBy("group_idx").collect()] == ["Hello there.", "New", "one"]


def test_groups_go_on(spark):
    s = spark.createDataFrame([(1, 0, "We went,", "We went,", 0, 1000, "x"), (1, 1, "and came.", "and came.", 1200, 2000, "x"), (1, 2, "then", "then", 2100, 2500, "y")], "media_id long, seg_idx long, text string, original_text string, start_ms long, end_ms long, speaker_id string")
    got = S.continuation_groups(s).orderBy("group_idx").collect()
    assert [(r.text, r.indices, r.gap_ms) for r in got] == [("We went, and came.", [0, 1], 200), ("then", [2], 0)]


def test_chunks(spark):
    text = "One two three. " * 3 + "Four, five; six seven eight nine"
    d = spark.createDataFrame([(text,), ("",), ("short",)], "t string")
    a, b, c = [r[0] for r in d.select(S.text_chunks(F.col("t"), 20)).collect()]
    assert a == ["One two three.", "One two three.", "One two three. Four,", "five;", "six seven eight nine"]
    assert (b, c) == ([], ["short"])


def test_chunk_words_and_times(spark):
    seg = S.pause_segments(words(spark, *[(f"w{i}." if i == 1 else f"w{i}", i * 100, i * 100 + 90) for i in range(5)]))
    got = S.chunk_word_split(seg, 8).orderBy("chunk_idx").collect()
    assert [r.text for r in got] == ["w0 w1.", "w2 w3 w4"]
    assert [(r.start_ms, r.end_ms, len(r.words)) for r in got] == [(0, 190, 2), (200, 490, 3)]


def test_groups_of_a_long_item(spark):
    """One media item of 20,000 segments: time grows with the segments, and pairs are merged all the way."""
    from segloom.operators.segments import continuation_groups

    rows = spark.range(20_000).selectExpr("1L as media_id", "id as seg_idx", "id * 1000 as start_ms", "id * 1000 + 900 as end_ms", "if(id % 2 = 0, 'one goes on,', 'and ends.') as text", "'' as original_text", "'s' as speaker_id")
    got = continuation_groups(rows)
    assert got.count() == 10_000
    assert {(r.text, r.group_size) for r in got.select("text", "group_size").distinct().collect()} == {("one goes on, and ends.", 2)}


def test_words_are_dealt_out_twice_at_most(spark):
    """By media item for the segments, and once more with the turns; it was once for each join and count before."""
    w = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, "b", 900, 1200)], "media_id long, word_idx long, text string, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 0, 1000, "spk_1")], "media_id long, start_ms long, end_ms long, speaker_id string")
    parts = S.diarized_segments(S.speaker_overlap(S.segmented_words(w), t, "word_idx"))
    assert parts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = [(r.text, r.speaker_id, r.pause_before_ms, r.pause_after_ms) for r in parts.orderBy("seg_idx").collect()]
    assert got == [("a", "spk_1", 0, 800), ("b", "spk_1", 800, 0)]


def test_overlap_keeps_odd_rows(spark):
    """Repeated rows, rows without a key, a media item or a time stay, and what has no turn gets the default."""
    w = spark.createDataFrame([(1, 0, 9_000, 31_000), (1, 0, 9_000, 31_000), (1, None, 0, 500), (None, 1, 0, 500), (1, 2, None, 500), (1, 3, 50_000, 50_010), (1, 4, 700, 700)], "media_id long, word_idx long, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 0, 12_000, "x"), (1, 12_000, 40_000, "y"), (1, 8_000, 30_000, "x"), (None, 0, 900, "z")], "media_id long, start_ms long, end_ms long, speaker_id string")
    got = sorted((str(r.media_id), str(r.word_idx), str(r.start_ms), r.speaker_id, r.overlap_ms) for r in S.speaker_overlap(w, t, "word_idx").collect())
    assert got == sorted([("1", "0", "9000", "x", 2 * (3_000 + 21_000))] * 2 + [("1", "None", "0", "spk_0", 0), ("None", "1", "0", "spk_0", 0), ("1", "2", "None", "spk_0", 0), ("1", "3", "50000", "spk_0", 0), ("1", "4", "700", "x", 0)])

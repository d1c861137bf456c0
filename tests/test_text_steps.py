"""Text functions that do each step once give what the patterns they replace give, on awkward texts; and plans do not repeat the steps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segloom import queries
from segloom.functions import text as T
from segloom.operators import quality as Q
from segloom.operators import timing as M

PIECES = ["a", "Z", "Hello", "you're", "Ünï", "Привет", "ς", "Σ", "中文", "é", "é", "😀", "1,5", "20%", "3.25", "the", "of", "ASR", "x-9", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", "　", "‍", "﻿", "é", ".", ",", ";", ":", "!", "?", "…", "-", "_", "'", '"', "`", "(", ")", "[", "]", "{", "}", "»", "”", "•", "|", "$1", "\\", "```", "```json", "```JSON\n", "<|im_end|>", "<|endoftext|>", "Translation:", "russian translation: ", "ОТВЕТ:", "ответ", "Assistant: ", "ассистент -", '{"text": "b  c "}', '["d", " D "]', '{"candidates": ["x", "X ", " y"]}', "- ", "1) ", "2. "]


def awkward(n: int) -> list[str | None]:
    r = random.Random(7)
    return [None, "", " ", "\n", *PIECES, *("".join(r.choice(PIECES) for _ in range(r.randint(1, 9))) for _ in range(n))]


def closers_by_pattern(x):
    return F.regexp_replace(F.trim(x), r"""(?U)[\s"')\]}»”]+$""", "")


def clean_by_pattern(x):
    return T.normalize_spaces(F.regexp_replace(F.regexp_replace(x, r"[\x{10000}-\x{10FFFF}]", ""), r"""(?U)[^\w\s.,!?;:()"'%\-]""", ""))


def base_by_pattern(x, marks):
    return F.regexp_replace(clean_by_pattern(x), rf"[{marks}]+$", "")


def translation_by_pattern(x):
    t = T.normalize_spaces(x)
    for pattern, to in ((r"(?U)\s+([,.;:!?])", "$1"), (r"(?U)([(\[{])\s+", "$1"), (r"(?U)\s+([)\]}])", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def answer_by_pattern(x, tgt_lang):
    t = F.regexp_replace(x, r"(?U)^[\s]+|[\s]+$", "")
    t = F.regexp_replace(t, "^[\"'`]+|[\"'`]+$", "")
    t = T.normalize_spaces(F.regexp_replace(t, r"<\|im_end\|>|<\|endoftext\|>", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")

    def unwrapped(v):
        keys = [F.get_json_object(v, f"$.{k}") for k in ("translation", "text", "result")]
        return F.coalesce(F.when(v.startswith("{"), F.coalesce(*keys, F.get_json_object(v, "$.translations[0]"))).when(v.startswith("["), F.get_json_object(v, "$[0]")), v)

    def unlabelled(v):
        rest = F.regexp_replace(v, T._LABELS, "")
        return T.bound(rest, lambda r: F.when(F.length(r) < F.length(v), F.regexp_replace(r, r"[ :\-\n\t]+$", "")).otherwise(v))

    t = T.normalize_spaces(T.bound(T.bound(t, unwrapped), unlabelled))
    if tgt_lang:
        t = T.bound(t, lambda v: F.when(v.rlike("[А-Яа-яЁё]"), F.regexp_extract(v, "([А-Яа-яЁё].*)$", 1)).otherwise(v))
    return T.normalize_spaces(F.regexp_replace(t, r"(?iu)^(assistant|ассистент)\s*[:,-]?\s*", ""))


def test_white_is_what_the_pattern_means(spark):
    points = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("ch"))
    assert "".join(sorted(r.ch for r in points.filter(F.col("ch").rlike(r"(?U)^\s\z")).collect())) == "".join(sorted(T.WHITE))


def test_steps_equal_patterns(spark):
    x, mark = F.col("x"), F.lit("!")
    base = base_by_pattern(x, r" .,!?:;_\-")
    pairs = {
        "closers": (T.strip_closers(x), closers_by_pattern(x)),
        "terminal": (T.ends_terminal(x), closers_by_pattern(x).rlike(r"[.!?…]$")),
        "continuation": (T.ends_continuation(x), closers_by_pattern(x).rlike(r"[,;:\-]$")),
        "clean": (T.clean_spoken_text(x), clean_by_pattern(x)),
        "replaced": (T.replace_terminal(x, "!"), F.when(base == "", clean_by_pattern(x)).otherwise(F.concat(base, mark))),
        "forced": (T.stabilize_text(x, F.lit(""), F.lit(""), F.lit(0), F.lit(0), F.lit(1), force=True), F.when((clean_by_pattern(x) == "") | closers_by_pattern(clean_by_pattern(x)).rlike(r"[.!?…]$") | (base_by_pattern(x, r" ,;:\-") == ""), clean_by_pattern(x)).otherwise(F.concat(base_by_pattern(x, r" ,;:\-"), T.preferred_terminal(clean_by_pattern(x))))),
        "answer": (T.clean_model_answer(x), answer_by_pattern(x, "")),
        "russian": (T.clean_model_answer(x, "rus"), answer_by_pattern(x, "rus")),
        "translation": (T.normalize_translation(x, F.lit(""), F.array().cast("array<struct<source:string,target:string>>")), translation_by_pattern(x)),
        "lines": (F.array_join(F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n"), "|"), F.array_join(F.split(x, r"\r?\n"), "|")),
        "unfenced": (T.unfenced(x), F.regexp_replace(F.regexp_replace(x, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")),
    }
    df = spark.createDataFrame([(v,) for v in awkward(4000)], "x string").repartition(4)
    for name, (new, old) in pairs.items():
        wrong = df.select("x", new.alias("new"), old.alias("old")).filter("not (new <=> old)").limit(3).collect()
        assert not wrong, (name, wrong)


def test_rank_leaves_out_texts_equal_but_for_case_and_spaces(spark):
    texts = awkward(300)
    r = random.Random(3)
    rows = [(i, 0, 0, a, b, 3000, 4000, m) for i, (a, b, m) in enumerate((r.choice(texts), r.choice(texts), r.choice(["shorter", "longer"])) for _ in range(300))]
    rows += [(1000 + i, 0, 0, t, t and t.swapcase().replace(" ", " 　"), 3000, 4000, "shorter") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "media_id long, seg_idx long, cand_idx long, original_text string, candidate string, current_ms long, target_ms int, mode string")
    norm = lambda c: F.lower(T.normalize_spaces(F.col(c)))
    want = {r.media_id for r in df.filter(norm("candidate") != norm("original_text")).collect()}
    plain, words = M.candidate_rank(df), M.candidate_rank(df.withColumn("original_words", T.word_tokens(F.col("original_text"))))
    assert {r.media_id for r in plain.collect()} == want
    assert plain.columns == words.columns and plain.exceptAll(words).isEmpty() and words.exceptAll(plain).isEmpty()
    shared = lambda: F.size(F.array_intersect(T.word_tokens(F.col("original_text")), T.word_tokens(F.col("candidate"))))
    assert plain.filter(~F.col("token_precision").eqNullSafe(shared() / F.greatest(F.lit(1), F.size(F.array_distinct(T.word_tokens(F.col("candidate"))))))).isEmpty()


def test_gate_finds_words_once(spark, sf):
    """Words of a source once per segment and of a rewrite once, and each in one place of the plan; the precision is that of token_overlap, with repeated words and nulls too."""
    from segloom.functions import vectors as V

    texts = awkward(200) + ["a b a", "a a a b", "b a", "c", "a b c a b c a"]
    r = random.Random(9)
    rows = [(i, r.choice(texts), r.choice(texts), r.choice(["shorter", "longer"]), 1000, 900, 1000, 0.95, r.choice([None, 0.85, 0.95]), r.random() < 0.2, r.random() < 0.8) for i in range(800)]
    df = spark.createDataFrame(rows, "media_id long, source string, rewritten string, mode string, baseline_ms long, rewritten_ms long, target_ms long, baseline_score double, rewritten_score double, has_extra_tail boolean, has_suffix boolean")
    a, b = T.word_tokens(F.col("source")), T.word_tokens(F.col("rewritten"))
    plain, words = M.rewrite_gate(df), M.rewrite_gate(df.withColumn("source_words", T.word_tokens(F.col("source"))))
    assert plain.columns == words.columns and plain.exceptAll(words).isEmpty() and words.exceptAll(plain).isEmpty()
    wrong = plain.filter(~F.col("token_precision").eqNullSafe(V.token_overlap(a, b)["precision"]) | ~F.col("text_similarity").eqNullSafe(V.sequence_ratio("source", "rewritten")))
    assert wrong.isEmpty() and plain.filter("reject_reason = 'token_precision'").count() > 0
    plan = queries.QUERIES["rewrite_gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\w+") == 2


def test_issues_equal_plain_columns(spark):
    texts = awkward(300)
    r = random.Random(5)
    df = spark.createDataFrame([(i, 0, r.choice(texts), r.choice(texts), 0, r.choice([-5, 0, 300, 4000])) for i in range(1500)], "media_id long, seg_idx long, text string, original_text string, start_ms long, end_ms long")
    got = Q.translation_qa_issues(df, F.array(F.lit("the")))
    assert 0 < got.count() < 1500
    text, original = (T.normalize_spaces(F.coalesce(F.col(n), F.lit(""))) for n in ("text", "original_text"))
    both = got.join(df, ["media_id", "seg_idx"])
    assert both.filter(~F.col("missing_numbers").eqNullSafe(F.array_sort(F.array_except(T.extract_numbers(original), T.extract_numbers(text))))).isEmpty()
    assert both.filter(~F.col("latin_words").eqNullSafe(Q.latin_leaks(text, F.array(F.lit("the"))))).isEmpty()
    assert both.filter(~F.col("char_ratio").eqNullSafe(F.round(F.length(text) / F.greatest(F.lit(1), F.length(original)), 3))).isEmpty()
    assert both.filter(F.array_contains("issues", "empty_translation") != (text == "")).isEmpty()


@pytest.mark.parametrize("name, pattern, most", [("retry_variants", r"[^\w\s.,!?;:()", 1), ("translation_qa_issues", r"(?U)\s+", 2), ("candidate_rank", r"(?U)\w+", 2), ("extract_candidates", r"(?U)\s+", 3)])
def test_plans_name_a_step_once(spark, sf, name, pattern, most):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(pattern) <= most

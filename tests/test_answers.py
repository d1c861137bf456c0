"""Answers of models: the column expressions against a plain version, and their size."""

import json
import re

import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T

SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
spaces = lambda x: re.sub(f"[{SPACE}]+", " ", x).strip(" ")


def as_json(x):
    try:
        return json.loads(x)
    except ValueError:
        return None


def plain_clean(x, lang=""):
    t = x.strip(SPACE)
    t = re.sub("^[\"'`]+|[\"'`]+$", "", t)
    t = spaces(re.sub(r"<\|im_end\|>|<\|endoftext\|>", " ", t))
    t = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", t))
    v = as_json(t) if t[:1] in "{[" and t else None
    if isinstance(v, dict):
        found = [v[k] for k in ("translation", "text", "result") if v.get(k) is not None] + (v.get("translations") or [])[:1]
        t = found[0] if found else t
    elif isinstance(v, list) and v:
        t = v[0]
    for label in T.ANSWER_LABELS:
        if t.lower().startswith(label):
            t = t[len(label) :].strip(" :-\n\t")
    t = spaces(t)
    if lang.startswith("rus") and re.search("[А-Яа-яЁё]", t):
        t = t[re.search("[А-Яа-яЁё]", t).start() :]
    return spaces(re.sub(r"(?i)^(assistant|ассистент)\s*[:,-]?\s*", "", t))


def plain_tidy(x):
    t = spaces(x)
    for pattern, to in ((f"[{SPACE}]+([,.;:!?])", r"\1"), (rf"([(\[{{])[{SPACE}]+", r"\1"), (rf"[{SPACE}]+([)\]}}])", r"\1")):
        t = re.sub(pattern, to, t)
    return t.strip(" ")


def plain_candidates(x, lang=""):
    t = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", x.strip(" ")))
    v, raw = (as_json(t) if t[:1] in ("{", "[") else None), None
    if isinstance(v, dict):
        lists = [v[k] for k in ("candidates", "alternatives", "translations") if v.get(k) is not None]
        filled = [y for y in (lists[0] if lists else []) if y.strip(" ")]
        one = [v[k] for k in ("translation", "text", "result") if v.get(k) is not None]
        raw = filled or ([one[0]] if one and one[0].strip(" ") else None)
    elif isinstance(v, list):
        raw = v
    if raw is None:
        lines = [y for y in (re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", y).strip(" ") for y in re.split(r"\r?\n", t)) if y]
        raw = lines if len(lines) > 1 else [t]
    out = {}
    for y in raw:
        y = plain_tidy(plain_clean(y, lang))
        if y:
            out.setdefault(y.lower(), y)
    return list(out.values())


CASES = [
    "", "  ", "plain", "`quoted`", '"Translation: x -"', "Translation: Russian: да :", "RUSSIAN TRANSLATION:- один\n", "перевод: Перевод: два", "ОТВЕТ - три", "translated text:", "translation:translation: a",
    '```json\n{"translation": "Translation: a b"}\n```', '{"text": "t", "result": "r"}', '{"translations": ["one", "two"]}', '["first", "second"]', "{broken", "[broken", "x <|im_end|> y", "assistant: hi", "Ассистент - привет",
    "words до слов , и ( дальше )", '{"candidates": ["A", " ", "a", "B"]}', '{"alternatives": [], "translation": "z"}', '{"candidates": null, "text": "q"}', "- one\n- ONE\n2) two\n• three", "1. a\r\n\r\n2. A.", "only one line", "[]", "{}", "не за что.",
]


@pytest.mark.parametrize("lang", ["", "rus_Cyrl"])
def test_answers_of_all_kinds(spark, lang):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, x string")
    got = df.select("i", T.clean_model_answer(F.col("x"), lang).alias("c"), T.extract_candidates(F.col("x"), lang).alias("e")).orderBy("i").collect()
    for r, x in zip(got, CASES):
        assert r.c == plain_clean(x, lang), x
        assert r.e == plain_candidates(x, lang), x


def test_answers_of_all_rows(spark, sf):
    from segloom.fixtures import fixture
    from segloom.queries import QUERIES

    pairs = {(r.media_id, r.seg_idx): r.text for r in fixture(spark, sf, "pairs_fx").collect()}
    odd = re.compile('["\\\\\x00-\x1f]')
    got = {(r.media_id, r.seg_idx): r.value for r in QUERIES["clean_model_answer"](spark, sf).collect()}
    assert got == {k: plain_clean('```json\n{"translation": "Translation: ' + odd.sub(" ", x) + '"}\n```') for k, x in pairs.items()}
    got = {(r.media_id, r.seg_idx): r.value for r in QUERIES["extract_candidates"](spark, sf).collect()}
    want = {k: "|".join(plain_candidates(f"- {x.strip(' ')}\n- {x.strip(' ').upper()}\n- other")) for k, x in pairs.items()}
    assert got == want


def test_plans_stay_small(spark):
    df = spark.range(1).selectExpr("cast(id as string) as x")
    for use in (T.clean_model_answer, T.extract_candidates):
        plan = df.select(use(F.col("x"), "rus").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 30_000, use

"""Text functions as column expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What `(?U)\s` means, for functions that strip sets of characters: they look at the ends only, where a pattern is tried at each place of a text.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CLOSERS = "\"')]}»”"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often `use` names it: else an expression that names its input twice at each step doubles with every step."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def normalize_spaces(x: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def text_signature(x: Column) -> Column:
    """Lower case, other than word characters and spaces to spaces, collapsed."""
    return normalize_spaces(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "))


def clean_spoken_text(x: Column) -> Column:
    """Without characters that disturb speech, but with those that shape it."""
    return normalize_spaces(F.regexp_replace(x, r"""(?U)[\x{10000}-\x{10FFFF}[^\w\s.,!?;:()"'%\-]]""", ""))


def dataset_text(x: Column) -> Column:
    """`|` to spaces, collapsed."""
    return normalize_spaces(F.regexp_replace(x, r"\|", " "))


def word_tokens(x: Column) -> Column:
    """Runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"((?U)\w+)"), F.lit(1))


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"((?U)\w+)"), F.lit(1)))


def split_count(x: Column) -> Column:
    """Words between white space."""
    return F.when(normalize_spaces(x) == "", 0).otherwise(F.size(F.split(normalize_spaces(x), " ")))


def is_question(x: Column) -> Column:
    return F.trim(x).endswith("?")


def strip_closers(x: Column) -> Column:
    """Without closing quotes and brackets, and spaces between them, at the end."""
    return F.rtrim(F.trim(x), F.lit(WHITE + _CLOSERS))


def _ends(x: Column, marks: str) -> Column:
    return reduce(or_, (x.endswith(m) for m in marks))


def ends_terminal(x: Column) -> Column:
    return _ends(strip_closers(x), ".!?…")


def ends_continuation(x: Column) -> Column:
    return _ends(strip_closers(x), ",;:-")


def starts_lower(x: Column) -> Column:
    """The first letter is a small one; false without letters."""
    return F.coalesce(F.regexp_extract(x, r"(\p{L})", 1).rlike(r"^\p{Ll}"), F.lit(False))


def preferred_terminal(x: Column) -> Column:
    s = strip_closers(x)
    return F.when(s.endswith("?"), "?").when(s.endswith("!"), "!").otherwise(".")


def _with_terminal(clean: Column, suffix: Column) -> Column:
    return bound(F.rtrim(clean, F.lit(" .,!?:;_-")), lambda base: F.when(base == "", clean).otherwise(F.concat(base, suffix)))


def replace_terminal(x: Column, suffix: Column | str) -> Column:
    """The text with its end punctuation replaced by the suffix; left alone if nothing else remains."""
    return bound(clean_spoken_text(x), lambda clean: _with_terminal(clean, F.lit(suffix) if isinstance(suffix, str) else suffix))


def _stabilized(clean: Column, original: Column, following: Column, gap_ms: Column, pause_ms: Column, group_size: Column, force: bool = False) -> Column:
    as_is = (clean == "") | (group_size != 1) | ends_terminal(clean) | ((following != "") & starts_lower(following))
    long = (F.trim(following) != "") & ~starts_lower(following) & (F.length(clean) >= 48) & ~ends_continuation(clean)
    add = F.lit(force) | ((original != "") & ends_terminal(original)) | F.coalesce(pause_ms >= 280, F.lit(False)) | F.coalesce(gap_ms >= 480, F.lit(False)) | long
    base = F.rtrim(clean, F.lit(" ,;:-"))
    mark = preferred_terminal(F.when(original != "", original).otherwise(clean))
    return F.when(as_is | ~add | (base == ""), clean).otherwise(F.concat(base, mark))


def stabilize_text(x: Column, original: Column, following: Column, gap_ms: Column, pause_ms: Column, group_size: Column, force: bool = False) -> Column:
    """Adds an end mark where the source, a pause or a capital after a long text asks for it."""
    original, following = F.coalesce(original, F.lit("")), F.coalesce(following, F.lit(""))
    return bound(clean_spoken_text(x), lambda clean: _stabilized(clean, original, following, gap_ms, pause_ms, group_size, force))


def retry_variants(x: Column, original: Column, following: Column, gap_ms: Column, pause_ms: Column, group_size: Column, backend: Column) -> Column:
    """The clean text and, for the one backend that profits, variants with other end marks."""
    original, following = F.coalesce(original, F.lit("")), F.coalesce(following, F.lit(""))

    def of(clean: Column) -> Column:
        edge = (_stabilized(clean, original, following, gap_ms, pause_ms, group_size) != clean) | ends_terminal(clean) | ends_terminal(original)
        preferred = preferred_terminal(F.when(original != "", original).otherwise(clean))
        marks = F.when(preferred == "?", F.array(F.lit("?"), F.lit("!"), F.lit("_"))).otherwise(F.array(F.lit("!"), F.lit("?"), F.lit("_")))
        more = F.filter(F.transform(marks, lambda m: _with_terminal(clean, m)), lambda v: v != "")
        base = F.filter(F.array(clean), lambda v: v != "")
        return F.when((F.lower(F.trim(F.coalesce(backend, F.lit("")))) == "xtts") & edge, F.array_distinct(F.concat(base, more))).otherwise(base)

    return bound(clean_spoken_text(x), of)


def join_segment_text(left: Column, right: Column) -> Column:
    """Joined by a space, but not after a dash or slash."""
    a, b = F.trim(left), F.trim(right)
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.when(a.rlike(r"[\-—–/]$"), "").otherwise(" "), b))


def extract_numbers(x: Column) -> Column:
    """Distinct numbers, decimal commas as points."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\b\d+(?:[.,]\d+)?%?\b)"), F.lit(1)), lambda n: F.translate(n, ",", ".")))


def latin_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"((?U)\b[A-Za-z][A-Za-z0-9_.+-]*\b)"), F.lit(1))


def split_config_list(x: Column) -> Column:
    """Items between `|`, line feeds and `;`."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[|\n;]"), lambda v: F.trim(v)), lambda v: v != "")


def parse_pairs(items: Column) -> Column:
    """`a -> b` items as (source, target); items without both sides are left out."""
    cut = F.transform(items, lambda i: F.struct(F.trim(F.split_part(i, F.lit("->"), F.lit(1))).alias("source"), F.trim(F.regexp_replace(i, r"(?s)^.*?->", "")).alias("target"), i.contains("->").alias("ok")))
    return F.transform(F.filter(cut, lambda c: c["ok"] & (c["source"] != "") & (c["target"] != "")), lambda c: F.struct(c["source"], c["target"]))


#: Language code prefixes and names.
LANGUAGES = {"eng": "English", "rus": "Russian", "deu": "German", "ger": "German", "fra": "French", "fre": "French", "spa": "Spanish", "zho": "Chinese", "chi": "Chinese", "jpn": "Japanese", "kor": "Korean", "ara": "Arabic", "arb": "Arabic", "por": "Portuguese", "ita": "Italian", "nld": "Dutch", "dut": "Dutch", "pol": "Polish", "ukr": "Ukrainian", "tur": "Turkish", "vie": "Vietnamese", "tha": "Thai", "ind": "Indonesian", "hin": "Hindi", "ben": "Bengali"}


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    known = F.try_element_at(names, F.split_part(F.coalesce(code, F.lit("")), F.lit("_"), F.lit(1)))
    return F.coalesce(known, F.when(F.coalesce(code, F.lit("")) == "", "the target language").otherwise(code))


def _pad(x: Column, n: int) -> Column:
    s = x.cast("string")
    return F.when(F.length(s) < n, F.lpad(s, n, "0")).otherwise(s)


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def srt_time(ms: Column) -> Column:
    """hh:mm:ss,mmm"""
    t = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    return F.concat(_pad(_div(t, 3_600_000), 2), F.lit(":"), _pad(_div(t, 60_000) % 60, 2), F.lit(":"), _pad(_div(t, 1000) % 60, 2), F.lit(","), _pad(t % 1000, 3))


def vtt_time(ms: Column) -> Column:
    return F.translate(srt_time(ms), ",", ".")


def ass_time(ms: Column) -> Column:
    """h:mm:ss.cc, rounded half to even."""
    t = F.greatest(F.bround(ms.cast("double") / 10, 0).cast("long"), F.lit(0).cast("long"))
    return F.concat(_div(t, 360_000).cast("string"), F.lit(":"), _pad(_div(t, 6000) % 60, 2), F.lit(":"), _pad(_div(t, 100) % 60, 2), F.lit("."), _pad(t % 100, 2))


def soft_target_chars(ms: Column, cps: float = 14.0, grace: int = 18, least: int = 24) -> Column:
    """How many characters fit a duration, softly."""
    return F.greatest(F.lit(least), F.bround(F.greatest(ms, F.lit(0)) / 1000.0 * cps, 0).cast("int") + grace)


def hard_char_limit(ms: Column, cps: float = 16.0, least: int = 8, most: int = 170) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.greatest(F.lit(least), F.floor(ms / 1000.0 * cps).cast("int"))))


def tempo_chain(factor: Column) -> Column:
    """Factors of at least 0.5 and at most 2 whose product is the given one."""
    halves = F.when(factor > 2.0, F.ceil(F.log2(factor)) - 1).when(factor < 0.5, F.ceil(-F.log2(factor)) - 1).otherwise(0).cast("int")
    step = F.when(factor > 2.0, 2.0).otherwise(0.5)
    return F.concat(F.array_repeat(step, halves), F.array(factor / F.pow(step, halves)))


def job_name(path: Column, explicit: Column | None = None) -> Column:
    """A name for a job from its input's path: null if nothing is left of it."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.when(F.lower(stem).startswith("video_") & (F.length(stem) > 6), F.substr(stem, F.lit(7))).otherwise(stem)
    raw = F.when(stem == "", "job").otherwise(stem)
    if explicit is not None:
        raw = F.when(F.coalesce(explicit, F.lit("")) != "", explicit).otherwise(raw)
    name = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?U)[^\w.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.nullif(name, F.lit(""))


def format_duration(sec: Column) -> Column:
    """`Xm SS.Ss`, `S.Ss` or n/a."""
    s = F.greatest(sec, F.lit(0.0))
    m = F.floor(s / 60)
    rest = s - m * 60
    return F.when(sec.isNull(), "n/a").when(m >= 1, F.format_string("%dm %04.1fs", m, rest)).otherwise(F.format_string("%.1fs", rest))


def apply_replacements(x: Column, pairs: Column) -> Column:
    """Whole words, whatever their case, replaced in the order of the pairs (source, target)."""
    pattern = lambda p: F.concat(F.lit(r"(?iu)\b\Q"), p["source"], F.lit(r"\E\b"))
    return F.aggregate(pairs, x, lambda t, p: F.regexp_replace(t, pattern(p), F.regexp_replace(p["target"], r"([\\$])", r"\\$1")))


def normalize_translation(x: Column, original: Column, pairs: Column) -> Column:
    """Spacing around punctuation, one idiom, and the replacements of the profile."""
    return _normalized_translation(normalize_spaces(x), original, pairs)


#: Texts without any of these, as most are, need no pattern.
_LOOSE = (*(f" {m}" for m in ",.;:!?)]}"), *(f"{m} " for m in "([{"))


def _tight(t: Column) -> Column:
    """Without the single spaces before and inside punctuation."""
    for pattern, to in ((r" ([,.;:!?])", "$1"), (r"([(\[{]) ", "$1"), (r" ([)\]}])", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return t


def _normalized_translation(t: Column, original: Column, pairs: Column) -> Column:
    """Of a text of which the spaces are normalized."""
    thanked = F.lower(normalize_spaces(F.coalesce(original, F.lit("")))).isin("you're welcome.", "you are welcome.")
    tight = bound(t, lambda v: F.when(reduce(or_, (v.contains(p) for p in _LOOSE)), _tight(v)).otherwise(v))
    return bound(tight, lambda v: F.when(thanked & F.lower(v).isin("ни за что.", "не за что."), "Пожалуйста.").otherwise(F.trim(apply_replacements(v, pairs))))


#: Labels that model answers put before a translation.
ANSWER_LABELS = ("translation:", "translated text:", "russian translation:", "russian:", "перевод:", "ответ:")


def _any_case(label: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in label)


#: Labels in their order, each at most once, with the marks and spaces behind it.
_LABELS = "^" + "".join(rf"(?:{_any_case(x)}[ :\-\n\t]*)?" for x in ANSWER_LABELS)


def unfenced(x: Column) -> Column:
    """Without the marks of a code block at the ends."""
    return bound(x, lambda v: F.when(v.contains("```"), F.regexp_replace(F.regexp_replace(v, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(v))


def clean_model_answer(x: Column, tgt_lang: str = "") -> Column:
    """A model's answer without quotes, fences, wrapping JSON, labels and, for Russian, what stands before the first Cyrillic letter."""
    def unwrapped(v: Column) -> Column:
        keys = [F.get_json_object(v, f"$.{k}") for k in ("translation", "text", "result")]
        return F.coalesce(F.when(v.startswith("{"), F.coalesce(*keys, F.get_json_object(v, "$.translations[0]"))).when(v.startswith("["), F.get_json_object(v, "$[0]")), v)

    def unlabelled(v: Column) -> Column:
        rest = F.regexp_replace(v, _LABELS, "")
        cut = bound(rest, lambda r: F.when(F.length(r) < F.length(v), F.regexp_replace(r, r"[ :\-\n\t]+$", "")).otherwise(v))
        return F.when(v.contains(":"), cut).otherwise(v)  # every label ends with it

    def plain(v: Column) -> Column:
        """The spaces of v are normalized, and stay so where no JSON is unwrapped: ends are cut with the spaces beside them."""
        return F.when(v.startswith("{") | v.startswith("["), normalize_spaces(bound(unwrapped(v), unlabelled))).otherwise(unlabelled(v))

    t = F.trim(F.trim(x, F.lit(WHITE)), F.lit("\"'`"))
    t = bound(t, lambda v: F.when(v.contains("<|"), F.replace(F.replace(v, F.lit("<|im_end|>"), F.lit(" ")), F.lit("<|endoftext|>"), F.lit(" "))).otherwise(v))
    t = bound(unfenced(normalize_spaces(t)), plain)
    if tgt_lang.startswith("rus"):
        t = bound(t, lambda v: F.when(v.rlike("[А-Яа-яЁё]"), F.regexp_extract(v, "([А-Яа-яЁё].*)$", 1)).otherwise(v))
    return F.trim(F.regexp_replace(t, r"(?iu)^(assistant|ассистент)\s*[:,-]?\s*", ""))


def parse_answer_json(x: Column) -> Column:
    """The outermost JSON array or object of an answer, without thoughts and fences; null if there is none."""
    t = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"(?i)```(?:json)?", ""))
    return F.nullif(F.regexp_extract(t, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))


def extract_candidates(x: Column, tgt_lang: str = "") -> Column:
    """The distinct candidates of an answer: of JSON lists or keys, else of bullets, else the answer."""
    none = F.array().cast("array<struct<source:string,target:string>>")

    def raw(t: Column) -> Column:
        lists = F.coalesce(*(F.from_json(F.get_json_object(t, f"$.{k}"), "array<string>") for k in ("candidates", "alternatives", "translations")))
        single = F.coalesce(*(F.get_json_object(t, f"$.{k}") for k in ("translation", "text", "result")))
        one = bound(single, lambda v: F.when(F.trim(v) != "", F.array(v)))
        from_object = bound(F.filter(lists, lambda v: F.trim(v) != ""), lambda v: F.when(F.size(v) > 0, v).otherwise(one))
        parsed = F.when(t.startswith("{"), from_object).when(t.startswith("["), F.from_json(t, "array<string>"))
        lines = F.filter(F.transform(F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\n"), lambda v: F.trim(F.regexp_replace(v, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda v: v != "")
        return F.coalesce(parsed, bound(lines, lambda v: F.when(F.size(v) > 1, v).otherwise(F.array(t))))

    def first_of_case(v: Column) -> Column:
        """The first of those that differ in case only."""
        keys = F.transform(v, lambda y: F.lower(y))
        return bound(keys, lambda k: F.filter(v, lambda y, i: F.array_position(k, F.lower(y)) == i + 1))

    clean = F.filter(F.transform(bound(unfenced(F.trim(x)), raw), lambda v: _normalized_translation(clean_model_answer(v, tgt_lang), F.lit(""), none)), lambda v: v != "")
    return bound(clean, first_of_case)

"""Functions of arrays, vectors and token sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T
from .matching import matching_ratios


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norm = F.sqrt(vector_dot(a, a)) * F.sqrt(vector_dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(vector_dot(a, b) / norm)


def _anchor_places(expected: Column, recognized: Column, k: int) -> tuple[Column, Column]:
    size = F.least(F.lit(k), F.size(expected))
    anchor = F.slice(expected, F.size(expected) - size + 1, size)
    last = F.size(recognized) - size + 1
    places = F.filter(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(recognized, i, size) == anchor)
    ok = (F.size(expected) > 0) & (F.size(recognized) > 0)
    return F.when(ok, places).otherwise(F.array().cast("array<int>")), size


def suffix_anchor(expected: Column, recognized: Column, k: int = 2) -> Column:
    """The last k expected tokens stand together somewhere in the recognized ones."""
    return F.size(_anchor_places(expected, recognized, k)[0]) > 0


def extra_trailing(expected: Column, recognized: Column, k: int = 2) -> Column:
    """More tokens than expected, some of them after the last place of the anchor."""
    places, size = _anchor_places(expected, recognized, k)
    after = F.size(recognized) - (F.array_max(places) + size - 1)
    return (F.size(recognized) > F.size(expected)) & F.coalesce(after > 0, F.lit(False))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens, each as often as both have it, and their shares of a (recall) and of b (precision).

    One pass over the sorted tokens of both: a run of equal ones counts as often as the side with fewer has it.
    """
    tagged = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("of_b"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("of_b")))))
    run = lambda w, n, m, total: F.struct(w.alias("w"), n.alias("n"), m.alias("m"), total.alias("total"))

    def step(s: Column, x: Column) -> Column:
        more = run(s["w"], s["n"] + 1 - x["of_b"], s["m"] + x["of_b"], s["total"])
        return F.when(s["w"] == x["w"], more).otherwise(run(x["w"], 1 - x["of_b"], x["of_b"], s["total"] + F.least(s["n"], s["m"])))

    n = F.aggregate(tagged, run(F.lit("").cast("string"), F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["total"] + F.least(s["n"], s["m"]))
    return T.bound(n, lambda k: F.struct(k.alias("overlap"), F.when(F.size(a) > 0, k / F.size(a)).otherwise(0.0).alias("recall"), F.when(F.size(b) > 0, k / F.size(b)).otherwise(0.0).alias("precision")))


def token_precision(a: Column, b: Column) -> Column:
    """The precision of token_overlap; where either side has no token twice, its shared tokens are those of the two sets, which takes less time."""
    once = (F.size(F.array_distinct(b)) == F.size(b)) | (F.size(F.array_distinct(a)) == F.size(a))
    shared = F.when(once, F.size(F.array_intersect(a, b))).otherwise(token_overlap(a, b)["overlap"])
    return F.when(F.size(b) > 0, shared / F.size(b)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(matching_ratios(list(zip(a, b))), dtype="float64")


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """Matching-block similarity of the texts' word tokens; matching.py says what counts. Spark has no function for it, and edit distance differs."""
    return words_ratio(*(T.word_tokens(F.col(x) if isinstance(x, str) else x) for x in (a, b)))


def words_ratio(a: Column, b: Column) -> Column:
    """sequence_ratio of texts of which the word tokens are known."""
    return _ratio(*(F.coalesce(F.array_join(x, " "), F.lit("")) for x in (a, b)))


def recognition_score(expected: str, recognized: str, k: int = 2) -> Column:
    """similarity, has_extra_tail, has_suffix and score of a recognized text."""
    a, b = T.word_tokens(F.col(expected)), T.word_tokens(F.col(recognized))
    s, extra, suffix = sequence_ratio(expected, recognized), extra_trailing(a, b, k), suffix_anchor(a, b, k)
    return F.struct(s.alias("similarity"), extra.alias("has_extra_tail"), suffix.alias("has_suffix"), (s - F.when(extra, 0.35).otherwise(0.0) - F.when(~suffix, 0.15).otherwise(0.0)).alias("score"))

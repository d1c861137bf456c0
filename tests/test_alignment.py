"""Word alignment against a plain table of costs."""

import random
import time

import pytest

from segloom.functions.alignment import edit_counts, edit_counts_of_pairs
from segloom.operators import quality as Q


def plain_counts(a, b):
    """The best of all (edits, substitutions, deletions, insertions) of each pair of beginnings."""
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [(0, 0, 0, 0)] if i == j == 0 else []
            if i and j:
                e, s, d, n = best[i - 1, j - 1]
                ways.append((e, s, d, n) if a[i - 1] == b[j - 1] else (e + 1, s + 1, d, n))
            if i:
                e, s, d, n = best[i - 1, j]
                ways.append((e + 1, s, d + 1, n))
            if j:
                e, s, d, n = best[i, j - 1]
                ways.append((e + 1, s, d, n + 1))
            best[i, j] = min(ways)
    _, s, d, n = best[len(a), len(b)]
    return len(a) - s - d, s, d, n


def test_random_lists():
    rng = random.Random(1)
    for _ in range(1500):
        words = "abcdefgh"[: rng.randrange(1, 9)]
        a = [rng.choice(words) for _ in range(rng.choice((0, 1, 3, 9, 25, 40)))]
        if rng.random() < 0.5:
            b = [rng.choice(words) for _ in range(rng.choice((0, 1, 3, 9, 25, 60)))]
        else:
            b = [w for w in a if rng.random() < 0.85]
            for _ in range(rng.randrange(4)):
                b.insert(rng.randrange(len(b) + 1), rng.choice(words))
        assert edit_counts(a, b) == plain_counts(a, b), (a, b)


def test_many_pairs_at_a_time():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdef")
    pairs = [([word() for _ in range(rng.choice((0, 1, 7, 30, 64, 65, 90)))], [word() for _ in range(rng.choice((0, 1, 7, 30, 64, 65, 90)))]) for _ in range(2500)]
    assert edit_counts_of_pairs(pairs) == [edit_counts(a, b) for a, b in pairs]
    assert edit_counts_of_pairs([]) == [] and edit_counts_of_pairs([([], [])]) == [(0, 0, 0, 0)]


def test_more_edits_than_the_first_band():
    rng = random.Random(2)
    for n in (60, 90):
        a, b = ([rng.choice("abc") for _ in range(n)] for _ in range(2))
        a, b = a + ["x"] * 30, ["y"] * 30 + b
        assert edit_counts(a, b) == plain_counts(a, b)


def test_long_texts_of_many_words_take_words_times_edits():
    n = 70_000  # more different words than there are places in a plane of Unicode
    a = list(range(n))
    b = [w for w in a if w % 7000 != 3500]
    b[100] = b[n // 2] = "?"
    began = time.process_time()
    assert edit_counts(a, b) == (n - 12, 2, 10, 0)
    assert time.process_time() - began < 20


def test_rows(spark):
    rows = [(1, "a b  c", "a x c d"), (2, "", "new words"), (3, None, None), (4, "gone", None), (5, "a b", "b a"), (1, "a b  c", "a x c d")]
    df = spark.createDataFrame(rows, "media_id long, reference string, recognized string").selectExpr("*", "media_id % 2 as `odd one`")
    got = [(r.media_id, r.hits, r.substitutions, r.deletions, r.insertions, round(r.wer, 6)) for r in Q.word_errors(df).orderBy("media_id").collect()]
    assert got == [(1, 2, 1, 0, 1, 0.666667)] * 2 + [(2, 0, 0, 0, 2, 2.0), (3, 0, 0, 0, 0, 0.0), (4, 0, 0, 1, 0, 1.0), (5, 1, 0, 1, 1, 1.0)]
    totals = {r["odd one"]: tuple(r)[1:] for r in Q.word_error_totals(Q.word_errors(df), "odd one").collect()}
    assert totals[1] == (5, 2, 1, 3, pytest.approx(6 / 8)) and totals[0] == (0, 0, 1, 2, 3.0)
    assert tuple(Q.word_error_totals(Q.word_errors(df.limit(0))).first()) == (0, 0, 0, 0, 0.0)
    assert Q.wer_cer(df).count() == 6

"""Alignment of two lists of words: hits, substitutions, deletions and insertions by banded edit distance over coded words.

Among the alignments with the fewest edits the one with the fewest substitutions counts, which is the one with the most hits; so
the four counts are unique. Words that both lists begin or end with are hits. Between them the table of costs is filled a row at
a time, and in a row only as far from the diagonal as there may be edits: that width starts small and doubles until the edits
found fit in it. Time is words times edits, memory one row. Short lists
are aligned many at a time in whole tables, with the same counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: An edit costs EDIT and a substitution one more, so that edits are counted first; more than any number of words.
EDIT = 1 << 31
_FAR = 1 << 61
#: Pairs of lists of at most SHORT words are laid out side by side, TOGETHER of them, and share the steps of numpy.
SHORT, TOGETHER = 64, 1024


def _banded(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Cost of the best alignment that strays at most `width` places from the diagonal."""
    row = np.full(len(b) + 1, _FAR, np.int64)
    step = np.arange(min(len(b), 2 * width) + 1, dtype=np.int64) * EDIT
    first = min(len(b), width) + 1
    row[:first] = step[:first] if first <= len(step) else np.arange(first, dtype=np.int64) * EDIT
    for i, word in enumerate(a, 1):
        low, high = max(0, i - width), min(len(b), i + width)
        left = max(low - 1, 0)
        cost = row[low : high + 1] + EDIT
        swapped = row[left:high] + np.where(b[left:high] == word, 0, EDIT + 1)
        tail = cost[len(cost) - len(swapped) :]
        np.minimum(tail, swapped, out=tail)
        ramp = step[: len(cost)]
        row[low : high + 1] = np.minimum.accumulate(cost - ramp) + ramp  # insertions
    return int(row[-1])


def edit_counts(reference: Sequence, recognized: Sequence) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) that make the recognized list of the reference."""
    codes: dict = {}
    a, b = (np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)) for words in (reference, recognized))
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    more, most = len(a) - len(b), max(len(a), len(b))
    width = max(abs(more), 16)
    cost = _banded(a, b, width)
    while cost // EDIT > width and width < most:
        width = min(2 * width, most)
        cost = _banded(a, b, width)
    edits, swaps = divmod(cost, EDIT)
    deletions = (edits - swaps + more) // 2
    return head + tail + len(a) - swaps - deletions, swaps, deletions, deletions - more


def _side_by_side(pairs: list[tuple[Sequence, Sequence]]) -> list[tuple[int, int, int, int]]:
    sizes = np.array([(len(a), len(b)) for a, b in pairs], np.int64)
    n, m = sizes[:, 0], sizes[:, 1]
    a, b = np.full((len(pairs), n.max()), -1, np.int32), np.full((len(pairs), m.max()), -2, np.int32)
    for i, (x, y) in enumerate(pairs):
        codes: dict = {}
        a[i, : len(x)] = [codes.setdefault(w, len(codes)) for w in x]
        b[i, : len(y)] = [codes.setdefault(w, len(codes)) for w in y]
    ramp = np.arange(b.shape[1] + 1, dtype=np.int64) * EDIT
    row = np.tile(ramp, (len(pairs), 1))
    cost = np.take_along_axis(row, m[:, None], 1)[:, 0]
    for i in range(a.shape[1]):
        new = row + EDIT
        np.minimum(new[:, 1:], row[:, :-1] + np.where(b == a[:, i : i + 1], 0, EDIT + 1), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        cost = np.where(n == i + 1, np.take_along_axis(row, m[:, None], 1)[:, 0], cost)
    swaps = cost % EDIT
    deletions = (cost // EDIT - swaps + n - m) // 2
    return list(zip((n - swaps - deletions).tolist(), swaps.tolist(), deletions.tolist(), (deletions - n + m).tolist()))


def edit_counts_of_pairs(pairs: list[tuple[Sequence, Sequence]]) -> list[tuple[int, int, int, int]]:
    """edit_counts of each pair."""
    out: list = [None] * len(pairs)
    short = []
    for i, (a, b) in enumerate(pairs):
        if len(a) <= SHORT and len(b) <= SHORT:
            short.append(i)
        else:
            out[i] = edit_counts(a, b)
    for k in range(0, len(short), TOGETHER):
        some = short[k : k + TOGETHER]
        for i, counts in zip(some, _side_by_side([pairs[i] for i in some])):
            out[i] = counts
    return out

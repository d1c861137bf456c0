"""Matching-block similarity of two texts by suffix automata.

The longest common run of two windows is found by walking one of them through the suffix automaton of the other, in time that
is linear in their lengths; left and right of it the search goes on. Among equally long runs the first in `a` counts, then the
first in `b`. From 200 characters of `b` on, characters that make up more than a hundredth of it (and one more) start no run and
only lengthen one, so that blanks don't decide. The ratio is twice the matched characters over all characters.

Short texts are compared many pairs at a time: equal places of a pair are bits of a table, those where a run of k characters begins
follow from those of shorter ones by a shift along the diagonals, and from the longest runs to the shortest each window of each
pair takes its first one, in numpy, with the same choice among equally long runs. A single short pair is a table of
bits, one for each pair of places, in one integer: the places where a run of k characters begins follow from those of shorter
ones by a shift along the diagonals, so that the longest run takes a few operations.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np

SHORT = 250_000  # cells of a pair that is compared together with others
WORDS = 1 << 18  # of 64 cells, of tables that are laid at once
LAID = 1 << 21  # words of the places of all characters in each `b` of these tables
LONG = 12  # characters of a run; pairs in whose table a longer one is are few, and are settled one by one
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def popular(b: str) -> frozenset[str]:
    """Characters that start no run."""
    if len(b) < 200:
        return frozenset()
    most = len(b) // 100 + 1
    return frozenset(x for x, n in Counter(b).items() if n > most)


def longest_run(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int, dull: frozenset[str]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run of the two windows; length 0 if there is none."""
    follow, link, size, first, last = [{}], [-1], [0], [-1], 0
    for i in range(alo, ahi) if not dull.issuperset(b[blo:bhi]) else ():  # the automaton of a's window; first[v] is where the strings of v end first
        x, new = a[i], len(follow)
        follow.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        p, last = last, new
        while p >= 0 and x not in follow[p]:
            follow[p][x] = new
            p = link[p]
        if p >= 0:
            q = follow[p][x]
            if size[q] != size[p] + 1:
                copy = len(follow)
                follow.append(follow[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = copy
                while p >= 0 and follow[p].get(x) == q:
                    follow[p][x] = copy
                    p = link[p]
                q = copy
            link[new] = q
    best = (alo, blo, 0)
    v = n = 0
    for j in range(blo, bhi):
        x = b[j]
        if x in dull:
            v = n = 0
            continue
        while v and x not in follow[v]:
            v = link[v]
            n = size[v]
        v = follow[v].get(x, 0)
        n = n + 1 if v else 0
        if n > best[2] or (n == best[2] and n and first[v] - n + 1 < best[0]):
            best = first[v] - n + 1, j - n + 1, n
    i, j, n = best
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
        n += 1
    return i, j, n


@lru_cache(64)
def rows_of(b: str, dull: frozenset[str]) -> tuple[dict[str, bytes], int]:
    """The places of each character of b as bits, and how many bits there are: at least one more than b is long, so that no run goes on in the next row."""
    rows: dict[str, int] = {}
    for j, x in enumerate(b):
        if x not in dull:
            rows[x] = rows.get(x, 0) | 1 << j
    size = len(b) // 8 + 1
    return {x: v.to_bytes(size, "little") for x, v in rows.items()}, size * 8


class Table:
    """Equal characters of two short texts as bits, place i of `a` and j of `b` at i * wide + j; those that start no run are left out."""

    def __init__(self, a: str, b: str, dull: frozenset[str]):
        self.a, self.b = a, b
        row, self.wide = rows_of(b, dull)
        none = bytes(self.wide // 8)
        self.same = int.from_bytes(b"".join([row.get(x, none) for x in a]), "little")
        self.first = int.from_bytes((b"\1" + none[1:]) * len(a), "little")  # the first place of each row

    def longest_run(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """What the function of this name gives."""
        a, b, wide = self.a, self.b, self.wide
        bits = (ahi - alo) * wide
        runs = (self.same >> alo * wide) & ((1 << bits) - 1) & ((self.first & ((1 << bits) - 1)) * ((1 << bhi) - (1 << blo)))
        i, j, n = alo, blo, 0
        if runs:
            n, doubled = 1, [(1, runs)]
            while longer := runs & (runs >> n * (wide + 1)):
                n, runs = 2 * n, longer
                doubled.append((n, runs))
            for k, begin in reversed(doubled[:-1]):  # runs holds where a run of n begins; begin, where one of k does
                if longer := runs & (begin >> n * (wide + 1)):
                    n, runs = n + k, longer
            i, j = divmod((runs & -runs).bit_length() - 1, wide)
            i += alo
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return i, j, n


def matched(a: str, b: str, least: int = 0) -> int:
    """How many characters stand in matching blocks; if they can't be more than `least`, some number up to it."""
    dull, total, open_ = popular(b), 0, min(len(a), len(b))
    table = Table(a, b, dull) if len(a) * len(b) <= SHORT and open_ > least else None
    todo = [(-open_, 0, len(a), 0, len(b))]
    while todo and total + open_ > least:  # the windows that could hold most come first
        most, alo, ahi, blo, bhi = heappop(todo)
        open_ += most
        if set(a[alo:ahi]).isdisjoint(b[blo:bhi]):
            continue
        i, j, n = table.longest_run(alo, ahi, blo, bhi) if table else longest_run(a, alo, ahi, b, blo, bhi, dull)
        if n:
            total += n
            for x in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                most = min(x[1] - x[0], x[3] - x[2])
                if most:
                    open_ += most
                    heappush(todo, (-most, *x))
    return total if not todo else total + open_


def matching_ratio(a: str, b: str, least: float = 0.0) -> float:
    """From 0 to 1; 1 for equal texts, 0 if either is empty. If it can't be more than `least`, some number up to that, which takes less time."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2.0 * matched(a, b, int(least * (len(a) + len(b)) / 2)) / (len(a) + len(b))


def _shared_tables(pairs: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Texts to lay a table of, and the table of each pair: pairs of one `a` whose `b` begin alike, as cuts of a text do, have one table."""
    tables: list[tuple[str, str]] = []
    of = [0] * len(pairs)
    same: dict[str, list[int]] = {}
    for k, (a, _) in enumerate(pairs):
        if a in same:
            same[a].append(k)
        else:
            same[a] = [k]
    for a, ks in same.items():
        if len(ks) > 1:
            ks.sort(key=lambda k: -len(pairs[k][1]))
        last = None
        for k in ks:
            b = pairs[k][1]
            if last is None or not last.startswith(b) or (len(last) >= 200 and popular(last) != popular(b)):
                last = b
                tables.append((a, b))
            of[k] = len(tables) - 1
    return tables, np.array(of, np.int64)


def _runs(same: np.ndarray, wide: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The places where runs of 2, 3, ... LONG characters begin, as words of bits that hold any: their numbers and the words; and the numbers for longer ones."""
    runs = []
    bits = same[wide:-1] >> np.uint64(1)
    bits |= same[wide + 1 :] << np.uint64(63)
    bits &= same[: -wide - 1]
    at = np.flatnonzero(bits)
    bits = bits[at]
    while len(at) and len(runs) < LONG - 1:
        runs.append((at, bits))
        k = len(runs) + 1
        further, shift = k * wide + k // 64, np.uint64(k % 64)
        bits = bits & ((same[at + further] >> shift) | (same[at + further + 1] << (np.uint64(64) - shift)))
        more = np.flatnonzero(bits)
        at, bits = at[more], bits[more]
    return runs, at


def _from(place: np.ndarray) -> np.ndarray:
    """Words whose bits from a place on are set: all of them if it is below 0, none from 64 on."""
    return FULL << np.maximum(place, 0).view(np.uint64)


def _matched_in(tables: list[tuple[str, str]], of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """matched() of pairs, or -1 where a table has a run longer than LONG: of is the table of each, ends how much of its `b` is the pair's.

    A table has a row for each place of `a` and one more, and a bit for each place of `b` and at least one more, so that no run goes
    on in the next row. From the longest runs to the shortest, each window takes the first run of that length in it, then the first right
    below that one, and so on: no window holds a longer run by then, and none of the length is left above the one that is taken.
    """
    sizes = [np.array([len(t[side]) for t in tables]) for side in (0, 1)]
    by = (int(sizes[1].max()) // 64).bit_length()
    wide = 1 << by  # words of a row
    a, b = (np.frombuffer("".join(t[side] + end for t in tables).encode("utf-32-le", "surrogatepass"), np.uint32) for side, end in ((0, "\0"), (1, "")))
    first_b = np.cumsum(sizes[1]) - sizes[1]
    rows = np.cumsum(sizes[0] + 1) - sizes[0] - 1  # the first of each table
    table_of, owner_b = (np.repeat(np.arange(len(tables)), n) for n in (sizes[0] + 1, sizes[1]))  # of each row, and of each place of b
    starts = np.ones(len(b), bool)
    loose = np.zeros(len(tables), bool)  # tables with characters that start no run
    for t in np.flatnonzero(sizes[1] >= 200):
        dull = popular(tables[t][1])
        if dull:
            part = slice(first_b[t], first_b[t] + sizes[1][t])
            starts[part], loose[t] = ~np.isin(b[part], [ord(x) for x in dull]), True
    any_loose = loose.any()
    known = np.zeros(max(int(a.max()), int(b.max())) + 1, bool)
    known[b] = True
    code = np.cumsum(known) * known  # 0: in no b
    kinds = int(code.max()) + 1
    if len(tables) > 1 and len(tables) * kinds * wide > LAID:
        total, half = np.zeros(len(of), np.int64), len(tables) // 2
        for part, own, low in ((of < half, tables[:half], 0), (of >= half, tables[half:], half)):
            total[part] = _matched_in(own, of[part] - low, ends[part])
        return total
    place = np.arange(len(b)) - first_b[owner_b]
    bits = np.zeros(len(tables) * kinds * wide, np.uint64)
    np.add.at(bits, ((owner_b * kinds + code[b]) * wide + place // 64)[starts], (np.uint64(1) << (place % 64).astype(np.uint64))[starts])
    kind = code[a]
    kind[rows + sizes[0]] = 0
    same = np.zeros((len(a) + 2, wide), np.uint64)
    np.take(bits.reshape(-1, wide), table_of * kinds + kind, axis=0, out=same[:-2], mode="clip")
    same = same.reshape(-1)
    runs, longer = _runs(same, wide)
    late = np.zeros(len(tables), bool)
    late[table_of[longer >> by]] = True
    longest = np.ones(len(tables), np.int64)
    for k, (at, _) in enumerate(runs, 2):
        longest[table_of[at >> by]] = k
    total = np.where(late[of], -1, 0)
    # pair, rows from and to, places of b from and to
    begin = np.stack([np.arange(len(of)), rows[of], rows[of] + sizes[0][of], np.zeros(len(of), np.int64), ends])
    most = np.minimum(longest[of], ends)
    order = np.argsort(most, kind="stable")
    order = order[~late[of[order]]]
    begin, most = begin[:, order], most[order]
    windows = begin[:, :0]
    for k in range(len(runs) + 1, 0, -1):
        lo, hi = np.searchsorted(most, (k, k + 1))
        windows = np.concatenate([windows, begin[:, lo:hi]], axis=1)  # those in whose table no longer run is
        fits = np.minimum(windows[2] - windows[1], windows[4] - windows[3]) >= k
        now, left = windows.take(np.flatnonzero(fits), axis=1), [windows.take(np.flatnonzero(~fits), axis=1)]
        if not now.shape[1]:
            continue
        pair, top, bottom, blo, bhi = now
        lo, hi = top << by, (bottom - k + 1) << by
        if k > 1:
            at, bits = runs[k - 2]
            if len(pair) << 4 > len(same):
                before = np.zeros(len(same) + 1, np.int64)
                before[at + 1] = 1
                before = np.cumsum(before)
                lo, hi = before[lo], before[hi]
            else:
                lo, hi = np.searchsorted(at, lo), np.searchsorted(at, hi)
        count = hi - lo
        win = np.repeat(np.arange(len(pair)), count)
        word = np.arange(len(win)) + np.repeat(lo - np.cumsum(count) + count, count)
        word, x = (word, same[word]) if k == 1 else (at[word], bits[word])
        col = np.arange(wide) * 64
        x &= (_from(blo[:, None] - col) & ~_from(bhi[:, None] - k + 1 - col)).reshape(-1)[(win << by) + (word & wide - 1)]
        keep = np.flatnonzero(x)
        win, x, word = win[keep], x[keep], word[keep]
        row, col, keep = word >> by, (word & wide - 1) << 6, np.arange(len(keep))
        while len(keep):
            win, row, col, x = win[keep], row[keep], col[keep], x[keep]
            head = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]]))
            w, i, j, n = win[head], row[head], col[head] + np.bitwise_count((x[head] & -x[head]) - np.uint64(1)), np.full(len(head), k)
            if any_loose:
                for back in (True, False):  # what starts no run may lengthen one
                    grow = np.flatnonzero(loose[of[pair[w]]])
                    while len(grow):
                        v, p, q = w[grow], i[grow], j[grow]
                        if not back:
                            p, q = p + n[grow], q + n[grow]
                        grow, v, p, q = (y[(p > top[v]) & (q > blo[v]) if back else (p < bottom[v]) & (q < bhi[v])] for y in (grow, v, p, q))
                        equal = a[p - back] == b[first_b[of[pair[v]]] + q - back]
                        grow = grow[equal]
                        i[grow] -= back
                        j[grow] -= back
                        n[grow] += 1
            np.add.at(total, pair[w], n)
            above = np.flatnonzero((i > top[w]) & (j > blo[w]))
            v = w[above]
            left.append(np.stack([pair[v], top[v], i[above], blo[v], j[above]]))
            top[w], blo[w] = i + n, j + n
            x &= _from(blo[win] - col)
            keep = np.flatnonzero((row >= top[win]) & (x != 0))
        left.append(now.take(np.flatnonzero((bottom > top) & (bhi > blo)), axis=1))
        windows = np.concatenate(left, axis=1)
    if any_loose:
        windows = windows[:, loose[of[windows[0]]]]
        while windows.shape[1]:  # where no run begins, one may still go on from the corner
            pair, i, _, j, _ = windows = windows[:, (windows[1] < windows[2]) & (windows[3] < windows[4])]
            equal = a[i] == b[first_b[of[pair]] + j]
            np.add.at(total, pair[equal], 1)
            windows = windows[:, equal] + np.array([[0], [1], [0], [1], [0]])
    return total


def _matched_together(pairs: list[tuple[str, str]]) -> np.ndarray:
    """matched() of each pair."""
    tables, of = _shared_tables(pairs)
    ends = np.array([len(b) for _, b in pairs])
    wide = np.array([1 << (len(b) // 64).bit_length() for _, b in tables])
    words = np.array([len(a) + 1 for a, _ in tables]) * wide
    order = np.argsort(wide, kind="stable")
    group = np.concatenate([[0], np.cumsum((np.diff(wide[order]) > 0))]) * (1 << 32) + np.cumsum(words[order]) // WORDS
    total = np.zeros(len(pairs), np.int64)
    rank = np.empty(len(tables), np.int64)
    rank[order] = np.arange(len(tables))
    by_rank = np.argsort(rank[of], kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(tables)]])
    cut = np.searchsorted(rank[of][by_rank], edges)
    for lo, hi, begin, end in zip(edges[:-1], edges[1:], cut[:-1], cut[1:]):
        part = by_rank[begin:end]
        total[part] = _matched_in([tables[t] for t in order[lo:hi]], rank[of[part]] - lo, ends[part])
    for k in np.flatnonzero(total < 0):
        total[k] = matched(*pairs[k])
    return total


def matching_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """matching_ratio of each pair; equal pairs are compared once, short ones together."""
    number: dict[tuple[str, str], int] = {}
    which = [number.setdefault(p, len(number)) for p in pairs]
    ratio, short, left = [0.0] * len(number), [], []
    for k, (a, b) in enumerate(number):
        n, m = len(a), len(b)
        if not n or not m or n * m > SHORT:
            ratio[k] = matching_ratio(a, b)
        elif a == b or (m < 200 and (b in a or a in b)):  # one run is the whole of either
            ratio[k] = 2.0 * min(n, m) / (n + m)
        else:
            short.append((a, b))
            left.append(k)
    if short:
        for k, (a, b), n in zip(left, short, _matched_together(short).tolist()):
            ratio[k] = 2.0 * n / (len(a) + len(b))
    return [ratio[k] for k in which]

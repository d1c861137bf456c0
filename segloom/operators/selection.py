"""Lazy greedy choice of diverse reference clips among one speaker's candidates.

A clip's worth falls as others are chosen: bonuses for what is new go, the penalty for likeness to a chosen clip grows. A heap
therefore holds upper bounds, and only the clip at its top is looked at again. For likeness, each new choice gives all
candidates a bound in one pass over arrays (shared characters over all characters); the exact ratio is computed only for a clip
at the top whose bound could change its worth, and once per pair.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pandas as pd

from ..functions.matching import matching_ratio

CLASSES = 64  # of characters; merging them only loosens the bound


class Candidates:
    """Candidates in order of preference (score, duration, source_index), with bounds and exact likeness of their signatures."""

    def __init__(self, p: Mapping[str, Iterable]):
        """p: the columns by their names, as of a pandas frame."""
        own = {c: p[c].tolist() if isinstance(p[c], pd.Series) else list(p[c]) for c in p}
        last = lambda x: math.inf if x is None or x != x else -x
        order = sorted(range(len(own["score"])), key=lambda i: (last(own["score"][i]), -own["duration_ms"][i], own["source_index"][i]))
        self.rows = {c: [v[i] for i in order] for c, v in own.items()}
        self.n = len(order)
        self.start, self.end = np.array(self.rows["start_ms"]), np.array(self.rows["end_ms"])
        self.score, self.bucket, self.place, self.question = (self.rows[c] for c in ("score", "duration_bucket", "timeline_bucket", "question"))
        self.text = [x or "" for x in self.rows["text_signature"]]
        self.size = np.array([len(x) for x in self.text])
        self.often = np.zeros((self.n, CLASSES), np.int32)
        for i, x in enumerate(self.text):
            self.often[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
        self.known: dict[tuple[int, int], float] = {}

    def near(self, j: int, gap: float) -> np.ndarray:
        """Which candidates stand closer to j than the gap."""
        return (self.start < self.end[j] + gap) & (self.start[j] < self.end + gap)

    def bound(self, j: int) -> np.ndarray:
        """At least the likeness of each candidate to j."""
        both = np.minimum(self.often, self.often[j]).sum(axis=1)
        return np.where((self.size > 0) & (self.size[j] > 0), 2.0 * both / np.maximum(1, self.size + self.size[j]), 0.0)

    def likeness(self, i: int, j: int, least: float) -> float:
        """Exact where it is above `least`; callers ask for the choices in their order and count only what is above all before, so a bound below does as well."""
        if (i, j) not in self.known:
            self.known[i, j] = matching_ratio(self.text[i], self.text[j], least)
        return self.known[i, j]

    def grow(self, chosen: list[int], most: int, gap: float, skip: float, base: float, slope: float, bonus: Callable[[int, list[int]], float]) -> dict[int, float]:
        """Adds to `chosen` the best one each time, until `most` are there or none is left; gives the worth of those added."""
        alive, worth = np.ones(self.n, bool), {}
        alive[chosen] = False
        bounds = [self.bound(j) for j in chosen]
        for j in chosen:
            alive &= ~self.near(j, gap)
        like = np.zeros(self.n)  # the greatest likeness to a chosen clip that is known
        seen = [0] * self.n  # how many of the chosen have been dealt with

        def value(i: int) -> float:
            return self.score[i] + bonus(i, chosen) - (max(0.0, float(like[i]) - base) * slope if chosen else 0.0)

        heap = [(-value(i), i) for i in np.flatnonzero(alive).tolist()]
        heapq.heapify(heap)
        while heap and len(chosen) < most:
            _, i = heapq.heappop(heap)
            if not alive[i]:
                continue
            for k in range(seen[i], len(chosen)):  # only what could raise the likeness above the base
                if bounds[k][i] > max(like[i], base):
                    like[i] = max(like[i], self.likeness(i, chosen[k], max(float(like[i]), base)))
            seen[i] = len(chosen)
            if chosen and like[i] >= skip:
                continue
            now = value(i)
            if heap and heap[0] < (-now, i):
                heapq.heappush(heap, (-now, i))
                continue
            worth[i] = now
            chosen.append(i)
            bounds.append(self.bound(i))
            alive &= ~self.near(i, gap)
            alive[i] = False
        return worth


def chosen_clips(c: Candidates, k: int, gap_ms: int, routing_k: int) -> list[tuple[str, int, float]]:
    """(pool, row, worth) of the clips chosen among one speaker's candidates.

    If fewer than k are diverse enough, others follow in order of preference; such a clip keeps the worth it had before the
    first choice that it was too like to. Clips of the stable pool begin the routing pool with the worth they have there.
    """
    new = lambda what, i, chosen: what[i] not in {what[j] for j in chosen}
    asks = lambda i, chosen: bool(c.question[i]) and not any(c.question[j] for j in chosen)
    first = lambda i, chosen: 0.35 * new(c.bucket, i, chosen) + 0.35 * asks(i, chosen)
    stable: list[int] = []
    worth = c.grow(stable, k, gap_ms, 0.93, 0.55, 2.2, first)
    diverse = list(stable)
    for i in range(c.n) if len(stable) < k else ():
        if len(stable) < k and i not in stable and not any(c.near(j, gap_ms)[i] for j in stable):
            before, like = [], 0.0
            for j in diverse:
                now = c.likeness(i, j, max(like, 0.55))
                if now >= 0.93:
                    break
                before.append(j)
                like = max(like, now)
            worth[i] = c.score[i] + first(i, before) - (max(0.0, like - 0.55) * 2.2 if before else 0.0)
            stable.append(i)
    routing = list(stable)
    more = c.grow(routing, max(k, routing_k), max(600, gap_ms * 0.5), 0.96, 0.7, 1.8, lambda i, chosen: 0.2 * new(c.bucket, i, chosen) + 0.25 * new(c.place, i, chosen) + 0.2 * asks(i, chosen))
    return [("stable", i, worth[i]) for i in stable] + [("routing", i, (worth | more)[i]) for i in routing]

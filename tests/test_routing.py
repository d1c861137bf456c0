"""Routing of references against a plain version, one segment at a time."""

import random
import re

import pytest

BUCKETS = ("short", "medium", "long")


def plain(clips, max_refs, margin):
    """clips: (pool, path, bucket, score) of one segment."""

    def pick(pool):
        left, got = sorted((c for c in clips if c[0] == pool), key=lambda c: (-c[3], c[1])), []
        while left and len(got) < max_refs:
            best = max(left, key=lambda c: (c[3] + (0.18 if got and c[2] not in {g[2] for g in got} else 0), -left.index(c)))
            got.append(best)
            left.remove(best)
        return [c[1] for c in got]

    top = {p: max((c[3] for c in clips if c[0] == p), default=float("-inf")) for p in ("stable", "routing")}
    return ("routing", pick("routing")) if top["routing"] > float("-inf") and top["routing"] >= top["stable"] + margin else ("stable", pick("stable"))


@pytest.mark.parametrize("max_refs", [1, 2, 4])
def test_routes(spark, max_refs):
    from segloom.operators.clips import route_references

    rng, scored, segments = random.Random(max_refs), [], []
    for i in range(40):
        ms, text = (5000, "one two three") if i % 7 == 0 else (500, "one two three") if i % 11 == 0 else (1500, "one two") if i % 13 == 0 else (1500, "one two three")
        segments.append((1, i, "s", text, 0, ms))
        for k in range(i % 6):
            scored.append((1, i, "s", rng.choice(("stable", "routing")), f"p{k}", rng.choice(BUCKETS), rng.randrange(40) / 16))
    frame = spark.createDataFrame(scored, "media_id long, seg_idx long, speaker_id string, pool string, path string, duration_bucket string, route_score double")
    texts = spark.createDataFrame(segments, "media_id long, seg_idx long, speaker_id string, text string, start_ms long, end_ms long")
    other = spark.createDataFrame([(1, ["else"])], "media_id long, paths array<string>")
    got = {r.seg_idx: (r.pool, r.paths) for r in route_references(frame, texts, other, max_refs).collect()}
    for _, i, _, text, _, ms in segments:
        clips = [(c[3], c[4], c[5], c[6]) for c in scored if c[1] == i]
        fits = clips and 900 <= ms <= 2200 and len(text.split()) >= 3
        assert got[i] == (plain(clips, max_refs, 0.45) if fits else ("fallback", ["else"])), i


def suits(text, ms, clip):
    """A plain version of the score of a clip for a segment."""
    bucket = lambda d: "short" if d < 4000 else "medium" if d < 7000 else "long"
    a, b, d, e = text.strip(), clip.text.strip(), max(200, ms), max(200, clip.duration_ms)
    score = max(-1.0, 1.8 - abs(e - d) / max(d, 1200))
    score += 0.7 if bucket(d) == clip.duration_bucket else 0.25 if "medium" in (bucket(d), clip.duration_bucket) else -0.15
    score += 0.45 if a.endswith("?") and b.endswith("?") else -0.2 if a.endswith("?") != b.endswith("?") else 0.0
    n, m = len(re.findall(r"\w+", a)), len(re.findall(r"\w+", b))
    score += max(-0.4, 0.8 - abs(m - n) / max(n, 4)) if n and m else 0.0
    score += sum(0.15 for x in ",!" if x in a and x in b)
    return score + min(clip.selection_score or 0.0, 6.0) * 0.08


def test_scores_of_chosen_clips(spark, sf):
    """Every segment has a score for each chosen clip of its speaker, and no other."""
    from segloom.fixtures import fixture
    from segloom.queries import QUERIES, clip_table, segs

    fx = lambda name: fixture(spark, sf, name)
    clips = {}
    for k in clip_table(fx).collect():
        clips.setdefault((k.media_id, k.speaker_id), []).append(k)
    want = {(s.media_id, s.seg_idx, k.pool, k.path): suits(s.text, s.end_ms - s.start_ms, k) for s in segs(fx).collect() for k in clips.get((s.media_id, s.speaker_id), [])}
    got = {(r.media_id, r.seg_idx, r.pool, r.path): r.route_score for r in QUERIES["segment_clip_score"](spark, sf).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(x, abs=2e-6) for k, x in want.items())

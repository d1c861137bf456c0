"""Chains of operators for whole media corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import quality as Q
from ..operators import segments as S


def diarized(words: DataFrame, raw_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, segments by speaker) from words and raw speaker turns."""
    turns, segments = S.normalize_turns(raw_turns), S.pause_segments(words)
    flat = segments.selectExpr("media_id", "seg_idx", "posexplode(words) as (word_idx, w)").selectExpr("media_id", "seg_idx", "cast(seg_idx * 1000000 + word_idx as bigint) as word_idx", "w.text as text", "w.start_ms as start_ms", "w.end_ms as end_ms")
    return turns, S.diarized_segments(S.speaker_overlap(flat, turns, "word_idx"), segments)


def finetune_records(segments: DataFrame, speaker: str | None = "spk_0") -> tuple[DataFrame, DataFrame]:
    """(records with their split, summary per media) of the segments that pass all checks."""
    checked = Q.finetune_reject_reason(segments, speaker)
    split = Q.finetune_split(checked.filter("reason is null"))
    return split, Q.finetune_summary(checked, split)

"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised. The exponent, between 0 (all sources alike) and 1 (as
they are), is bisected: either to the flattest mixture in which no source is repeated more than `max_repeats` times, or to the
one with a target entropy. A source's weight times the budget is its number of tokens: whole passes over its documents and a
part of one more. Each pass deals the documents anew into blocks by hash and orders them within a block by hash, so that no
source has to be sorted in one task; the last pass takes blocks in order, and documents in the block where the budget ends as
long as they fit. A source has a block for each BLOCK_TOKENS tokens or BLOCK_ROWS rows, whichever are more.

Tokens are words, `[^\\x20\\x09-\\x0D]+`. Null sources are one source of their own. Null and empty texts have no tokens: they come
once per whole pass, and in the last one if their place is before the end; a source of such texts alone comes once. Repeated rows
are numbered when the rows are first written, and dealt like others. Null doc_ids are kept. Empty tables give no rows. Extra
columns are carried on request.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: A block has about so many tokens, and a source at most so many blocks.
BLOCK_TOKENS, BLOCK_ROWS, MOST_BLOCKS = 100_000, 20_000, 1 << 17
#: Sources are planned on the driver, a row each, up to so many; their plan is broadcast only below BROADCAST of them.
MOST_SOURCES, BROADCAST = 1_000_000, 100_000


def tempered(totals: list[int], exponent: float) -> list[float]:
    """Normalised powers of the shares."""
    top = max(totals)
    powers = [(t / top) ** exponent for t in totals]
    s = math.fsum(powers)
    return [p / s for p in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def find_exponent(totals: list[int], budget: int, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The least exponent within the repetition limit, or the one with the target entropy (the nearest, if none has it)."""
    if max_repeats is not None:
        fits = lambda e: max(w * budget / t for w, t in zip(tempered(totals, e), totals)) <= max_repeats
    else:
        fits = lambda e: entropy(tempered(totals, e)) <= target_entropy
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan(totals: dict[str | None, int], budget: int | None = None, max_repeats: float | None = 1.5, target_entropy: float | None = None) -> list[tuple]:
    """(source, tokens, weight, tokens to take, whole passes, rest of the last pass, blocks) of each source."""
    some = {s: t for s, t in totals.items() if t > 0}
    budget = sum(some.values()) if budget is None else budget
    out = [(s, 0, 0.0, 0, 1, 0, 1) for s, t in totals.items() if t <= 0]
    if some:
        ts = list(some.values())
        for (s, t), w in zip(some.items(), tempered(ts, find_exponent(ts, budget, max_repeats, target_entropy))):
            take = math.floor(w * budget)
            out.append((s, t, w, take, take // t, take % t, min(MOST_BLOCKS, -(-t // BLOCK_TOKENS))))
    return out


def n_tokens(text: F.Column) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mixed(docs: DataFrame, seed: int = 42, budget: int | None = None, max_repeats: float | None = 1.5, target_entropy: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch (pass), block, pos (from 1 in the block), mix_at, and `keep`.

    mix_at is the part of the source's tokens that come before; ordered by it, every stretch has the target weights.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "source")]
    rows = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("_uid"), *keep)
    rows = written(rows, "rows")  # so that tokens are counted once and a row keeps its number
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r.source: r.n for r in sums}
    plans = [(*p, min(MOST_BLOCKS, max(p[-1], -(-counts[p[0]] // BLOCK_ROWS)))) for p in plan({r.source: int(r.t or 0) for r in sums}, budget, max_repeats, target_entropy)]
    sources = docs.sparkSession.createDataFrame(plans, "source string, _t long, _w double, _take long, _full long, _rest long, _least long, _blocks long")
    names = [F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_s")]
    sources = sources.select(*names, "_take", "_full", "_rest", "_blocks")
    rows = rows.withColumn("_s", names[0]).join(F.broadcast(sources) if len(sums) < BROADCAST else sources, "_s")
    last = F.col("_full") + F.when(F.col("_rest") > 0, 0).otherwise(-1)
    rows = rows.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", "_uid")).withColumn("block", F.pmod(F.xxhash64("_h"), F.col("_blocks")))
    blocks = rows.groupBy("_s", "epoch", "block").agg(F.sum("n_tokens").alias("_in"))
    before = Window.partitionBy("_s", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_s", "epoch", "block", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_s", "epoch", "block").orderBy("_h", "_uid")
    rows = rows.withColumn("pos", F.row_number().over(own)).withColumn("_sum", F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(blocks, ["_s", "epoch", "block"])
    end = F.col("_before") + F.col("_sum")
    rows = rows.filter((F.col("epoch") < F.col("_full")) | (end <= F.col("_rest")))
    whole = F.greatest(F.col("_take"), F.lit(1))
    t = (F.col("_take") - F.col("_rest")) / F.greatest(F.col("_full"), F.lit(1))
    at = (F.col("epoch") * t + end - F.col("n_tokens")) / whole
    return rows.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", "pos", at.alias("mix_at"), *keep)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))

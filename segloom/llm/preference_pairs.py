"""Preference pairs: the common prefix of turns of a chosen and a rejected conversation is rendered once, as the prompt; what follows is a completion each.

DataFrame functions only. A turn is rendered as `<|role|>`, a line feed, the text, `<|end|>` and a line feed. The mask of a
completion lists the character ranges [first, last) to train on: the text of assistant turns with its `<|end|>`; the prompt
is never trained on. One shuffle, by pair: a conversation is one value of one row.

Null roles and texts count as empty. Turns are ordered by turn (null first), role and text; repeated rows are turns of their own.
A pair with one side missing has an empty prompt and an empty completion there. Rows without a pair belong to none. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Ranges as `first-last`, joined by commas."""
    head = lambda t: F.length(t["role"]) + 5
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("ranges"))

    def add(s: Column, t: Column) -> Column:
        first = s["at"] + head(t)
        last = first + F.length(t["text"]) + 7
        own = F.concat_ws("-", first.cast("string"), last.cast("string"))
        ranges = F.when(t["role"] == "assistant", F.concat(s["ranges"], F.array(own))).otherwise(s["ranges"])
        return F.struct((last + 1).cast("int").alias("at"), ranges.alias("ranges"))

    return F.array_join(F.aggregate(turns, start, add, lambda s: s["ranges"]), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text -> pair_id, n_prompt, n_chosen, n_rejected (turns), prompt, chosen, rejected, chosen_mask, rejected_mask."""
    empty = F.lit("")
    t = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    side = lambda yes: F.array_sort(F.collect_list(F.when(F.col("chosen") if yes else ~F.col("chosen"), t)))
    pairs = turns.filter("pair_id is not null and chosen is not null").groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    alike = F.zip_with("a", "b", lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    prefix = F.when(F.array_contains(alike, False), F.array_position(alike, False).cast("int") - 1).otherwise(shorter)
    pairs = pairs.withColumn("n", prefix)
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    return pairs.select(
        "pair_id",
        F.col("n").alias("n_prompt"),
        (F.size("a") - F.col("n")).alias("n_chosen"),
        (F.size("b") - F.col("n")).alias("n_rejected"),
        _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("a")).alias("chosen"),
        _rendered(rest("b")).alias("rejected"),
        _mask(rest("a")).alias("chosen_mask"),
        _mask(rest("b")).alias("rejected_mask"),
    )


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    c = table(spark, sf_dir, "conversations")
    return preference_pairs(c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


OP9_SQL = r"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 = 0 as chosen, coalesce(role, '') as role, coalesce(text, '') as text,
             row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
d as (select a.pair_id, min(a.i) as i from t a left join t b on a.pair_id = b.pair_id and a.chosen <> b.chosen and a.i = b.i and a.role = b.role and a.text = b.text where b.i is null group by a.pair_id),
p as (select t.pair_id, coalesce(min(d.i) - 1, max(t.i)) as n from t left join d on t.pair_id = d.pair_id group by t.pair_id),
r as (select t.pair_id, t.chosen, t.i, p.n, t.role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s, length(role) + 5 as head from t join p on t.pair_id = p.pair_id),
m as (select *, sum(length(s)) over (partition by pair_id, chosen, i > n order by i) - length(s) as base from r)
select pair_id, cast(any_value(n) as integer) as n_prompt, cast(count(*) filter (chosen and i > n) as integer) as n_chosen, cast(count(*) filter (not chosen and i > n) as integer) as n_rejected,
  coalesce(string_agg(s, '' order by i) filter (chosen and i <= n), '') as prompt,
  coalesce(string_agg(s, '' order by i) filter (chosen and i > n), '') as chosen,
  coalesce(string_agg(s, '' order by i) filter (not chosen and i > n), '') as rejected,
  coalesce(string_agg(cast(base + head as bigint)::varchar || '-' || cast(base + length(s) - 1 as bigint)::varchar, ',' order by i) filter (chosen and i > n and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(base + head as bigint)::varchar || '-' || cast(base + length(s) - 1 as bigint)::varchar, ',' order by i) filter (not chosen and i > n and role = 'assistant'), '') as rejected_mask
from m group by pair_id
"""

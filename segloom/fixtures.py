"""Time-aligned views derived from the given tables, in Spark SQL and in DuckDB SQL; times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TIMED = """select media_id, turn, pos, speaker_label, word, 60 + 35 * length(word) as dur_ms,
  case when pos = 0 then 700 when prev_word is null then 0
       when right(prev_word, 1) in ('.', '!', '?') then 420
       when right(prev_word, 1) in (',', ';', ':') then 180 else 40 end as gap_ms
  from (select *, lag(word) over (partition by media_id order by turn, pos) as prev_word from toks) q"""
_WORDS = """select media_id, row_number() over (partition by media_id order by turn, pos) - 1 as word_idx, turn, pos, speaker_label, word as text,
  cast(end_ms - dur_ms as bigint) as start_ms, end_ms
  from (select *, cast(sum(gap_ms + dur_ms) over (partition by media_id order by turn, pos rows between unbounded preceding and current row) as bigint) as end_ms from timed) z"""
_TURNS = """select media_id, turn, speaker_label,
  cast(greatest(0, min(start_ms) + ((media_id * 7 + turn * 13) % 5 - 2) * 600) as bigint) as start_ms,
  cast(max(end_ms) + ((media_id * 3 + turn * 11) % 5 - 2) * 600 as bigint) as end_ms
  from words_fx group by media_id, turn, speaker_label"""
#: A document is a medium; its lines, cut at every 20 words, are segments, and a translation is the piece one to three places on, so that both sides have the whole text.
_PAIR = "doc_id as media_id, i as seg_idx, original_text, text, i * 9000 as start_ms, i * 9000 + 3000 + (doc_id * 37 + i * 1117) % 6000 as end_ms, lang"
#: name -> (Spark SQL, DuckDB SQL or None for the same, names it reads)
VIEWS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    "toks": (
        "select conv_id as media_id, turn, p as pos, role as speaker_label, w as word from conversations lateral view posexplode(split(trim(regexp_replace(text, '[ \\\\t\\\\n\\\\r]+', ' ')), ' ')) e as p, w",
        "select media_id, turn, p - 1 as pos, speaker_label, ws[p] as word from (select conv_id as media_id, turn, role as speaker_label, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ') as ws from conversations) t, unnest(range(1, len(ws) + 1)) u(p)",
        ("conversations",),
    ),
    "timed": (_TIMED, None, ("toks",)),
    "words_fx": (_WORDS, None, ("timed",)),
    "turns_fx": (_TURNS, None, ("words_fx",)),
    "pieces": (
        "select doc_id, lang, split(regexp_replace(text, '((?:[^ ]* ){{19}}[^ ]*) ', '$1\\n'), '\\n') as p from documents",
        "select doc_id, lang, string_split(regexp_replace(text, '((?:[^ ]* ){19}[^ ]*) ', '\\1' || chr(10), 'g'), chr(10)) as p from documents",
        ("documents",),
    ),
    "pairs_fx": (
        f"select {_PAIR} from (select doc_id, lang, cast(i as bigint) as i, z.p as original_text, z.q as text from (select *, concat(slice(p, k + 1, size(p)), slice(p, 1, k)) as q from (select *, cast((1 + doc_id % 3) % size(p) as int) as k from pieces) a) b lateral view posexplode(arrays_zip(p, q)) e as i, z) d",
        f"select {_PAIR} from (select doc_id, lang, unnest(range(0, len(p))) as i, unnest(p) as original_text, unnest(list_concat(p[k + 1 :], p[1 : k])) as text from (select *, (1 + doc_id % 3) % len(p) as k from pieces) a) d",
        ("pieces",),
    ),
    "recog_fx": (
        "select item_id as media_id, text as expected, array_join(transform(filter(transform(split(text, ' '), (w, i) -> struct(w, i)), x -> x.i % 7 <> 6), x -> if(x.i % 11 = 5, concat(x.w, 'x'), x.w)), ' ') as recognized from benchmark",
        "select item_id as media_id, text as expected, array_to_string([case when (i - 1) % 11 = 5 then ws[i] || 'x' else ws[i] end for i in range(1, len(ws) + 1) if (i - 1) % 7 <> 6], ' ') as recognized from (select *, string_split(text, ' ') as ws from benchmark) b",
        ("benchmark",),
    ),
    "frames_fx": ("select user_id as media_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, value * value as sq_sum, 1 as n, value as peak from events", None, ("events",)),
    "takes_fx": ("select media_id, cast(floor(rn / 4) as bigint) as seg_idx, rn % 4 + 1 as attempt, least(1.0, value / 60) as score, event_type = 'error' as has_extra_tail, event_type <> 'view' as has_suffix from (select user_id as media_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events) e", None, ("events",)),
    "synth_fx": ("select user_id as media_id, event_id as seg_idx, 1 + event_id % 3 as tts_group_size, cast(round(value * 40) as bigint) + 200 as corrected_ms, case when event_id % 17 = 0 then null else 1000 + (event_id * 131) % 2500 end as timing_window_ms, case when event_type = 'error' then 80 + event_id % 200 else 0 end as cheap_tail_guard_trim_ms, event_type = 'purchase' as has_smart_sync from events", None, ("events",)),
    "jobs_fx": ("select o_orderkey as job_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else 'failed' end as status, o_orderdate as created_at from orders", None, ("orders",)),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, _, reads = VIEWS[name]
    for r in reads:
        text = _braced(text, r)
    return spark.sql(text, **{r: _dealt(fixture(spark, sf_dir, r), r) for r in reads})


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Whole texts are dealt out before they are cut: a file of few row groups would leave all work on them to as few tasks."""
    return rows.repartition("doc_id") if name == "documents" else rows


def _braced(text: str, name: str) -> str:
    for word in (f"from {name}",):
        text = text.replace(word, f"from {{{name}}}")
    return text


def with_sql(query: str, *names: str) -> str:
    """DuckDB SQL: the views that are named, and what they read, before the query."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for r in VIEWS[name][2]:
                add(r)
            done.append(name)

    for n in names:
        add(n)
    views = ",\n".join(f"{n} as ({VIEWS[n][1] or VIEWS[n][0]})" for n in done)
    if query.lstrip().lower().startswith("with "):
        recursive = query.lstrip()[5:].lstrip().lower().startswith("recursive ")
        rest = query.lstrip()[5:].lstrip()
        rest = rest[10:] if recursive else rest
        return f"with {'recursive ' if recursive else ''}{views},\n{rest}"
    return f"with {views}\n{query}"

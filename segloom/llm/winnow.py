"""Benchmark decontamination by winnowing.

Of every item and document the k-gram hashes of words are taken and, per window of `span` - k + 1 of them, the smallest is
kept (the rightmost of equal ones). Two equal runs of `span` words have the same hashes and so keep the same one, at the
same place: fingerprint matches therefore find every shared run of `span` words. Each match is extended to the runs of `span` words
around it, which are compared word by word with the one place that stands for all equal runs of the items; shorter runs don't
count. A passage that many items share thus costs a document no more than one that a single item has, but for naming the items.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. An item of fewer words, but not none, is one window;
such items are looked up by the hash of all their words. Null and empty texts have no words and hit nothing. Repeated
document rows give a row each, repeated items count once each by item_id; null item_ids are left out of the item list but
their windows count. Empty tables are fine. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, WordHashes, kept, mix, rows_out, runs, shingle_hashes, sliding_min, table, text_bytes, written

K = 7
#: An index of more benchmark words than this is cut into blocks, which are broadcast and applied one after another; one takes about 40 MB. An item is never cut: one that is longer makes a larger block.
BLOCK_WORDS = 1_000_000
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first: long, last: long>>"


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the kept hashes: per window of w the smallest, the rightmost of equal ones."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = sliding_min(hashes, w)
    last = np.full(n, -1, np.int64)
    for d in range(w):
        last = np.where(hashes[d : d + n] == low, np.arange(n) + d, last)
    return np.unique(last)


class Index:
    """A block of items: all their words in one array, fingerprints, and the distinct windows of `span` words, each with a place where it stands and the items that have it.

    Items that share a passage share its windows, so that a document is compared with each of them once, however many items have it.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], span: int, k: int = K):
        self.span, self.k, self.w = span, k, span - k + 1
        h, words, prints, starts, self.short = WordHashes(), [], [], [], {}
        at, self.ids = 0, []
        owners: list[np.ndarray] = []
        for item_id, text in items:
            ws = h.of(text.translate(ALNUM).split())
            if not len(ws):
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            if len(ws) < span:
                self.short.setdefault(len(ws), {}).setdefault(int(whole(ws)), []).append(number)
                continue
            grams = shingle_hashes(ws, k)
            prints.append(grams[winnowed(grams, self.w)])
            starts.append(np.arange(at, at + len(ws) - span + 1))
            owners.append(np.full(len(ws) - span + 1, number, np.int32))
            words.append(ws)
            at += len(ws)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))
        place, owner = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*owners, np.zeros(0, np.int32)])
        windows = wholes(self.words, span)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.lexsort((owner, windows))
        windows, owner, place = windows[order], owner[order], place[order]
        fresh = np.concatenate([[True], windows[1:] != windows[:-1]]) if len(windows) else np.zeros(0, bool)
        new = fresh | np.concatenate([[True], owner[1:] != owner[:-1]]) if len(windows) else fresh
        self.windows, self.at = windows[fresh], place[fresh]
        self.owners = owner[new]
        self.bounds = np.append(np.flatnonzero(fresh[new]), len(self.owners))

    def hits(self, ws: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """A mask of the document words inside occurring windows, and the numbers of the items that have such windows."""
        mask, found = np.zeros(len(ws), bool), set()
        for n, table_ in self.short.items():
            if len(ws) >= n:
                all_wholes = wholes(ws, n)
                places = np.flatnonzero(np.isin(all_wholes, np.fromiter(table_, np.uint64, len(table_))))
                for i in places:
                    mask[i : i + n] = True
                for x in np.unique(all_wholes[places]):
                    found.update(table_[int(x)])
        if len(ws) < self.span or not len(self.prints):
            return mask, found
        grams = shingle_hashes(ws, self.k)
        keep = winnowed(grams, self.w)
        keep = keep[member(self.prints, grams[keep])[0]]
        if not len(keep):
            return mask, found
        # Every shared window has a kept fingerprint of both sides at the same place: extend each match to the windows around it.
        around = (keep[:, None] - np.arange(self.w)).ravel()
        around = np.unique(around[(around >= 0) & (around <= len(ws) - self.span)])
        same, at = member(self.windows, wholes(ws, self.span)[around])
        around, at = around[same], at[same]
        equal = np.ones(len(around), bool)
        for d in range(self.span):
            equal &= ws[around + d] == self.words[self.at[at] + d]
        around, at = around[equal], np.unique(at[equal])
        edge = np.zeros(len(ws) + 1, np.int64)
        edge[around] += 1
        edge[around + self.span] -= 1
        mask |= edge.cumsum()[:-1] > 0
        if len(at):
            has = np.zeros(len(self.ids), bool)
            for a, b in zip(self.bounds[at], self.bounds[at + 1]):
                has[self.owners[a:b]] = True
            found.update(np.flatnonzero(has).tolist())
        return mask, found


def member(table_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values the sorted, non-empty table holds, and where."""
    at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
    return table_[at] == values, at


def whole(ws: np.ndarray) -> np.uint64:
    return wholes(ws, len(ws))[0]


def wholes(ws: np.ndarray, n: int) -> np.ndarray:
    return mix(shingle_hashes(ws, n) + np.uint64(n))


def _indexes(items: DataFrame, span: int, block_words: int) -> Iterator[bytes]:
    """The pickled index of each block of about block_words words. Spark deals the items to blocks and a task builds each; only indexes reach the driver, one at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-(chars // 5) // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(b.column("item_id").to_pylist(), text_bytes(b.column("text")), b.column("block").to_pylist())]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([found[0][2]], pa.int32()), pa.array([pickle.dumps(Index([x[:2] for x in found], span))], pa.binary())], names=["block", "index"])

    built = written(rows.withColumn("block", block).repartitionById(n, F.col("block")).mapInArrow(build, "block int, index binary"), "index")
    for k in range(n):
        got = built.filter(F.col("block") == k).select("index").first()
        if got:
            yield bytes(got[0])


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 13, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (item_ids as sorted strings), spans (array of [first, last) words), and `keep`.

    One pass over the documents and no shuffle while the benchmark fits one block; beyond, a pass a block, whose results are
    merged by row. Each index broadcast is bounded by block_words, or by the longest item. Columns of `keep` must have names other than the result's.
    """
    keep = keep or []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    indexes = _indexes(items, span, block_words)
    first = next(indexes, pickle.dumps(Index([], span)))
    second = next(indexes, None)
    if second is None:
        return _pass(base, first, keep)
    rows = written(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    every = _pass(rows, first, ["_row"]).unionByName(_pass(rows, second, ["_row"]))
    for index in indexes:
        every = every.unionByName(_pass(rows, index, ["_row"]))
    merged = every.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("n_items", F.size("items").cast("long"))
    # Overlapping spans of different blocks: count each word once.
    merged = merged.withColumn("n_hit", F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.last - greatest(a.e, s.first)), 'e', greatest(a.e, s.last)), a -> a.n)"))
    return rows.join(merged, "_row").select("doc_id", "n_words", "n_hit", "n_items", "items", "spans", *keep)


def _pass(docs: DataFrame, index: bytes, keep: list[str]) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex
    extra = [c for c in keep if c != "doc_id"]
    schema = StructType([*StructType.fromDDL(FOUND).fields, *docs.select(*extra).schema.fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, h = kept(("winnow", name), lambda: (pickle.loads(shared.value), WordHashes()))
        out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
                ws = h.of(text.translate(ALNUM).split())
                mask, found = index.hits(ws)
                ids = sorted({index.ids[i] for i in found if index.ids[i] is not None})
                first, last = runs(mask) if found else ((), ())
                rows.append((doc_id, len(ws), int(mask.sum()), len(ids), ids, [{"first": int(x), "last": int(y)} for x, y in zip(first, last)]))
            for r in rows_out(out, rows, 1 << 20):
                yield pa.RecordBatch.from_arrays([*r.columns, *[b.column(c) for c in extra]], names=[*r.schema.names, *extra])

    return docs.mapInArrow(score, schema)


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), contaminated().alias("contaminated"))


#: The same rows by plain matching of windows.
OP8_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') as win
       from b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) t(i) where len(ws) > 0),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as win from w, ns, unnest(range(1, len(ws) - n + 2)) t(i) where len(ws) >= n),
hit as (select d.doc_id, d.i, d.n, bw.item_id from dw d join bw on d.win = bw.win and d.n = bw.n),
cov as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, i, n from hit) h, unnest(range(i, i + n)) t(p) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from hit) h group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) as contaminated
from w left join cov on w.doc_id = cov.doc_id left join its on w.doc_id = its.doc_id
"""

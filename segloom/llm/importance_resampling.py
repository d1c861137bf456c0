"""Target-distribution importance resampling with a head-tail vocabulary.

Texts are bags of hashed features: words and runs of two words, each in the bucket crc32(bytes) modulo `buckets`. Exact bucket
totals of the corpus and of the target give every bucket a gain, a document the floored mean of its features' gains as weight,
and weight plus Gumbel noise of its id a score; the highest scores are drawn, which samples without replacement.

Hashing meets each word of the corpus, so frequent things are hashed once: the head holds the CRC of frequent words and the
CRC state behind "word ", and the buckets of frequent pairs; all tasks get it by broadcast. A pair of head words is looked up
by number. Any other feature is hashed directly, from the state of its first word on. Both feed the same exact totals, so what
is in the head decides about time alone. It is found in one pass over all texts: words and pairs that make up FREQUENT of
some block of BLOCK words are candidates, so none that makes up FREQUENT of all words is missed; their counts in those blocks
are summed, and the most frequent are kept, at most HEAD_WORDS and HEAD_PAIRS. Words of over LONGEST bytes are always hashed directly, which
bounds the head at about 2 MB in a task and 10 MB on the driver, whatever the corpus.

Scale: texts aren't shuffled; a document's buckets are written once (2 bytes a feature) and read for the totals and for the
weights. Ranks come from one range sort of (score, doc_id) with offsets of its partitions. Long texts are read in pieces.

Null and empty texts have no features, weight 0 and no rank. Null doc_ids are hashed as empty text and come last among equal
scores. Repeated rows are documents of their own, with equal scores and different ranks. Empty tables give no rows; an empty
target has totals of 0. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, discard, map_arrow, shared_folder, table, text_bytes, written

HEAD_WORDS, HEAD_PAIRS, LONGEST = 20_000, 1 << 16, 64
BLOCK, FREQUENT = 1 << 19, 2.0**-16
#: Bytes of text that are split at a time.
PIECE = 1 << 22
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("noise", pa.int64()), ("buckets", pa.binary())])


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, those of some `size` bytes at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if len(text) - at > size else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def spaced(text: bytes) -> bytes:
    """Lower-cased, with a space for every byte of no word."""
    return text.translate(ALNUM)


def frequent(words: list[bytes]) -> Iterator[tuple[bytes, bytes | None, int]]:
    """(word, None, n) and (word, next word, n) of a block's frequent words and pairs; b"" parts texts."""
    index = dict.fromkeys(words)
    names = list(index)
    index = dict(zip(names, range(len(names))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    least, gap = max(2, FREQUENT * len(words)), index.get(b"", -1)
    n = np.bincount(ids, minlength=len(names))
    fit = np.fromiter((0 < len(x) <= LONGEST for x in names), bool, len(names)) & (n >= least)
    for i in np.flatnonzero(fit).tolist():
        yield names[i], None, int(n[i])
    a, b = ids[:-1], ids[1:]
    both = fit[a] & fit[b] & (a != gap) & (b != gap)
    keys, often = np.unique(a[both] * len(names) + b[both], return_counts=True)
    for key, m in zip(keys[often >= least].tolist(), often[often >= least].tolist()):
        yield names[key // len(names)], names[key % len(names)], m


class Head:
    """Frequent words with their CRCs and states, and frequent pairs with their buckets, as arrays."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.index, self.buckets = {w: i for i, w in enumerate(words)}, buckets
        self.crc = np.fromiter(map(crc32, words), np.int64, len(words))
        self.state = np.fromiter(map(crc32, repeat(b" "), self.crc.tolist()), np.int64, len(words))
        known = {self.index[a] * len(words) + self.index[b]: crc32(b, int(self.state[self.index[a]])) % buckets for a, b in pairs if a in self.index and b in self.index}
        self.keys = np.array(sorted(known), np.int64)
        self.pair_bucket = np.array([known[k] for k in self.keys.tolist()], np.int64)

    def hashed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, and of each word with the one behind it."""
        n, h = len(words), len(self.index)
        ids = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, n)
        tail = np.flatnonzero(ids < 0)
        crc = np.empty(n, np.int64)
        head = ids >= 0
        crc[head] = self.crc[ids[head]]
        crc[tail] = np.fromiter(map(crc32, map(words.__getitem__, tail.tolist())), np.int64, len(tail))
        pairs = np.empty(max(0, n - 1), np.int64)
        if n > 1:
            a, b = ids[:-1], ids[1:]
            key = np.where((a >= 0) & (b >= 0), a * h + b, -1)
            known = np.zeros(n - 1, bool)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                pairs[known] = self.pair_bucket[at[known]]
            rest = np.flatnonzero(~known)
            state = np.empty(len(rest), np.int64)
            first = ids[rest]
            state[first >= 0] = self.state[first[first >= 0]]
            odd = rest[first < 0]
            state[first < 0] = np.fromiter(map(crc32, repeat(b" "), crc[odd].tolist()), np.int64, len(odd))
            pairs[rest] = np.fromiter(map(crc32, map(words.__getitem__, (rest + 1).tolist()), state.tolist()), np.int64, len(rest)) % self.buckets
        return crc % self.buckets, pairs

    def of_texts(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(number of words, buckets of all features) of each text; short texts are hashed together."""
        out: list[tuple[int, np.ndarray]] = []
        held: list[list[bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            flat = [w for words in held for w in words]
            one, two = self.hashed(flat)
            at = 0
            for words in held:
                n = len(words)
                out.append((n, np.concatenate([one[at : at + n], two[at : at + max(0, n - 1)]])))
                at += n
            held, size = [], 0

        for text in texts:
            text = spaced(text)
            if len(text) <= PIECE:
                held.append(text.split())
                size += len(text)
                if size > PIECE:
                    flush()
                continue
            flush()
            n, parts, before = 0, [], []
            for words in pieces(text):
                one, two = self.hashed(before + words)
                parts += [one[len(before) :], two]
                n, before = n + len(words), (before + words)[-1:]
            out.append((n, np.concatenate(parts)))
        flush()
        return out


def head_of(texts: DataFrame, place: str, buckets: int = 10_000) -> Head:
    """The head of a column `text`."""
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def emit() -> Iterator[pa.RecordBatch]:
            rows = list(frequent(held))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for b in batches:
            for text in text_bytes(b.column("text")):
                for words in pieces(spaced(text)):
                    held += words
                    if len(held) >= BLOCK:
                        yield from emit()
                        held = held[-1:]  # a text's next piece goes on behind it
                held.append(b"")
        yield from emit()

    counts = map_arrow(texts.select("text"), find, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("level", F.floor(F.log2("n") * 16)), "frequent", place)

    def top(part: DataFrame, most: int) -> list:
        """The most frequent rows, whole levels of counts, at most `most`: the driver sees one row a level and then those."""
        least, held = None, 0
        for r in part.groupBy("level").count().orderBy(F.desc("level")).collect():
            held += r["count"]
            if held > most:
                break
            least = r.level
        return [] if least is None else part.filter(F.col("level") >= least).select("a", "b").collect()

    words = [bytes(r.a) for r in top(counts.filter("b is null"), HEAD_WORDS)]
    return Head(words, [(bytes(r.a), bytes(r.b)) for r in top(counts.filter("b is not null"), HEAD_PAIRS)], buckets)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def features(docs: DataFrame, head, seed: int, buckets: int) -> DataFrame:
    """doc_id, n_words, noise and the buckets of all features. head: a broadcast Head."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = head.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = part.column("doc_id").to_pylist()
                rows = [(i, n, noise(i, seed), x.astype(kind).tobytes()) for i, (n, x) in zip(ids, own.of_texts(list(text_bytes(part.column("text")))))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FEATURES)], schema=FEATURES)

    return map_arrow(docs, run, "doc_id long, n_words long, noise long, buckets binary")


def bucket_totals(rows: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket holds; a task sends at most one row a bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = [0] * buckets
    for r in map_arrow(rows.select("buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(docs: list[int], target: list[int]) -> np.ndarray:
    """Per bucket how much likelier it is in the target, in thousandths of the logarithm."""
    k, s_all, t_all = len(docs), float(sum(docs)), float(sum(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(docs, target)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    out = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, x in enumerate(b.column("buckets")):
                own = np.frombuffer(x.as_buffer(), kind)
                n[i], total[i] = len(own), gain[own].sum()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n), pa.array(weight), pa.array(weight + b.column("noise").to_numpy())], schema=out)

    return map_arrow(rows, run, ", ".join(f"{f.name} long" for f in out))


def ranked(rows: DataFrame, least_words: int, percent: int, place: str) -> DataFrame:
    """Adds rank, 1, 2, 3 ... by falling score, to the first `percent` of a hundred of the documents with least_words words."""
    spark = rows.sparkSession
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    sorted_ = rows.filter(F.col("n_words") >= least_words).repartitionByRange(*by).sortWithinPartitions(*by)
    at = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked", place)  # partition * 2**33 + place
    part = F.shiftright("_at", 33)
    offsets, n = [], 0
    for r in at.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        offsets.append((r.p, n))
        n += r["count"]
    most = percent * n // 100
    base = F.broadcast(spark.createDataFrame(offsets, "_p long, _n long"))
    rank = F.col("_n") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = at.join(base, part == F.col("_p")).withColumn("rank", F.when(rank <= most, rank))
    others = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rows.columns, "rank").unionByName(others)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn). docs: doc_id, text; target: text."""
    spark, place = docs.sparkSession, shared_folder(docs.sparkSession, "resampling")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs, target = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), target.select(F.lit(0).cast("long").alias("doc_id"), text)
    head = spark.sparkContext.broadcast(head_of(docs.unionByName(target), place, buckets))
    own = written(features(docs, head, seed, buckets), "rows", f"{place}/features")
    gain = gains(bucket_totals(own, buckets), bucket_totals(features(target, head, seed, buckets), buckets))
    rows = written(weighed(own, gain), "weights", place)
    discard(spark, f"{place}/features")  # the largest of what was written, read no more
    return ranked(rows, least_words, percent, place).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

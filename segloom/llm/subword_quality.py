"""Quality classifier: supervised subword embeddings.

Words (split at white space, case kept) and their character n-grams are hashed into buckets with learned vectors. A document is
the average of the vectors of all its features, in proportion to how often they occur; a softmax layer over that average gives
the classes. Words that repeat the one before, and words that occurred before, count as two more features. Vectors and layer
are trained together by stochastic gradient descent in numpy, in one Spark task, on a bounded sample of labelled rows
(`sample_rows`, those with the least hash). Scoring is one pass over all documents without a shuffle: since everything is
linear up to the softmax, each word adds a fixed number.

Long words and texts are counted in pieces, so that a text needs little memory beside its own words. Null and empty texts have no
features and get the score of the bias. Labels that are null or name no document are ignored; of
several for a document the largest counts. Without usable labels every score is 0.5. Repeated rows and null doc_ids get rows of
their own (a null doc_id is not held out). Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import rows_out, table, text_bytes

BUCKETS, DIM, GRAMS = 1 << 15, 10, (3, 4)
SAMPLE_ROWS, EPOCHS, BATCH, RATE = 4000, 12, 32, 0.5
#: Fewer sample rows than this are gone through more often, as if they were so many.
LEAST_ROWS = 3000
_AGAIN, _SEEN = BUCKETS, BUCKETS + 1


#: Words of more bytes than this have their n-grams hashed in pieces and aren't kept.
LONG_WORD = 64
_PIECE = 1 << 16
#: Texts are counted so many words at a time.
_WORDS = 50_000


def features(word: bytes) -> list[int]:
    """The word's own bucket and those of its n-grams."""
    marked = b"<" + word + b">"
    return [zlib.crc32(marked) % BUCKETS, *(zlib.crc32(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1))]


def feature_pieces(word: bytes) -> Iterator[np.ndarray]:
    """The same buckets as arrays of bounded length, for words of any length."""
    marked = b"<" + word + b">"
    yield np.array([zlib.crc32(marked) % BUCKETS])
    # The states of a CRC after one byte from state 0; those of longer strings follow from their linearity.
    step = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
    for at in range(0, len(marked), _PIECE):
        codes = np.frombuffer(marked, np.uint8, min(len(marked) - at, _PIECE + max(GRAMS) - 1), at)
        for n in GRAMS:
            many = min(len(codes) - n + 1, _PIECE)
            if many > 0:
                crc = np.full(many, 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    crc = step[(crc ^ codes[k : k + many]) & 0xFF] ^ (crc >> 8)
                yield ((crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64)


class Counter:
    """Texts to (buckets, shares of all features)."""

    def __init__(self):
        self.cache: dict[bytes, np.ndarray] = {}

    def buckets(self, word: bytes) -> np.ndarray:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            got = self.cache[word] = np.array(features(word), np.uint16)
        return got

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        sums = np.zeros(BUCKETS + 2, np.int64)
        for a in range(0, len(words), _WORDS):
            short = [self.buckets(w) for w in words[a : a + _WORDS] if len(w) <= LONG_WORD]
            if short:
                sums += np.bincount(np.concatenate(short), minlength=BUCKETS + 2)
        for w in words:
            if len(w) > LONG_WORD:
                for piece in feature_pieces(w):
                    sums += np.bincount(piece, minlength=BUCKETS + 2)
        counts = sums.astype(np.float32)
        # The two signs of repetition count against words, not n-grams, so that they weigh as much as a word's share.
        counts /= counts.sum()
        counts[_AGAIN] = sum(map(eq, words, words[1:])) / len(words)
        counts[_SEEN] = (len(words) - len(set(words))) / len(words)
        at = np.flatnonzero(counts)
        return at, counts[at]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Minibatch SGD on vectors and softmax layer; returns each bucket's part of the logit of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS + 2, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    if len(labels):
        p = (labels.mean() * len(labels) + 1) / (len(labels) + 2)
        bias[1] = math.log(p / (1 - p))
    steps = max(1, epochs * max(len(rows), LEAST_ROWS) // BATCH) if len(rows) else 0
    order, dense = np.zeros(0, np.int64), np.zeros((BATCH, BUCKETS + 2), np.float32)
    for step in range(steps):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:BATCH], order[BATCH:]
        at = np.concatenate([rows[i][0] for i in pick])
        doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
        dense[doc, at] = np.concatenate([rows[i][1] for i in pick])
        shares = dense[: len(pick)]
        mean = shares @ vectors
        logits = mean @ layer + bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(pick)), labels[pick]] -= 1
        rate = RATE * (1 - step / steps) + 0.01
        back = (prob @ layer.T).astype(np.float32)
        layer -= (rate * (mean.T @ prob) / len(pick)).astype(np.float32)
        bias -= (rate * prob.mean(axis=0)).astype(np.float32)
        back *= np.float32(rate * 40 / len(pick))
        vectors -= shares.T @ back
        dense[doc, at] = 0
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


class WordScores(dict):
    """word -> complex(sum of its features' parts, their number)."""

    def __init__(self, parts: np.ndarray, limit: int = 400_000):
        super().__init__()
        self.table, self.parts, self.limit = parts.astype(np.float64), parts.tolist(), limit

    def __missing__(self, word: bytes) -> complex:
        if len(word) > LONG_WORD:
            return sum((complex(self.table[p].sum(), len(p)) for p in feature_pieces(word)), 0j)
        f = features(word)
        value = complex(sum(map(self.parts.__getitem__, f)), len(f))
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most sample_rows labelled rows of docs (doc_id, text); labels: doc_id, label (0 or 1)."""
    ids = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows pairs of numbers: a bounded broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select(F.xxhash64("doc_id").alias("place"), "doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for i, (at, share) in enumerate(map(counter, text_bytes(b.column("text")))):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [row.column("place"), row.column("doc_id"), row.column("label"), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())],
                    names=["place", "doc_id", "label", "at", "share"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for b in batches:
            rows += [(np.frombuffer(at, np.uint16), np.frombuffer(share, np.float32)) for at, share in zip(b.column("at").to_pylist(), b.column("share").to_pylist())]
            ys += b.column("label").to_pylist()
        if not rows:
            return
        parts, bias = train(rows, np.array(ys, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([parts.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["parts", "bias"])

    # The training task gets counts, at most six bytes a bucket and row whatever the length of the texts.
    counted = sample.mapInArrow(count, StructType([*sample.select("place", "doc_id", "label").schema.fields, StructField("at", BinaryType()), StructField("share", BinaryType())]))
    got = counted.repartition(1).sortWithinPartitions("place", "doc_id").select("label", "at", "share").mapInArrow(learn, "parts binary, bias double").collect()
    if not got:
        return np.zeros(BUCKETS + 2, np.float32), 0.0
    return np.frombuffer(got[0].parts, np.float32), got[0].bias


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """docs' columns `keep` and score, one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 2 numbers
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = StructType([*rows.select(*keep).schema.fields, StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bias = shared.value
        words = WordScores(parts)
        again, seen = float(parts[_AGAIN]), float(parts[_SEEN])
        for b in batches:
            out = []
            for text in text_bytes(b.column("text")):
                ws = text.split()
                logit = bias
                if ws:
                    total = sum(map(words.__getitem__, ws))
                    logit += total.real / total.imag
                    logit += (again * sum(map(eq, ws, ws[1:])) + seen * (len(ws) - len(set(ws)))) / len(ws)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Scores with a model of the rows whose crc32(doc_id as text) mod 3 isn't 1."""
    ids = labels.select("doc_id", F.col("quality").alias("label")).filter(remainder(F.col("doc_id"), 3) != 1)
    return scored(docs, fit(docs, ids), keep)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

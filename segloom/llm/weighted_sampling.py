"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words (A-Z lower-cased, split at ASCII white space), each weighing its count times its
length in bytes, so that long, telling words weigh more than short ones. For each of SAMPLES samples and each term, two
gamma(2, 1) variables and a uniform one, drawn from the term's hash, pick a level of the weight; the term with the least value
gives the sample (term, level). Minima run over blocks of terms, so a text's vocabulary may be of any size. Two texts agree in a sample with the probability of their generalised Jaccard similarity,
sum of least weights over sum of largest. Each sample keeps 16 bits of its hash.

Equal texts have equal fingerprints. Texts without words (null, empty, white space) have one term of their own: they are alike
to each other and nothing else. Pairs of neighbours: documents in descending doc_id, null last, ties by text; the last is
followed by the first, a single document by itself. Repeated rows are rows of their own. Empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, in_parts, kept, mix, rows_out, shuffle_partitions, table

SAMPLES = 64
#: Terms of a text are looked at in blocks of so many, so that memory doesn't grow with a text's vocabulary.
BLOCK = 512
_LEAST = -(1 << 63)
_STEPS = (np.arange(1, 5 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)


def uniforms(hashes: np.ndarray) -> np.ndarray:
    """5 x SAMPLES numbers between 0 and 1 a hash, of 23 bits: both halves of the hash and the number's place go through a 32-bit mixer."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    x = low[:, None] + _STEPS
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= high[:, None]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    x >>= np.uint32(9)
    u = x.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2**-23)
    return u.reshape(-1, 5, SAMPLES)


class Draws:
    """What is drawn for each term, SAMPLES numbers each: r, its inverse, the shift u, and log(c) - r + r * u; starts over when `limit` terms are held."""

    def __init__(self, limit: int = 60_000):
        self.limit, self.rows = max(limit, BLOCK), {}
        self.tables = [np.empty((self.limit, SAMPLES), np.float32) for _ in range(4)]
        self.hashes, self.block = np.empty(self.limit, np.uint64), [np.empty((BLOCK, SAMPLES), np.float32) for _ in range(4)]

    def of(self, terms: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of at most BLOCK different terms the hashes, and the four kinds of numbers, to be used before the next call."""
        rows = np.fromiter(map(self.rows.get, terms, repeat(-1)), np.int64, len(terms))
        new = np.flatnonzero(rows < 0)
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = np.arange(len(terms))
        if len(new):
            names = [terms[i] for i in new.tolist()]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            first = len(self.rows)
            at = slice(first, first + len(names))
            u = uniforms(h)
            r = -np.log(u[:, 0] * u[:, 1])  # gamma(2, 1): a sum of two exponential variables
            self.tables[0][at], self.tables[1][at], self.tables[2][at] = r, 1 / r, u[:, 4]
            self.tables[3][at] = np.log(-np.log(u[:, 2] * u[:, 3])) - r + r * u[:, 4]
            self.hashes[at] = h
            rows[new] = np.arange(at.start, at.stop)
            self.rows.update(zip(names, range(at.start, at.stop)))
        return self.hashes[rows], [np.take(t, rows, axis=0, out=b[: len(rows)], mode="clip") for t, b in zip(self.tables, self.block)]


def weights(text: str) -> dict[bytes, int]:
    """Term -> weight, above 0."""
    found = Counter(text.encode("utf-8", "surrogatepass").translate(LOWER).split())
    return {w: n * len(w) for w, n in found.items()} or {b"": 1}


def sample(terms: dict[bytes, int], draws: Draws) -> np.ndarray:
    """The text's SAMPLES values of 16 bits."""
    names, log_w = list(terms), np.log(np.fromiter(terms.values(), np.float32, len(terms)))
    least, winner, chosen = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    for at in range(0, len(names), BLOCK):
        hashes, (r, level, u, value) = draws.of(names[at : at + BLOCK])
        level *= log_w[at : at + BLOCK, None]
        level += u
        np.floor(level, out=level)
        r *= level
        value -= r  # log of c / (y * exp(r)), y the level's weight
        low = value.min(axis=0)
        # Ties, if ever, go to the smaller hash and not to the order of terms.
        i, k = np.divmod(np.flatnonzero(value == low), SAMPLES)
        h = hashes[i]
        if len(k) > SAMPLES:
            order = np.lexsort((h, k))
            order = order[np.concatenate([[True], np.diff(k[order]) > 0])]
            i, k, h = i[order], k[order], h[order]
        better = (low[k] < least[k]) | ((low[k] == least[k]) & (h < winner[k]))
        k, i, h = k[better], i[better], h[better]
        least[k], winner[k], chosen[k] = low[k], h, level[i, k]
    return (mix(winner + mix(chosen.astype(np.int64).astype(np.uint64) + np.uint64(1))) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text, or all."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents in ranges of descending doc_id, one range a partition, each with a guest: the document that follows its last.

    Only doc_ids are looked at to find the ranges and their first documents, one number a partition on the driver.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("place")
    cuts = sorted({int(x) for x in ids.approxQuantile("place", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    part = in_parts(F.col("place"), cuts)
    first = sorted((r.part, r.first) for r in ids.groupBy(part.alias("part")).agg(F.max("place").alias("first")).collect())
    main = rows.withColumn("part", part).withColumn("guest", F.lit(False))
    if not first:
        return main.limit(0)
    to = {x: first[(i + 1) % len(first)][0] for i, (_, x) in enumerate(first)}  # the range above ends where this one begins
    lead = rows.filter(F.col("place").isin(list(to))).withColumn("part", F.element_at(F.create_map(*(F.lit(v) for kv in to.items() for v in kv)), F.col("place"))).withColumn("guest", F.lit(True))
    every = main.unionByName(lead).repartitionById(len(cuts) + 1, F.col("part").cast("int"))
    return every.sortWithinPartitions(F.col("guest"), F.col("place").desc(), F.col("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one shuffle of the texts."""
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        last, done = None, False
        for b in batches:
            for doc_id, text, guest in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("guest").to_pylist()):
                if done:
                    continue
                text = text.as_py()
                if last is not None:
                    yield *last, text
                last, done = (doc_id, text), guest

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = kept("draws", Draws)

        def rows() -> Iterator[tuple]:
            held = None  # the following text's fingerprint is the next row's own
            for doc_id, text, following in pairs(batches):
                new = edited(text, following)
                a = held if held is not None else sample(weights(text), draws)
                b, held = sample(weights(new), draws), sample(weights(following), draws)
                yield doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, held)

        yield from rows_out(out, rows())

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs).select("doc_id", "text", "guest").mapInArrow(fingerprint, schema)


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

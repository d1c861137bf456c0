"""Centroid clustering over subvector dictionaries: exact integer k-means whose distances are computed per distinct subvector.

Vectors become integers, floor(scale * x). Their dimensions are cut into blocks; each chunk of vectors holds, per block, the
dictionary of its distinct subvectors and one code a vector, which is lossless and written once. A round computes the exact
squared distances of the dictionary's subvectors to the centroids' blocks, adds them up by code, and gives each vector the
nearest centroid (ties: the smaller number). New centroids come from the dictionaries too: how often a cluster has a code,
times the subvector.

Scale: no vector is shuffled and none is compared with another. A task holds one chunk at a time (CHUNK vectors), whatever
number of them are copies, and sends one row per centroid and dimension; centroids (k rows) are all that the driver holds.

Kept are vectors of exactly `dims` components without a null, NaN or infinity; others give no row. Null vec_ids are kept,
come last in the choice of first centroids and have a row with a null id. Repeated rows are vectors of their own; equal hashes
are ordered by the vector. Fewer vectors than k give as many centroids, none gives no rows. Components beyond 2**61 count as
that, distances and sums beyond a long as its largest value. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_folder, table, written

CHUNK = 16_384
MOST = 1 << 61  # of a component
#: Below it, and with at most 64 dimensions, squares and their sums are exact in a long.
PLAIN = 1 << 27
TOP = (1 << 63) - 1
LOW_BITS = 28

CHUNKS = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("code_kind", pa.string()), ("dictionaries", pa.list_(pa.binary())), ("codes", pa.list_(pa.binary()))])
CHUNK_COLUMNS = "ids array<long>, kind string, code_kind string, dictionaries array<binary>, codes array<binary>"


def kept_vectors(b: pa.RecordBatch, dims: int, scale: int) -> tuple[list[int | None], np.ndarray]:
    """Ids and integer components of the vectors that count."""
    column = b.column("v")
    column = column.cast(pa.list_(pa.float64()))
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls come as NaN
    fine = np.isfinite(x).all(axis=1)
    whole = np.floor(np.minimum(np.maximum(x[fine], -MOST / scale), MOST / scale) * scale).astype(np.int64)
    return b.column("vec_id").take(pa.array(rows[fine])).to_pylist(), whole


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest signed type that holds them."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def encoded(ids: list, x: np.ndarray, block: int) -> tuple:
    """One chunk: per block the distinct subvectors, and each vector's code."""
    x = np.ascontiguousarray(narrow(x))
    code_kind = np.uint16 if len(x) <= 1 << 16 else np.uint32
    dictionaries, codes = [], []
    for at in range(0, x.shape[1], block):
        part = np.ascontiguousarray(x[:, at : at + block])
        whole = part.view(np.dtype((np.void, part.dtype.itemsize * part.shape[1]))).ravel()
        _, first, code = np.unique(whole, return_index=True, return_inverse=True)
        dictionaries.append(part[first].tobytes())
        codes.append(code.astype(code_kind).tobytes())
    return ids, x.dtype.name, np.dtype(code_kind).name, dictionaries, codes


def encode(vectors: DataFrame, dims: int = 64, scale: int = 1024, block: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Chunks of dictionary-encoded vectors, one row a chunk. vectors: vec_id, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def out(rows: int) -> pa.RecordBatch:
            nonlocal ids, parts, n
            x = np.concatenate(parts)
            one = encoded(ids[:rows], x[:rows], block)
            ids, parts, n = ids[rows:], [x[rows:]], n - min(rows, n)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, CHUNKS)], schema=CHUNKS)

        for b in batches:
            new, x = kept_vectors(b, dims, scale)
            ids, n = ids + new, n + len(new)
            parts.append(x)
            while n >= chunk:
                yield out(chunk)
        if n:
            yield out(n)

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")), run, CHUNK_COLUMNS)


class Chunk:
    """A chunk read back: dictionaries (subvectors as long) and codes by block."""

    def __init__(self, row: dict, dims: int, block: int):
        self.ids = row["ids"]
        self.blocks = []
        for at, (d, c) in zip(range(0, dims, block), zip(row["dictionaries"], row["codes"])):
            words = np.frombuffer(d, np.dtype(row["kind"])).reshape(-1, min(block, dims - at)).astype(np.int64)
            self.blocks.append((at, words, np.frombuffer(c, np.dtype(row["code_kind"]))))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid: partial distances of the dictionaries, summed by code."""
        wide = max(max(np.abs(w).max(initial=0) for _, w, _ in self.blocks), np.abs(centroids).max(initial=0)) >= PLAIN or centroids.shape[1] > 64
        total = np.zeros((len(self.ids), len(centroids)), np.int64)
        about = np.zeros_like(total, np.float64)
        for at, words, codes in self.blocks:
            differ = words[:, None, :] - centroids[None, :, at : at + words.shape[1]]
            total += (differ * differ).sum(axis=2)[codes]
            if wide:
                about += (differ.astype(np.float64) ** 2).sum(axis=2)[codes]
        if wide:  # a sum that fits is right whatever wrapped around on the way
            total[about >= 2.0**62] = TOP
        return total

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(centroids)
        cluster = d.argmin(axis=1)
        return cluster, d[np.arange(len(d)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per cluster its number of vectors, and the sums of their components in two parts: (k, dims) of the high and of the low bits."""
        parts = []
        for _, words, codes in self.blocks:
            often = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
            parts.append((often @ (words >> LOW_BITS), often @ (words & ((1 << LOW_BITS) - 1))))
        return np.bincount(cluster, minlength=k), np.concatenate([h for h, _ in parts], axis=1), np.concatenate([low for _, low in parts], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[Chunk]:
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk(b.slice(i, 1).to_pylist()[0], dims, block)


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of `seed:vec_id`."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size(v) == dims) & ~bad)
    rows = ids.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not rows:
        return np.zeros((0, dims), np.int64)
    x = np.array([r.v for r in rows], np.float64)
    return np.floor(np.clip(x, -MOST / scale, MOST / scale) * scale).astype(np.int64)


def new_centroids(chunks: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """One round: the floor of every cluster's mean; an empty cluster keeps its centroid."""
    k, dims = centroids.shape
    out = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for c in _chunks(batches, dims, block):
            a, b, d = c.sums(c.nearest(centroids)[0], k)
            n, high, low = n + a, high + b, low + d
        at = np.flatnonzero(np.repeat(n > 0, dims))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((at // dims, at % dims, np.repeat(n, dims)[at], high.ravel()[at], low.ravel()[at]), out)], schema=out)

    sums = map_arrow(chunks, run, "cluster int, dim int, n long, high long, low long")
    after = centroids.copy()
    for r in sums.groupBy("cluster", "dim").agg(*(F.sum(x).alias(x) for x in ("n", "high", "low"))).collect():  # k times dims rows
        after[r.cluster, r.dim] = ((r.high << LOW_BITS) + r.low) // r.n
    return after


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, block: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. A round that moves no centroid ends the search: no later one would."""
    spark = vectors.sparkSession
    chunks = written(encode(vectors, dims, scale, block, chunk), "chunks", under=(place := shared_folder(spark, "centroids")))
    centroids = first_centroids(vectors, k, seed, dims, scale)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, new_centroids(chunks, centroids, block)
        if (before == centroids).all():
            break
    out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, dims, block):
            cluster, distance = c.nearest(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], schema=out)

    assigned = written(map_arrow(chunks, assign, "vec_id long, cluster int, distance long"), "assigned", place)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [(c, min(s, TOP), min(sum(sums.values()), TOP), names[c]) for c, s in sorted(sums.items())]
    each = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_subvector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as int) as c, v from (select * from kept order by sha256('{seed}:' || vec_id) limit {k}) q)",
    ]
    near = "select i, arg_min(c, d * 100 + c) as c, min(d) as d from (select k.rowid_ as i, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from numbered k, {c} c) q group by i"
    steps.append("numbered as materialized (select row_number() over () as rowid_, vec_id, v from kept)")
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({near.format(c=f'c{r}')})")
        steps.append(
            f"c{r + 1} as materialized (select o.c, coalesce(n.v, o.v) as v from c{r} o left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as v from "
            f"(select a.c, u.j, sum(k.v[u.j])::hugeint as s, count(*)::hugeint as n from a{r} a join numbered k on k.rowid_ = a.i, unnest(range(1, {dims + 1})) u(j) group by a.c, u.j) x group by c) n on n.c = o.c)"
        )
    steps.append(f"final_ as materialized ({near.format(c=f'c{rounds}')})")
    return "with " + ",\n".join(steps) + f"""
select k.vec_id, f.c as cluster, cast(f.d as bigint) as distance, cast(sum(f.d) over (partition by f.c) as bigint) as cluster_inertia, cast(sum(f.d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256 from final_ f join numbered k on k.rowid_ = f.i join c{rounds} c on c.c = f.c"""


OP11_SQL = _oracle()

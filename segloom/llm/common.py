"""Helpers that the operators of this subpackage share: shared folders, word splitting and 64-bit hashing in numpy."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`; bytes.split() uses exactly these.
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
ALNUM = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read; a temporary one only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="segloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """Writes df to a shared folder, or to one in the folder `under`, and reads it back: lineage ends there and lost executors cost nothing behind it."""
    path = f"{under}/{label}-{uuid.uuid4().hex}" if under else shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """docs with `names` as they are and all other columns in one struct, `_others`, so that no name of theirs can clash with an operator's."""
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*names, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_others")] if rest else []))


def unpacked(rows: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The columns that `packed` had with these names, in the given order; columns that an operator added are left out."""
    return rows.select(*(F.col(c) if c in names else F.col("_others")[c].alias(c) for c in columns))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function that takes an iterator of batches."""
    return df.mapInArrow(fn, schema)


_kept: dict = {}


def kept(name: object, make):
    """What `make` gives, kept in this Python worker for its next tasks; whatever was kept under another name is let go, so that operators don't pile up their tables in one worker."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets everything at `limit` words, so its memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, in linear time: prefix and suffix minima of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(blocks, axis=1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def in_parts(col: Column, bounds: list[int], low: int = 0) -> Column:
    """How many of the sorted bounds are at most col, as a balanced CASE."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(col >= bounds[mid], in_parts(col, bounds[mid + 1 :], low + mid + 1)).otherwise(in_parts(col, bounds[:mid], low))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or of a plain local path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def rows_out(schema: pa.Schema, rows: Iterable[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Batches of tuples."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch(schema, held)
            held = []
    if held:
        yield batch(schema, held)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

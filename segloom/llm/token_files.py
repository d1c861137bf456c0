"""Token-ID output: Arrow files whose batches hold fixed-size lists, so that any sequence is found by arithmetic and read without a copy.

Each shard file has two columns, `ids` (fixed-size list of uint16, or of uint32 for vocabularies above 65,536) and `mask`
(fixed-size list of uint8 that holds one bit a place, the first in the lowest bit; 0 pads the last sequence). Both are read as
views of the mapped file. A shard's documents are one stream of ids, cut into rows of `seq_len`, a multiple of 8; every batch
but the last has the same number of rows. The documents' places are in an index table.

Null texts count as empty; an empty text gives the end id alone. Null doc_ids sort first. Repeated rows are kept, each with
ids of its own; ties in doc_id follow the text's hash. An empty table gives no shard and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, kept, rows_out, shared_folder, table

#: Unicode's white space, as the pre-tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿА-яЁё"
#: Cuts only where the byte-level pre-tokenizer also cuts: a piece is a union of whole pre-tokens, so equal pieces have equal ids.
#: Letters before white space, the end or a mark that isn't an apostrophe are one pre-token.
WORD = f" ?[{LETTERS}]++(?![^{SPACE}.,;:!?)])"
PIECES = re.compile(f"{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
IS_WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
BATCH_ROWS = 1024
#: So many texts are encoded at a time.
TEXTS = 256


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder(dict):
    """Piece of text -> its ids as bytes; the tokenizer sees new pieces once, many at a time. Forgets everything when pieces of `most` bytes, with what holding them costs, are there.

    Pieces of letters alone are one pre-token, so they go to the tokenizer's model in its byte alphabet and without its
    pre-tokenizer, all in one call; where a piece's ids end follows from the lengths of their tokens. `word` is None for
    tokenizers that are not byte-level ones as this takes for granted: they get every piece as it is.
    """

    def __init__(self, tokenizer_path: str, most: int = 96_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.most, self.held = Tokenizer.from_file(tokenizer_path), most, 0
        #: Texts that spell a special token are left to the tokenizer as a whole: it cuts them at that token first.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        kind = json.loads(self.tokenizer.to_str())
        pre, self.word = kind["pre_tokenizer"] or {}, None
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), kind["normalizer"], kind["model"].get("type")) == ("ByteLevel", False, True, None, "BPE"):
            self.alphabet = byte_alphabet()
            self.word = Tokenizer.from_file(tokenizer_path)
            self.word.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.alphabet[10])  # no piece of letters holds a line feed
            self.size = np.zeros(self.word.get_vocab_size(), np.int64)
            for token, i in self.word.get_vocab().items():
                self.size[i] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.held > self.most:
            self.clear()
            self.held = 0
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        pieces = [() if i in whole else PIECES.findall(t) for i, t in enumerate(texts)]
        flat = list(chain.from_iterable(pieces))
        ids = list(map(self.get, flat))
        new = [i for i, x in enumerate(ids) if x is None]
        self.learn(list({flat[i] for i in new}))
        for i in new:
            ids[i] = self[flat[i]]
        ends = list(accumulate(map(len, pieces)))
        return [self.one(texts[i]) if i in whole else b"".join(ids[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends))]

    def learn(self, new: list[str]) -> None:
        plain = list(map(IS_WORD, new)) if self.word else [None] * len(new)
        words, others = [p for p, yes in zip(new, plain) if yes], [p for p, yes in zip(new, plain) if not yes]
        if words:
            joined = "\n".join(words).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.word.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            lengths = np.fromiter(map(len, joined.split(self.alphabet[10])), np.int64, len(words))
            ends = (np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(lengths)) + 1) * self.dtype.itemsize
            raw, ends = ids.tobytes(), ends.tolist()
            self.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            self.held += len(joined) + len(raw)
        if others:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            raw = np.array(list(chain.from_iterable(encoded)), self.dtype).tobytes()
            ends = [n * self.dtype.itemsize for n in accumulate(map(len, encoded))]
            self.update(zip(others, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            self.held += sum(map(len, others)) + len(raw)
        self.held += 190 * len(new)

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def encoder(path: str) -> PieceEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return kept(("pieces", path), lambda: PieceEncoder(path))


class ShardWriter:
    """Streams ids into one file under a temporary name; close() renames it, so a task that runs again leaves one whole file."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        if seq_len % 8:
            raise ValueError("seq_len is no multiple of 8")
        self.tmp, self.seq_len, self.dtype = f"{self.path}.{uuid.uuid4().hex}.tmp", seq_len, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.uint8(), seq_len // 8))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n = bytearray(), 0

    def append(self, ids: bytes) -> None:
        self.held += ids
        size = self.seq_len * BATCH_ROWS * self.dtype.itemsize
        while len(self.held) >= size:
            self._write(np.frombuffer(bytes(self.held[:size]), self.dtype))
            del self.held[:size]

    def _write(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.seq_len
        mask = np.ones(len(ids) + pad, bool)
        mask[len(ids) :] = False
        ids = np.concatenate([ids, np.zeros(pad, self.dtype)]) if pad else ids
        bits = np.packbits(mask, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.seq_len), (bits, self.seq_len // 8))]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n += len(ids) - pad

    def close(self) -> None:
        if self.held:
            self._write(np.frombuffer(bytes(self.held), self.dtype))
        self.out.close()
        self.sink.close()
        self.fs.move(self.tmp, self.path)


class TokenFile:
    """Reads a shard: row i, or any run of the stream, through the memory map where the store has one."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask bits of row i, both views of the file; np.unpackbits(mask, bitorder="little") gives a number a place."""
        b, at = self._batch(i // BATCH_ROWS), i % BATCH_ROWS
        views = []
        for name in ("ids", "mask"):
            column = b.column(name)
            n = column.type.list_size
            views.append(column.flatten().to_numpy()[at * n : (at + 1) * n])
        return views[0], views[1]

    def stream(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the shard's stream; a view unless the run crosses batches."""
        per, parts = BATCH_ROWS * self.seq_len, []
        while n > 0:
            k, at = divmod(start, per)
            part = self._batch(k).column("ids").flatten().to_numpy()[at : at + n]
            if not len(part):
                raise EOFError("the run ends behind the shard")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, seq_len: int = 2048, order: list[str] | None = None) -> DataFrame:
    """Writes the texts' ids to `folder`/shard-*.arrow, by the columns `order` or else in ascending doc_id order, and returns the index that was written beside them.

    Index: doc_id, shard (its number follows the order), path, offset in the shard's stream, n_tokens with the end id.
    One shuffle, by ranges of the columns of the order; a hash of the text decides ties of doc_id.
    """
    spark = docs.sparkSession
    index = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        path, end, out = f"{folder}/shard-{shard:06d}.arrow", np.array([end_id], enc.dtype).tobytes(), None
        at = 0
        for b in batches:
            rows = []
            for first in range(0, b.num_rows, TEXTS):
                part = b.slice(first, TEXTS)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode([t or "" for t in part.column("text").to_pylist()])):
                    out = out or ShardWriter(path, enc.dtype, seq_len)
                    out.append(ids + end)
                    n = len(ids) // enc.dtype.itemsize + 1
                    rows.append((doc_id, shard, path, at, n))
                    at += n
            yield from rows_out(index, rows, 1 << 20)
        if out:
            out.close()

    by = [F.col(f"_by{i}").asc_nulls_first() for i in range(len(order or "12"))]
    places = [F.col(f"`{c}`") for c in order] if order else [F.col("doc_id").cast("long"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(f"_by{i}") for i, c in enumerate(places)))
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = "doc_id long, shard int, path string, offset long, n_tokens long"
    ordered.select("doc_id", "text").mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def read_digests(index: DataFrame) -> DataFrame:
    """Reads every document back from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    A shard's index rows are small and go to one task, which streams the shard in order. Shard totals are one row a shard.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    placed = index.join(bases, "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = "", None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["path"] != at:
                    at, held = r["path"], TokenFile(r["path"])
                ids = held.stream(r["offset"], r["n_tokens"])
                rows.append((r["doc_id"], r["base"] + r["offset"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["shard"]))
            yield from rows_out(out, rows, 1 << 20)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def tokens_of(spark: SparkSession, docs: DataFrame, name: str = "byte_bpe_50k.json", seq_len: int = 2048, order: list[str] | None = None) -> DataFrame:
    """Encodes docs with a public vocabulary, writes the files to a shared folder and returns the digests read back."""
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    return read_digests(write_tokens(docs, folder, public_tokenizers.path(name), seq_len=seq_len, order=order))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark, table(spark, sf_dir, "documents"))

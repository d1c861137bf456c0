"""WARC archives written in deterministic shards, and read back.

Records are sorted by (page_id, SHA-256 of the payload, hash of the URL) into shards. The shards' bounds come from no sample: bytes are
counted exactly in blocks of page_ids, blocks that are too heavy are cut finer, down to one id and then by digest, so the
same rows give the same files whatever the number of executors. A shard is one task, which streams its records, each a gzip
member of its own, and goes on in a new file when `roll_bytes` compressed bytes are there. Headers are made anew from the
row: lengths, the block's and the payload's SHA-1 in base32, record ids (UUIDs of id, digest, URL and copy), one fixed date.

Of records with equal payloads of at least `least_bytes` bytes, that with the smallest page_id is a response; the others are
revisits without payload that name it, and keep the full payload's digest and, in their HTTP header, its length.

Commit: a task writes under a temporary name of its own and lists its files in a manifest, which Spark commits for the attempt
that counts. A second job gives the listed files their names and checks their sizes; it may run again. Only what the final
manifest lists is read; temporary files of lost attempts are deleted.

Scale: payloads are shuffled once, into their shards. Which record is a response is decided on digests: a group of copies is
one row after partial aggregation; digests with a hundredth of all rows or more (at most 100) are looked up by broadcast, all
others joined. Roles travel beside the records to the shard and stand before them in its order, so no join moves payloads.

Null html is an empty payload. Null page_ids sort first, count as larger than any other when the response is chosen, and are
written without that header. Null or odd URLs become `urn:page:<id>` or are percent-encoded. Repeated rows are records of their
own: the first is the response, the others refer to the same page_id. Rows equal in page_id, html and URL share a shard.
Empty tables give no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, file_system, in_parts, map_arrow, rows_out, shared_folder, table, written

#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
#: Blocks of ids that are counted at first, and shards at most: a larger corpus has larger shards.
BLOCKS, MOST_SHARDS = 1 << 14, 4096
MANIFEST = pa.schema([("shard", pa.int32()), ("tmp", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
MANIFEST_COLUMNS = "shard int, tmp string, path string, records long, first_id long, last_id long, n_bytes long, sha256 string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, name: str, date: str) -> bytes:
    """One WARC record; refers_to is None for a response, else the page_id that a revisit names."""
    digest = sha1_base32(payload)
    kind = "revisit" if refers_to else "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not refers_to:
        block += payload
    named = lambda i, c: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}:{c}').urn}>"
    uri = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{'none' if page_id is None else page_id}"
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page_id, name)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if refers_to:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {named(refers_to[0], '0')}"]
        head += [] if refers_to[0] is None else [f"X-Refers-To-Page-ID: {refers_to[0]}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member without a time."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class RollingWriter:
    """Writes members into files of about roll_bytes each, under temporary names; files() lists them for the manifest."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll, self.attempt = folder, shard, roll_bytes, uuid.uuid4().hex
        self.fs, self.base = file_system(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.sink, self.done, self.n = None, [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.sink is None:
            self.name = f"shard-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.sink = self.fs.open_output_stream(f"{self.base}/{self.name}.{self.attempt}.tmp")
            self.n, self.size, self.sum, self.first = 0, 0, hashlib.sha256(), page_id
        self.sink.write(data)
        self.sum.update(data)
        self.n, self.size, self.last = self.n + 1, self.size + len(data), page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.shard, f"{self.folder}/{self.name}.{self.attempt}.tmp", f"{self.folder}/{self.name}", self.n, self.first, self.last, self.size, self.sum.hexdigest()))
            self.sink = None


def shard_of(keys: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """The shard of (page_id, sha) and the number of shards, from exact counts of bytes in blocks of 2**shift ids. keys: page_id, sha, size.

    Blocks that are heavier than a shard are cut in 256, down to one id, and that by the digest's first 16 bits. The driver holds
    at most BLOCKS rows, and 256 for each heavier block, of which there are no more than shards (65,536 for one heavy id).
    """
    ends = keys.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.sum("size").alias("n")).first()
    shard_bytes = max(shard_bytes, (ends.n or 0) // MOST_SHARDS + 1)
    bits = F.conv(F.substring("sha", 1, 4), 16, 10).cast("long")
    cuts: list[tuple[int, int]] = []  # a shard begins at (page_id, bits)

    def cut(rows: list[tuple[int, int, int]], width: int) -> list[int]:
        """Rows (place, bits, bytes) in order: a cut before what would overflow its shard; gives the places that are too heavy alone."""
        at, heavy = 0, []
        for place, low, n in rows:
            if at and at + n > shard_bytes:
                cuts.append((place << width, low))
                at = 0
            at += n
            if n > shard_bytes:
                heavy.append(place)
        return heavy

    if ends.a is not None:
        shift = next(s for s in range(64) if (ends.b >> s) - (ends.a >> s) < BLOCKS)
        part, above = keys.filter("page_id is not null"), 64
        while True:
            groups: dict[int, list[tuple[int, int, int]]] = {}
            for r in part.groupBy(F.shiftright("page_id", shift).alias("place")).agg(F.sum("size").alias("n")).collect():
                groups.setdefault(r.place >> (above - shift), []).append((r.place, 0, r.n))
            heavy = [x for k in sorted(groups) for x in cut(sorted(groups[k]), shift)]
            if not heavy or not shift:
                break
            part, above, shift = keys.filter(F.shiftright("page_id", shift).isin(heavy)), shift, max(0, shift - 8)
        single: dict[int, list[tuple[int, int, int]]] = {}
        for r in keys.filter(F.col("page_id").isin(heavy)).groupBy("page_id", bits.alias("bits")).agg(F.sum("size").alias("n")).collect() if heavy else ():
            single.setdefault(r.page_id, []).append((r.page_id, r.bits, r.n))
        for rows in single.values():
            cut(sorted(rows), 0)
    own, cuts = sorted(set(cuts)), []
    nulls = keys.filter("page_id is null").groupBy(bits.alias("bits")).agg(F.sum("size").alias("n")).collect()
    cut(sorted((0, r.bits, r.n) for r in nulls), 0)
    first = in_parts(bits, [low for _, low in cuts])  # null ids have shards of their own, before all others
    pair = lambda i, low: F.struct(F.lit(i).cast("long").alias("i"), F.lit(low).cast("long").alias("b"))
    rest = in_parts(F.struct(F.col("page_id").alias("i"), bits.alias("b")), [pair(*x) for x in own], len(cuts) + bool(nulls))
    return F.when(F.col("page_id").isNull(), first).otherwise(rest).cast("int"), len(own) + len(cuts) + bool(nulls) + 1


def roles(keys: DataFrame, least_bytes: int, place: str) -> DataFrame:
    """page_id, sha, u of the records that are revisits as a whole, with refers_to. keys: page_id, sha, u, size."""
    last = (1 << 63) - 1
    own = F.struct(F.coalesce("page_id", F.lit(last)).alias("i"), F.col("page_id").isNull().alias("none"), "u")
    groups = keys.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    groups = written(groups, "groups", place)
    total = groups.agg(F.sum("m")).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col("m") * 100 >= total).select("sha", "first"))  # at most 100 rows
    few = groups.filter(F.col("m") * 100 < total).select("sha", "first")
    distinct = keys.select("page_id", "sha", "u").distinct()
    found = distinct.join(hot, "sha").unionByName(distinct.join(hot.select("sha"), "sha", "left_anti").join(few, "sha"))
    return found.filter(own != F.col("first")).select("page_id", "sha", "u", F.struct(F.when(~F.col("first.none"), F.col("first.i")).alias("id")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files below `folder` and returns the manifest: shard, path, records, first_id, last_id, n_bytes, sha256."""
    spark, place = pages.sparkSession, shared_folder(pages.sparkSession, "warc-keys")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha2("html", 256), "u": F.xxhash64("url")})
    keys = written(rows.select("page_id", "sha", "u", F.octet_length("html").cast("long").alias("size")), "keys", place)
    shard, n_shards = shard_of(keys, shard_bytes)
    revisits = roles(keys, least_bytes, place).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "u", "refers_to", F.lit(0).alias("kind"))
    records = rows.withColumns({"refers_to": F.lit(None).cast("struct<id: bigint>"), "kind": F.lit(1)})
    order = [F.col("page_id").asc_nulls_first(), F.col("sha"), F.col("u"), F.col("kind")]
    dealt = records.unionByName(revisits).repartitionById(n_shards, shard).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, role, at, copy = RollingWriter(folder, TaskContext.get().partitionId(), roll_bytes), None, None, 0
        for b in batches:
            for page_id, url, html, sha, u, refers_to, kind in zip(*(b.column(x) for x in ("page_id", "url", "html", "sha", "u", "refers_to", "kind"))):
                key = page_id.as_py(), sha.as_py(), u.as_py()
                if kind.as_py() == 0:  # stands before the records of its key
                    role = key, (refers_to.as_py()["id"],)
                    continue
                copy, at = (copy + 1 if at == key else 0), key
                payload = html.as_buffer().to_pybytes()
                named = role[1] if role and role[0] == key else (key[0],) if copy and len(payload) >= least_bytes else None
                name = f"{key[2]}.{copy}" if named or len(payload) < least_bytes else "0"  # revisits name number 0
                out.add(key[0], member(record(key[0], url.as_py(), payload, named, name, date)))
        out.close()
        yield from rows_out(MANIFEST, out.done)

    listed = written(map_arrow(dealt, write, MANIFEST_COLUMNS), "listed", place)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, tmp = file_system(r["tmp"])
                _, path = file_system(r["path"])
                if fs.get_file_info(path).size != r["n_bytes"]:  # else an earlier attempt has moved it
                    fs.move(tmp, path)
            yield b

    map_arrow(listed, commit, MANIFEST_COLUMNS).drop("tmp").write.parquet(f"{folder}/manifest")
    discard(spark, place)
    _sweep(folder)
    return spark.read.parquet(f"{folder}/manifest")


def _sweep(folder: str) -> None:
    """Deletes what lost attempts left."""
    from pyarrow import fs as pafs

    system, path = file_system(folder)
    for f in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.path.endswith(".tmp"):
            system.delete_file(f.path)


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """What each gzip member of a stream holds."""
    left, c, parts = b"", None, []
    while True:
        left = left or stream.read(size)
        if not left:
            if c is not None:
                raise EOFError("a member is cut off")
            return
        c = c or zlib.decompressobj(31)
        parts.append(c.decompress(left))
        left = c.unused_data if c.eof else b""
        if c.eof:
            yield b"".join(parts)
            c, parts = None, []


def parsed(data: bytes) -> dict:
    """Fields of a record: page_id, record_type, payload_bytes, payload_digest, refers_to, target_uri and, for a response, payload. Checks lengths and digests."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{sha1_base32(block)}" != head["WARC-Block-Digest"] or (kind == "response" and (len(payload) != n or sha1_base32(payload) != digest)):
        raise ValueError(f"a damaged record: {head.get('WARC-Record-ID')}")
    number = lambda name: int(head[name]) if name in head else None
    return {"page_id": number("X-Page-ID"), "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "target_uri": head["WARC-Target-URI"], "record_id": head["WARC-Record-ID"], "payload": payload.decode() if kind == "response" else None}


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files in a manifest; with payloads also their texts (null for revisits). One task a file, one record at a time."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()), *([("payload", pa.string())] if payloads else [])]
    out = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    yield from rows_out(out, (tuple(r[x] for x, _ in kinds) for r in map(parsed, members(stream))), 200 if payloads else 4000)

    shards = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    files = manifest.select("shard", "path").repartitionById(shards, "shard").sortWithinPartitions("path")
    return map_arrow(files, read, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in kinds))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """with p as (select page_id, coalesce(html, '') as html from pages), d as (select *, sha1(html) as h, min(page_id) over (partition by html) as first from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (cast('0x' || substr(h, 5 * g + 1, 5) as bigint) >> s) % 32, 1)), '')), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d"""

"""A Spark data source, `media_files`, for the many small JSON documents of media items, and a sink that packs them.

Reading: `path` is a folder of folders, one file a media item in a folder of its name, or a folder that the sink has written.
`kind` says what the documents hold (FIELDS). Small files are dealt to tasks by their bytes and packed files are cut into
ranges of bytes (`task_bytes`), so a task's input is bounded but for a single document. Filters on media_id choose files or lines before
any document is parsed. A document that can't be read is one row with a `reason` and no values, an element that is no object too;
an empty list has no rows. Rows come in no order; `idx` is the place in the document.

Writing: rows (media_id, document), one file a task, so `write_media` bounds the number of files. Files count only once the
manifest names them; it is replaced in one move when all tasks are through. A task that fails deletes its file, commit deletes
what attempts that don't count left, abort all of the job's files. One job at a time may write into a folder.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

#: kind -> the fields of an element.
FIELDS = {
    "segments": ("text", "start", "end", "speaker_id"),
    "words": ("text", "start", "end"),
    "turns": ("start", "end", "speaker_label", "label", "speaker", "speaker_id"),
    "documents": ("document",),
}
MANIFEST = "_manifest.json"
NUMBERS = ("start", "end")


def _arrow(kind: str) -> pa.Schema:
    fields = [(f, pa.float64() if f in NUMBERS else pa.string()) for f in FIELDS[kind]]
    return pa.schema([("media_id", pa.string()), ("idx", pa.int32()), *fields, ("reason", pa.string())])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    files, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files, root.rstrip("/")


def _manifest(files: pafs.FileSystem, root: str) -> list[dict] | None:
    """The files that count, or None in a folder that the sink hasn't written."""
    if files.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


class Rejected(ValueError):
    """A document that is no such document; the message is the reason."""


def elements(kind: str, text: str) -> list:
    """The list that a document of this kind holds."""
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        raise Rejected("invalid_json") from None
    if kind == "turns" and isinstance(v, dict):
        v = v.get("turns")
    if kind == "words":
        if not isinstance(v, dict):
            raise Rejected("no_object")
        segments = v.get("segments")
        nested = [w for s in segments if isinstance(s, dict) for w in s.get("words") or []] if isinstance(segments, list) else []
        v = nested or v.get("words") or []
    if not isinstance(v, list):
        raise Rejected("no_list")
    return v


def _value(field: str, x: dict):
    v = x.get(field)
    if field == "text" and x.get("word") is not None:
        v = x["word"]
    if field in NUMBERS:
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def rows_of(kind: str, media_id: str | None, text: str | None) -> Iterator[tuple]:
    """Rows of a document: media_id, idx, the fields, reason."""
    none = (None,) * len(FIELDS[kind])
    if text is None:
        yield media_id, None, *none, "unreadable"
        return
    if kind == "documents":
        yield media_id, 0, text, None
        return
    try:
        found = elements(kind, text)
    except Rejected as e:
        yield media_id, None, *none, str(e)
        return
    for i, x in enumerate(found):
        if isinstance(x, dict):
            yield media_id, i, *(_value(f, x) for f in FIELDS[kind]), None
        else:
            yield media_id, i, *none, "no_object"


@dataclass
class Small(InputPartition):
    """Whole files: (media_id, path)."""

    files: list[tuple[str, str]]


@dataclass
class Range(InputPartition):
    """The lines of a packed file that begin in a range of its bytes."""

    path: str
    start: int
    stop: int


class MediaReader(DataSourceReader):
    def __init__(self, options, wanted: set | None = None):
        self.path, self.kind, self.wanted = options["path"], options.get("kind", "segments"), wanted
        self.suffixes = tuple(options.get("suffixes", ".json,.txt").lower().split(","))
        self.task_bytes = int(options.get("task_bytes", 32 << 20))

    def pushFilters(self, filters):
        """Equality with media_id and lists of it are done here, all else is Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("media_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def takes(self, media_id: str | None) -> bool:
        return self.wanted is None or (media_id is not None and media_id in self.wanted)

    def partitions(self):
        files, root = _place(self.path)
        packed = _manifest(files, root)
        if packed is not None:
            return [Range(f["name"], at, min(at + self.task_bytes, f["bytes"])) for f in packed for at in range(0, f["bytes"], self.task_bytes)]
        out, size = [Small([])], 0
        for f in sorted(files.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if f.type != pafs.FileType.File or not f.base_name.lower().endswith(self.suffixes) or f.base_name.startswith(("_", ".")):
                continue
            media_id = f.path.rsplit("/", 2)[-2].removeprefix("media_id=")
            if not self.takes(media_id):
                continue
            if out[-1].files and (size + f.size > self.task_bytes or len(out[-1].files) >= 1000):
                out.append(Small([]))
                size = 0
            out[-1].files.append((media_id, f.path))
            size += f.size
        return out

    def documents(self, partition) -> Iterator[tuple[str | None, str | None]]:
        files, root = _place(self.path)
        if isinstance(partition, Small):
            for media_id, path in partition.files:
                try:
                    with files.open_input_stream(path) as f:
                        text = f.read().decode("utf-8-sig")
                except (OSError, UnicodeDecodeError):
                    text = None
                yield media_id, text
        elif isinstance(partition, Range):
            with io.BufferedReader(files.open_input_file(f"{root}/{partition.path}"), 1 << 20) as f:
                if partition.start:
                    f.seek(partition.start - 1)
                    f.readline()
                while f.tell() < partition.stop and (line := f.readline()):
                    media_id, text = json.loads(line)
                    if self.takes(media_id):
                        yield media_id, text

    def read(self, partition):
        schema, rows = _arrow(self.kind), []
        for media_id, text in self.documents(partition):
            for row in rows_of(self.kind, media_id, text):
                rows.append(row)
                if len(rows) == 4096:
                    yield self.batch(rows, schema)
                    rows = []
        if rows:
            yield self.batch(rows, schema)

    @staticmethod
    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int
    documents: int


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator):
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        name, n, size = f"part-{self.job}-{uuid.uuid4().hex}.jsonl", 0, 0
        try:
            with files.open_output_stream(f"{root}/{name}") as out:
                for batch in iterator:
                    for media_id, document in zip(batch.column("media_id").to_pylist(), batch.column("document").to_pylist()):
                        line = json.dumps([media_id, document], ensure_ascii=False).encode() + b"\n"
                        out.write(line)
                        n, size = n + 1, size + len(line)
        except BaseException:
            files.delete_file(f"{root}/{name}")
            raise
        if not n:
            files.delete_file(f"{root}/{name}")
        return Written(name, size, n)

    def commit(self, messages):
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        before = _manifest(files, root) or []
        new = [{"name": m.name, "bytes": m.bytes, "documents": m.documents} for m in messages if m is not None and m.documents]
        fresh = f"{root}/{MANIFEST}.{self.job}"
        with files.open_output_stream(fresh) as out:
            out.write(json.dumps({"files": new if self.overwrite else before + new}).encode())
        files.move(fresh, f"{root}/{MANIFEST}")
        self._delete(files, root, keep={f["name"] for f in new})
        for f in before if self.overwrite else []:
            files.delete_file(f"{root}/{f['name']}")

    def abort(self, messages):
        self._delete(*_place(self.path), keep=set())

    def _delete(self, files: pafs.FileSystem, root: str, keep: set[str]) -> None:
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name not in keep:
                files.delete_file(f.path)


class MediaFiles(DataSource):
    @classmethod
    def name(cls):
        return "media_files"

    def schema(self):
        kind = self.options.get("kind", "segments")
        if kind not in FIELDS:
            raise ValueError(f"kind must be one of {', '.join(FIELDS)}")
        fields = ", ".join(f"`{f}` {'double' if f in NUMBERS else 'string'}" for f in FIELDS[kind])
        return f"media_id string, idx int, {fields}, reason string"

    def reader(self, schema):
        return MediaReader(self.options)

    def writer(self, schema, overwrite):
        return MediaWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach Python sources, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaFiles)


def read_media(spark: SparkSession, path: str, kind: str = "segments", **options) -> DataFrame:
    """Rows of the documents, rejected ones (`reason` is not null) included; start and end also as start_ms and end_ms, a turn without an end ends where it starts."""
    register(spark)
    rows = spark.read.format("media_files").options(path=path, kind=kind, **options).load()
    if "start" not in rows.columns:
        return rows
    end = F.coalesce("end", "start") if kind == "turns" else F.col("end")
    ms = lambda c: F.round(c * 1000).cast("long")
    return rows.withColumns({"start_ms": ms(F.col("start")), "end_ms": ms(end)})


def write_media(documents: DataFrame, path: str, files: int = 64, mode: str = "append") -> None:
    """Documents (media_id, document) in at most `files` new files, by hash of the media item and sorted by it. mode: append or overwrite."""
    register(documents.sparkSession)
    d = documents.select(F.col("media_id").cast("string").alias("media_id"), F.col("document").cast("string").alias("document"))
    d.repartition(files, "media_id").sortWithinPartitions("media_id").write.format("media_files").option("path", path).mode(mode).save()

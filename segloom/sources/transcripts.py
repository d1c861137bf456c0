"""Readers of transcripts, turns, media listings, profiles and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,text:string,start:double,end:double>"
SEGMENT = f"struct<text:string,start:double,end:double,speaker_id:string,words:array<{WORD}>>"


def _media(path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(path), r"([^/]+)/[^/]+$", 1)


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segment lists (JSON arrays, one file a media item in a folder of its name): media_id, seg_idx and the fields, times in ms."""
    rows = spark.read.schema("text string, start double, end double, speaker_id string, words array<" + WORD + ">").option("multiLine", True).json(paths)
    rows = rows.select("*", _media().alias("media_id"), F.monotonically_increasing_id().alias("_o"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("media_id").orderBy("_o")) - 1
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return rows.select("media_id", n.alias("seg_idx"), "text", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "speaker_id", "words")


def segments_of(text: DataFrame) -> DataFrame:
    """The same of documents (media_id, value)."""
    rows = text.select("media_id", F.posexplode(F.from_json("value", f"array<{SEGMENT}>")).alias("seg_idx", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return rows.select("media_id", "seg_idx", "s.text", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.speaker_id", "s.words")


def missing_media(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Media of `expected` without any segment: their lists were empty or no lists."""
    return expected.select("media_id").join(segments.select("media_id").distinct(), "media_id", "left_anti")


def words_of_payload(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Words of payloads (struct of segments[].words[] and words[]): the nested ones, or the flat ones if there are none; text under `word` or `text`."""
    p = F.col("payload")
    nested = F.flatten(F.transform(F.coalesce(p["segments"], F.array()), lambda s: F.coalesce(s["words"], F.array())))
    words = F.when(F.size(nested) > 0, nested).otherwise(p["words"])
    rows = payloads.select("media_id", *(keep or []), F.posexplode(words).alias("word_idx", "w"))
    return rows.select("media_id", *(keep or []), "word_idx", F.coalesce("w.word", "w.text").alias("text"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def read_transcript_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Words of transcript files, times in ms."""
    rows = spark.read.schema(f"segments array<struct<words:array<{WORD}>>>, words array<{WORD}>").option("multiLine", True).json(paths)
    w = words_of_payload(rows.select(_media().alias("media_id"), F.struct("segments", "words").alias("payload")))
    return w.select("media_id", "word_idx", "text", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"))


def read_turns(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns, rejected files) of files that hold a list of turns or an object with one."""
    return turns_of(spark.read.option("wholetext", True).text(paths).select(_media().alias("media_id"), "value"))


def turns_of(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, rejected) of documents (media_id, value)."""
    turn = "struct<start:double,end:double,speaker_label:string,label:string,speaker:string,speaker_id:string>"
    bare = F.from_json("value", f"array<{turn}>")
    inner = F.from_json(F.get_json_object("value", "$.turns"), f"array<{turn}>")
    rows = text.withColumn("t", F.when(F.ltrim("value").startswith("["), bare).otherwise(inner))
    t = rows.filter("t is not null").select("media_id", F.explode("t").alias("t")).select("media_id", F.round(F.col("t.start") * 1000).cast("long").alias("start_ms"), F.round(F.coalesce("t.end", "t.start") * 1000).cast("long").alias("end_ms"), "t.speaker_label", "t.label", "t.speaker", "t.speaker_id")
    return t, rows.filter("t is null").select("media_id")


def list_media(spark: SparkSession, folder: str, extensions: list[str], deep: bool = False) -> DataFrame:
    """Paths of a folder's files (deep: and of those in its folders, which tasks list) with the extensions, whatever their case, sorted; contents aren't read."""
    want = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, min(int(before), 64))  # else a task for each folder
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(folder).select("path")
    finally:
        spark.conf.set(listing, before)
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(want)).orderBy("path")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a JSON file (name -> settings, or under `profiles`), as profile (lower case) and settings (JSON); other entries are left out."""
    text = spark.read.option("wholetext", True).text(path)
    root = F.coalesce(F.get_json_object("value", "$.profiles"), F.col("value"))
    rows = text.select(F.explode(F.from_json(root, "map<string,string>")).alias("name", "settings"))
    return rows.filter(F.col("settings").startswith("{")).select(F.lower("name").alias("profile"), "settings")


def read_run_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """job_name, created_at, metrics (JSON object or `{}`), tts_config (JSON object or `{}`) of metrics files."""
    return run_metrics_of(spark.read.option("wholetext", True).text(paths))


def run_metrics_of(text: DataFrame) -> DataFrame:
    """The same of documents (value)."""
    part = lambda k: F.when(F.get_json_object("value", f"$.{k}").startswith("{"), F.get_json_object("value", f"$.{k}")).otherwise("{}").alias(k)
    return text.select(F.get_json_object("value", "$.job_name").alias("job_name"), F.get_json_object("value", "$.created_at").alias("created_at"), part("metrics"), part("tts_config"))


def write_segments(segments: DataFrame, path: str, files: int = 64) -> None:
    """Segments as JSON lines in at most `files` files, each media item whole and in order in one of them, by its hash; binary columns are left out."""
    s = segments.drop(*[n for n, t in segments.dtypes if t == "binary"])
    s.repartition(files, "media_id").sortWithinPartitions("media_id", "seg_idx").write.json(path)


def write_manifests(records: DataFrame, path: str) -> None:
    """`audio_file|text|speaker_name` lines, a folder a split."""
    records.select("split", F.concat_ws("|", "audio_file", "text", "speaker_name").alias("value")).write.partitionBy("split").text(path)


def write_documents(documents: DataFrame, path: str, tasks: int = 64) -> None:
    """One text file a media item, written by that many tasks."""
    documents.select("media_id", F.col("document").alias("value")).repartition(tasks, "media_id").write.partitionBy("media_id").text(path)


def write_packed(documents: DataFrame, path: str, files: int = 64) -> None:
    """Documents (media_id, document) as JSON lines in at most `files` files, by hash of the media item: a file an item takes longer to make, list and open than to read."""
    documents.select(F.col("media_id").cast("string").alias("media_id"), F.col("document").alias("value")).repartition(files, "media_id").write.json(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The documents of write_packed: media_id, value."""
    return spark.read.schema("media_id string, value string").json(path)


def write_benchmark(results: DataFrame, path: str) -> None:
    """Results as CSV with a header and as JSON."""
    results.write.option("header", True).csv(f"{path}/csv")
    results.write.json(f"{path}/json")


def benchmark_rows(results: DataFrame) -> DataFrame:
    """A Markdown table row a profile."""
    cells = [F.coalesce(F.format_string("%.4f", c), F.lit("n/a")) for c in ("speaker_verification", "wer", "cer", "labse_mean")]
    return results.select("job_name", F.concat(F.lit("| "), F.concat_ws(" | ", "job_name", *cells, "verdict"), F.lit(" |")).alias("row"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors can read: below spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="segloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

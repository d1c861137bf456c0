"""The corpus pipeline: documents to token files, in five stages that are each written and read again.

In every stage: null texts count as empty, null doc_ids are rows like others, rows of equal doc_id are told apart by their
texts, columns beside doc_id, text and source are carried whole whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm.chosen_path import NearDuplicates, digest
from segloom.llm.common import packed, shuffle_partitions, table, unpacked, written
from segloom.llm.subword_quality import quality
from segloom.llm.temperature_mixing import mixed
from segloom.llm.token_files import tokens_of
from segloom.llm.winnow import contaminated, decontaminate


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, each repeated row for itself. An empty text gets the score of the bias."""
    rows = packed(docs, "doc_id", "text")
    return unpacked(quality(rows, table(spark, sf_dir, "labels"), rows.columns).filter("score >= 0.5"), docs.columns, "doc_id", "text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, alike to 0.8 or more on shingles of five words: the one with the least doc_id.

    Of a group's rows of one doc_id the text with the least digest stays; null doc_ids come last. Rows that repeat a doc_id and
    its text are one. Texts without words are alike to none and stay.
    """
    keys = {"_id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), "_none": F.col("doc_id").isNull()}
    stay = NearDuplicates(docs.select("doc_id", "text"), percent=80).survivors().withColumnsRenamed({"digest": "_digest"}).withColumns(keys)
    rows = packed(docs, "doc_id", "text").withColumns(keys | {"_digest": digest()})
    on = [*keys, "_digest"]
    return unpacked(rows.join(stay.select(on), on, "left_semi").dropDuplicates(on), docs.columns, "doc_id", "text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are in passages of the benchmark. Texts without words stay; repeated rows are each judged."""
    rows = packed(docs, "doc_id", "text")
    return unpacked(decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=rows.columns).filter(~contaminated()), docs.columns, "doc_id", "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source to the tempered weights, within the tokens of all; some come twice, some of the largest sources not at all.

    The files hold them in the order of the mixture: every stretch has the target weights. Ties go by a hash of doc_id and text.
    """
    rows = packed(docs, "doc_id", "text", "source")
    dealt = mixed(rows, keep=rows.columns)
    n = shuffle_partitions(spark)
    # mix_at spreads tokens evenly over 0 to 1, so equal parts of it are parts of equal size.
    part = F.least(F.floor(F.col("mix_at") * n), F.lit(n - 1)).cast("int")
    dealt = dealt.repartitionById(n, part).sortWithinPartitions("mix_at", F.xxhash64("doc_id", "text"), "epoch")
    return unpacked(dealt.select(rows.columns), docs.columns, "doc_id", "text", "source")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place, number and digest of ids, read back from the files. They follow the rows of docs' own files, and doc_id where docs are in none."""
    try:
        at = docs.metadataColumn("_metadata")
        path = at["file_path"]
        rows = docs.select("doc_id", "text", F.regexp_extract(path, r"part-(\d+)", 1).try_cast("long").alias("part"), path.alias("path"), at["row_index"].alias("at"))
    except AnalysisException:
        return tokens_of(spark, docs)
    return tokens_of(spark, rows, order=["part", "path", "at"])


STAGES = [("quality", by_quality), ("near_duplicates", without_near_copies), ("decontamination", decontaminated), ("mixing", mixture), ("token_files", token_files)]

#: Trained weights and hashes have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

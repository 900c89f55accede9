"""A pipeline that turns the table of documents into token ids: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, langid, mixing, nearcopies, pii
from chronolith.llm.common import checkpointed, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter, under the language found (their own label where none could be learnt); rejects null
    texts and those without any letter."""
    found = langid.label(docs.select(*COLUMNS)).filter("lang_pred is null or lang_pred <> 'und'")
    return found.select("doc_id", "text", F.coalesce("lang_pred", "lang").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest id (null ids last), and of its rows the first by text,
    lang, source and n_chars."""
    rows = docs.select(*COLUMNS)
    found = checkpointed(nearcopies.groups(rows))
    counted = found.groupBy("root", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n")).alias("least")
    chosen = counted.groupBy("root").agg(least).select(F.col("root").alias("own"), F.col("least.doc_id").alias("id"), F.col("least.n").alias("n"))
    first = found.join(chosen, (F.col("root") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
    first = checkpointed(first.select("own", "id", "t", "n").distinct())
    texts = rows.withColumn("hash", F.xxhash64("text"))

    def of(picked: DataFrame) -> DataFrame:
        return texts.join(picked, (F.col("hash") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("id")))

    pick = F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("row")
    tied = of(first.filter("n > 1")).groupBy("own").agg(pick).select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])
    return of(first.filter("n = 1")).select(*COLUMNS).unionByName(tied)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; keeps every document."""
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of the sources by their target weights; a document comes once for each pass that takes of it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return bpe.digests(encoded, "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("redaction", redaction), ("mixture", mixture), ("token_ids", token_ids)]

#: SQL cannot express these stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the session's shared folder and read again by the next; a stage's folder
    goes when the next one is written, and the last stays for the result's reader."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for n, (name, stage) in enumerate(STAGES):
        here = f"{at}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before is not None:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        before = here
    return docs

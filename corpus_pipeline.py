"""A corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from noticeloom.llm import decontam, neardup, packing, quality, toxicity, urlrules
from noticeloom.llm.folds import remainder
from noticeloom.operators.durable import durable, scratch_root
from noticeloom.operators.shipping import ship
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the factorization machine scores below its threshold; empty and null texts stay, repeated rows are judged each."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    return docs.where(toxicity.toxicity_score(model, F.col("text")) < toxicity.THRESHOLD)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the attention model scores at its threshold or above; null texts are empty, repeated rows are judged each."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    return docs.where(quality.quality_score(model, F.col("text")) >= quality.THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8): the least by id, then by a hash of its text.

    Documents are told apart by id and text: two texts with one id are two documents, and both stay if they are no near duplicates.
    Of rows that repeat id and text one stays, whatever their other columns; texts without words have no duplicates and all stay.
    A null id is the least.
    """
    ship(spark)
    doc, kept, rows, words = urlrules.fresh_names(docs, "document", "stays", "copies", "words")
    identity = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    found = neardup.near_duplicates(docs.select(identity.alias("document"), "text"), width=5, id_col="document")
    verdicts = found.groupBy(F.col("document").alias(doc)).agg(F.max("kept").alias(kept), F.count("*").alias(rows), F.max("n_shingles").alias(words))
    verdicts = durable(verdicts.where(~F.col(kept) | (F.col(rows) > 1) & (F.col(words) > 0)))  # most documents are neither
    same = F.struct(docs["doc_id"], F.xxhash64(docs["text"])).eqNullSafe(F.col(doc))
    joined = docs.join(verdicts, same, "left")
    single = joined.where(F.col(rows).isNull()).select(*docs.columns)
    repeated = joined.where(F.col(kept) & (F.col(rows) > 1)).dropDuplicates([doc]).select(*docs.columns)
    return single.unionByName(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget; null texts hold none, repeated rows are judged each."""
    ship(spark)
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with a checksum in place of their ids; a null text is empty, repeated rows are packed each."""
    ship(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digest = durable(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(digest)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage's method can be expressed in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

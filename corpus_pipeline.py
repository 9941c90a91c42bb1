"""A corpus pipeline of four stages. Each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvaframe.llm import ngram_join, packing, quality_rules, toxicity
from sylvaframe.llm._common import ensure_checkpoint_dir, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network scores under 0.5. It learns from the labelled rows of the documents table."""
    network = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity.toxicity(network, docs, docs["text"])).where(F.col(score) < 0.5).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the learned list keep. The list is learned from the labelled rows of the documents table."""
    rules = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    stats = fresh(docs, "stats")
    return quality_rules.judged(docs, rules, stats_name=stats).where(F.col(stats)["kept"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal or similar texts: that of the least id, of the least hash where texts share it; rows without an id come last.

    An id and a text make a document, so different texts of one id, and rows without an id, are joined and reduced like others.
    """
    key, place = fresh(docs, "key"), fresh(docs, "place")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.isnull("doc_id"), F.coalesce("text", F.lit(""))))
    classes = ngram_join.ngram_join(keyed, id_col=key).select(key, "class_id").distinct()
    ids = keyed.select(key, "doc_id").distinct()
    least = F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", key)).alias("least")
    kept = classes.join(ids, key).groupBy("class_id").agg(least).select(F.col("least")[key].alias(key))
    by_key = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    return keyed.join(kept, key, "left_semi").withColumn(place, F.row_number().over(by_key)).where(F.col(place) == 1).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of the tiers' sizes, with a checksum of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: The trained network and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what is between two stages lies under spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs

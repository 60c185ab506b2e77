"""From raw documents to packed training sequences, in stages that each read what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup, mixing, quality_model, queries, simhash, url_filter
from fieldloom.session import materialize, shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier scores at least GOOD; null and empty texts are scored too."""
    model = quality_model.train(docs, queries.learnable(spark, sf_dir))
    return docs.where(quality_model.scored(model, F.col("text")) >= queries.GOOD)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep one row: of those with the largest id, or all without id, any where source and language differ too."""
    groups = exact_dedup.exact_groups(docs)
    marks = groups.where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha"), "kept").agg(F.count("*").alias("_n"))
    marks = materialize(marks.where("not kept or _n > 1").select("_id", "_sha", "kept"), "copies")
    # Only texts whose hash passes a filter of the marked ones are shuffled; the exact join sorts out chance hits.
    hashed = docs.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    passes = url_filter.may_be_listed(hashed, "_text", marks.select(F.col("_sha").alias("entry")), "_may")
    joined = passes.where("_may").join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left")
    # Rows that repeat both id and text are few; they are combined before they are shuffled again.
    rest = [c for c in docs.columns if c != "doc_id"]
    once = joined.where("kept").groupBy("doc_id", "_text").agg(F.first(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*")
    return passes.where("not _may").select(*docs.columns).unionByName(joined.where("kept is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the text of the smallest id, of its texts that with the smallest hash.

    Texts are told apart by id and hash, so another text under the same id stays. Rows without an id all stay.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = materialize(simhash.near_duplicates(docs.withColumn("_sha", sha), also=("_sha",)).where("doc_id is not null"), "near")
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("_sha").alias("_least"))
    again = found.where("doc_id = component_id").join(first, "doc_id").where("_sha != _least")
    gone = found.where("doc_id != component_id").select("doc_id", "_sha").union(again.select("doc_id", "_sha")).distinct().toDF("_id", "_gone")
    return docs.join(gone, (F.col("doc_id") == F.col("_id")) & (sha == F.col("_gone")), "left_anti").select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the mix first sends them: rows and files follow each other.

    Packing takes its order from these rows and files. Rows that repeat id and source stay together. The repeats of scarce
    sources are made when packing, without texts.
    """
    order = mixing.mix_passes(docs, queries.PARTS, queries.BLOCK_ROWS).where("pass = 0")
    place = order.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.min(F.struct("slot", "place")).alias("_at"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    at = ["_at.slot", "_at.place"]
    return docs.join(place, same).repartitionByRange(*at).sortWithinPartitions(*at).select(*docs.columns)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, as the order of the mix deals them; null texts count as empty."""
    return queries.mixed_sequences(docs)


STAGES = [
    ("quality", good_documents),
    ("exact", distinct_documents),
    ("near", unlike_documents),
    ("mix", mixed_documents),
    ("pack", packed_documents),
]

#: A learned classifier and a component search are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first pass reads lengths and prefixes and counts the rows of each (length, prefix hash) within lengths that occur
more than once. What occurs more than once there is noted in a filter of a fixed number of bits. The second pass reads
full content only where the filter says that a group survives, and groups those rows by their full hash. A chance hit in
the filter costs a hash and nothing else. Neither pass shuffles text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialize

#: Characters of the prefix.
PREFIX = 256
#: 64-bit words of the survivors' filter: 1 MB, whatever the input.
FILTER_WORDS = 1 << 17
#: The bit of a row's key within its word.
BIT = "shiftleft(1L, cast(_key & 63 as int))"


def _key(text: Column) -> Column:
    return F.xxhash64(F.octet_length(text), F.substring(text, 1, PREFIX))


def _word(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 8), F.lit(FILTER_WORDS)).cast("int")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; a null id
    is smaller than any other. Rows that share text and id are one document listed more than once: they count in
    group_size and are kept or dropped together. sha256 is null for rows that no group could hold, unless `hash_all`.
    Columns besides the two are not read, so their names don't matter.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    first = rows.select(F.octet_length("_text").alias("_length"), _key(F.col("_text")).alias("_key"))
    shared = first.groupBy("_length", "_key").agg(F.count("*").alias("_n"))
    lengths = shared.groupBy("_length").agg(F.sum("_n").alias("_all")).where("_all > 1")
    again = shared.where("_n > 1").join(lengths, "_length", "left_semi")
    words = again.groupBy(_word(F.col("_key")).alias("_word")).agg(F.bit_or(F.expr(BIT)).alias("_bits"))
    words = materialize(words, "survivors")
    keyed = rows.withColumn("_key", _key(F.col("_text"))).withColumn("_at", _word(F.col("_key")))
    # The filter has FILTER_WORDS rows at most.
    joined = keyed.join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    survives = F.expr(f"coalesce((_bits & {BIT}) != 0, false)")
    full = F.sha2("_text", 256)
    hashed = joined.select("doc_id", survives.alias("_survives"), (full if hash_all else F.when(survives, full)).alias("sha256"))
    groups = hashed.where("_survives").groupBy("sha256").agg(F.count("*").alias("_size"), F.max("doc_id").alias("_keep"))
    # Written, so that both sides of the join are shuffled for it and a hot group's rows can be split.
    groups = materialize(groups.where("_size > 1").withColumnRenamed("sha256", "_sha"), "groups")
    found = hashed.join(groups, F.col("sha256") == F.col("_sha"), "left")
    size = F.coalesce("_size", F.lit(1).cast("long"))
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "sha256")

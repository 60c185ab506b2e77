"""A BM25 index that grows: added documents make a segment of their own, and a search merges the segments' statistics.

What depends on the whole corpus, the average length and the weight of a term, is not stored. A segment keeps term
frequencies and lengths, and per term how many documents hold it, its highest frequency and its shortest document, from
which a bound on its weight follows for any average length. So adding documents reads none of the older ones but their ids.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.bm25 import B, K1, Index, distinct_bags, sizes_of, term_counts, tokens_of, weighted_terms
from fieldloom.session import materialize

PARTS = ("members", "postings", "terms", "sizes")


@dataclass(frozen=True)
class GrowingIndex:
    """The segments in a folder that executors share; a segment counts once its sizes, written last, are there."""

    spark: SparkSession
    folder: str

    def segments(self) -> list[str]:
        """Folders of the finished segments, oldest name first."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/sizes/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        return sorted(f.getPath().getParent().getParent().toString() for f in found)

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{s}/{part}" for s in self.segments()])

    def add(self, docs: DataFrame, doc_id: str, text_col: str) -> None:
        """Index more documents; their ids must neither repeat nor be there already. No rows make no segment."""
        tokens = materialize(tokens_of(docs, doc_id, text_col).withColumnRenamed(doc_id, "doc_id"), "segment-tokens")
        n_docs, n_tokens = sizes_of(tokens, "doc_id")
        if not n_docs:
            return
        if self.segments():
            again = self._read("members").join(tokens.select("doc_id"), "doc_id", "left_semi").count()
            if again:
                raise ValueError(f"{again} documents are indexed already")
        named = materialize(distinct_bags(tokens, "doc_id", "bag"), "segment-bags")
        place = f"{self.folder}/segment-{len(self.segments()):06d}-{uuid.uuid4().hex}"
        tokens.select("content", "doc_id").join(named.select("content", "bag"), "content").select("bag", "doc_id").write.parquet(f"{place}/members")
        term_counts(named, "bag", "copies", F.size("tokens").alias("length")).write.parquet(f"{place}/postings")
        found = self.spark.read.parquet(f"{place}/postings").groupBy("term")
        found.agg(
            F.sum("copies").alias("documents"), F.count("*").alias("bags"), F.max("tf").alias("most"), F.min("length").alias("shortest")
        ).write.parquet(f"{place}/terms")
        self.spark.range(1).select(F.lit(n_docs).alias("documents"), F.lit(n_tokens).alias("tokens")).write.parquet(f"{place}/sizes")

    def index(self) -> Index | None:
        """The whole corpus as one index, to search as any other; None without segments. Only term statistics are merged."""
        if not self.segments():
            return None
        total = self._read("sizes").agg(F.sum("documents"), F.sum("tokens")).first()
        average = F.lit((total[1] or 1) / (total[0] or 1))
        weight = lambda tf, length: F.col(tf) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / average))
        merged = self._read("terms").groupBy("term").agg(
            F.sum("documents").alias("documents"), F.sum("bags").alias("bags"), F.max("most").alias("most"), F.min("shortest").alias("shortest")
        )
        terms = weighted_terms(merged.select("term", "documents", "bags", weight("most", "shortest").alias("peak")), total[0])
        postings = self._read("postings").select("bag", "term", weight("tf", "length").alias("impact"))
        return Index(self._read("members"), postings, terms)

"""An index of documents of two texts: the same hits as over the joined texts, every text cut once."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bm25, retrieval

COLUMNS = [(1, "net value"), (2, "value net"), (3, "fund id"), (4, ""), (5, None), (6, "id id fund")]
FIELDS = [(1, "value of fund"), (2, "fund of value"), (3, "zip"), (4, "")]


def frames(spark):
    docs = [(f"d{n:02d}", c, f) for n, (c, f) in enumerate((c, f) for c in (1, 2, 3, 4, 5, 6, 7, None) for f in (1, 2, 3, 4, 9, None))]
    docs += [(f"e{n:02d}", 1, 3) for n in range(9)]
    return (spark.createDataFrame(docs, "doc string, c long, f long"), spark.createDataFrame(COLUMNS, "c long, text string"),
            spark.createDataFrame(FIELDS, "f long, text string"))


@pytest.mark.parametrize("reads", [bm25.DIRECT_READS, 0])
@pytest.mark.parametrize("few", [bm25.FEW_BAGS, 0])
def test_pairs_are_found_as_their_joined_texts(spark, reads, few, monkeypatch):
    monkeypatch.setattr(bm25.Index.members_of, "__defaults__", (few,))
    docs, first, second = frames(spark)
    joined = docs.join(first.withColumnRenamed("text", "a"), "c").join(second.withColumnRenamed("text", "b"), "f", "left")
    whole = bm25.build_index(joined.select("doc", F.concat_ws(" ", "a", "b").alias("text")), "doc", "text")
    pairs = bm25.build_pair_index(docs, "doc", "c", "f", first, second)
    asked = spark.createDataFrame(enumerate(["net", "fund value", "id", "zip net", "of", "none", ""]), "q int, text string")
    for k in (1, 4, 100):
        want, got = (bm25.bm25_search(asked, "q", "text", i, k, reads).orderBy("q", "rank").collect() for i in (whole, pairs))
        assert want and want == got
    assert sorted(pairs.members.select("doc_id").collect()) == sorted(joined.select("doc").collect())


def test_repeated_and_missing_ids_of_pairs_are_refused(spark):
    docs, first, second = frames(spark)
    bm25.build_pair_index(docs.union(spark.createDataFrame([("d00", 77, 1)], docs.schema)), "doc", "c", "f", first, second).drop()
    for more in ("d00", None):
        with pytest.raises(ValueError, match="not unique"):
            bm25.build_pair_index(docs.union(spark.createDataFrame([(more, 3, 3)], docs.schema)), "doc", "c", "f", first, second)


def test_texts_of_mappings_are_cut_once(spark, monkeypatch, columns, approved, vocabulary):
    """what is cut into tokens are columns and fields, not their mappings."""
    cut, real = [], bm25.tokens_of
    monkeypatch.setattr(bm25, "tokens_of", lambda df, key, text: cut.append((key, df.count())) or real(df, key, text))
    many = approved.crossJoin(spark.range(50)).withColumn("mapping_id", F.concat_ws("-", "mapping_id", "id")).drop("id")
    asked = spark.createDataFrame([("q", "net asset value")], "q string, text string")
    hits = retrieval.search_approved(asked, "q", "text", columns, many, vocabulary)
    assert [r.mapping_id for r in hits.orderBy("rank").collect()] == ["am_002-0", "am_002-1", "am_002-10", "am_002-11", "am_002-12"]
    assert sorted(cut) == [("canonical_id", 5), ("column_id", 3), ("q", 1)]



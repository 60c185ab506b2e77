"""What an index of pairs writes, and that its bags, gathered or not, score as the joined texts do."""

import pytest
from pyspark.sql import functions as F

from fieldloom import session
from fieldloom.operators import bm25, retrieval


def test_hits_of_mappings_need_neither_written_postings_nor_the_mappings_again(spark, monkeypatch, columns, approved, vocabulary):
    """a mapping's row is written once, not once more for each of its terms, and hits bring their column and field along."""
    written, real = [], bm25.materialize
    for module in (bm25, retrieval):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append((name, df.columns)) or real(df, name))
    asked = spark.createDataFrame([("q", "fnd nothing")], "q string, text string")
    found = retrieval.search_approved(asked, "q", "text", columns, approved, vocabulary)
    names = [name for name, _ in written]
    assert not {"bm25-postings", "bm25-bags"} & set(names) and names.count("bm25-pairs") == 1
    assert {"column_id", "canonical_id"} < set(dict(written)["hits"])
    assert [(r.mapping_id, r.column_name, r.canonical_name, r.rank) for r in found.collect()] == [("am_001", "FND_ID", "fund_identifier", 1)]


@pytest.mark.parametrize("gather", [0, 10**9])
def test_bags_of_pairs_score_as_joined_texts(spark, monkeypatch, gather):
    """with a term in both texts of a document, in one text of each kind only, and in texts without documents."""
    monkeypatch.setattr(bm25, "GATHER_COPIES", gather)
    first = spark.createDataFrame([(1, "net net value"), (2, "value"), (3, "only first"), (4, "unused zip")], "c long, text string")
    second = spark.createDataFrame([(1, "net value"), (2, "zip zip"), (3, "second"), (4, "unused")], "f long, text string")
    rows = [(f"d{n:02d}", n % 3 + 1, n % 4 if n % 4 else None) for n in range(24)]
    docs = spark.createDataFrame(rows, "doc string, c long, f long")
    joined = docs.join(first.withColumnRenamed("text", "a"), "c").join(second.withColumnRenamed("text", "b"), "f", "left")
    whole = bm25.build_index(joined.select("doc", F.concat_ws(" ", "a", "b").alias("text")), "doc", "text")
    pairs = bm25.build_pair_index(docs, "doc", "c", "f", first, second)
    assert pairs.pairs.gathered == (gather == 0)
    want, got = ({r.term: round(r.idf, 9) for r in i.terms.collect()} for i in (whole, pairs))
    assert want == got and len(got) == 6
    # A peak is no less than what any posting has.
    assert pairs.postings.join(pairs.terms, "term").filter("impact > peak + 1e-12").isEmpty()
    # All in first texts, all in second texts, in both.
    for texts, reads in ((["only", "first only"], bm25.DIRECT_READS), (["second", "zip"], bm25.DIRECT_READS), (["net value", "first zip", "unused"], 0)):
        asked = spark.createDataFrame(enumerate(texts), "q int, text string")
        want = bm25.bm25_search(asked, "q", "text", whole, 4, reads).collect()
        got = bm25.bm25_search(asked, "q", "text", pairs, 4, reads, ("c", "f")).collect()
        assert want and sorted(map(tuple, want)) == sorted(tuple(r)[:4] for r in got)
        assert {(r.doc_id, r.c, r.f) for r in got} <= set(rows)


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    """the setting holds for the write only."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key, None)
    with session._shuffles_removed(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key, None) == before

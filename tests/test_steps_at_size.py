"""Steps whose volume must follow the rows that count: what is written, shuffled and gathered by the searches and reports."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bm25, conform, coverage, ordering, reports, retrieval
from fieldloom.operators.ordering import Load


def mappings(spark, n=60, fields=3):
    approved = spark.range(n).select(F.concat(F.lit("m"), F.lpad("id", 4, "0")).alias("mapping_id"), (F.col("id") % 20).alias("column_id"), (F.col("id") % fields).alias("canonical_id"))
    source = spark.range(20).select(
        F.col("id").alias("column_id"), (F.col("id") % 4).alias("platform_id"), F.concat(F.lit("cat.t"), F.col("id") % 2).alias("source_table"), F.concat(F.lit("c"), "id").alias("column_name"))
    names = spark.range(fields).select(F.col("id").alias("canonical_id"), F.concat(F.lit("f"), "id").alias("canonical_name"), F.lit("T").alias("data_type"), F.lit("D").alias("domain_category"))
    return approved, source, names


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def written(monkeypatch, module):
    """The columns of the frames that the module writes, by the name they are written under."""
    real, found = module.materialize, {}

    def noted(df, name):
        found[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(module, "materialize", noted)
    return found


def test_a_load_tells_hot_groups_without_listing_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, -1).otherwise(F.col("id")).alias("g"))
    assert ordering.load(df, ["g"], 100, 50) == Load(1000, True)
    assert ordering.load(df.where("g > 0"), ["g"], 100, 50) == Load(300, False)
    assert ordering.load(df.limit(0), ["g"], 100, 50) == Load(0, False)


def test_hot_pages_write_keys_value_and_place_only(spark, monkeypatch):
    found = written(monkeypatch, ordering)
    approved, source, _ = mappings(spark)
    linked = retrieval.links(approved, source)
    pages = ordering.ordered_pages(linked, ["canonical_id"], ["mapping_id"], "column_name", 7, "names", sizes=approved.select("canonical_id"), floor=5, share=50)
    want = {}
    for r in sorted(linked.collect(), key=lambda r: r.mapping_id):
        want.setdefault(r.canonical_id, []).append(r.column_name)
    got = {}
    for p in sorted(pages.collect(), key=lambda p: p.page):
        got.setdefault(p.canonical_id, []).extend(p.names)
    assert got == want
    assert found == {"sorted": ["canonical_id", "_value", "_order"]}


@pytest.mark.parametrize("floor", [5, 500_000])
def test_wanted_fields_are_joined_last(spark, floor):
    approved, source, _ = mappings(spark)
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "canonical_id long")
    linked, load = retrieval.wanted_links(ids, approved, source, floor=floor, share=50)
    assert load == Load(60, floor == 5)
    assert sorted(r.mapping_id for r in linked.collect()) == sorted(r.mapping_id for r in approved.where("canonical_id = 1").collect())
    # Rows of a field with very many mappings do not meet in one task.
    assert ("strategy=broadcast" in plan(linked)) == (floor == 5)


def test_coverage_reads_the_links_once(spark):
    from fieldloom.settings import Platform
    approved, source, names = mappings(spark)
    matrix = coverage.coverage_matrix(approved, source, names, [Platform(i, f"P{i}", "") for i in range(3)])
    # Platform 3 is not listed, but covers.
    assert {(r.canonical_id, r.coverage) for r in matrix.collect()} == {(i, "4/3") for i in range(3)}
    assert plan(matrix).count("mapping_id") and plan(matrix).count("Window [row_number") == 1
    assert plan(matrix).count("Range (0, 60") == 1


def test_headers_write_and_rank_nothing(spark, monkeypatch):
    approved, source, names = mappings(spark)
    labels = spark.createDataFrame([(i, f"P{i}", i) for i in range(4)], "platform_id long, name string, ord int")

    def no(*_, **__):
        raise AssertionError("ranked")

    monkeypatch.setattr(reports, "rank_in_group", no)
    found = written(monkeypatch, reports)
    report = reports.matrix_report(approved, source, names, labels)
    assert {(r.canonical_id, r.covered, r.links) for r in report.headers.collect()} == {(i, 4, 20) for i in range(3)}
    some = reports.filter_matrix_report(report, "F1", 2)
    assert [r.canonical_id for r in some.headers.collect()] == [1]
    assert reports.filter_matrix_report(report, "no such", 2).headers.isEmpty()
    assert found == {}


def test_rename_text_reads_links_once(spark, monkeypatch):
    approved, source, names = mappings(spark)
    found = written(monkeypatch, conform)
    texts = conform.rename_text(approved, source, names).collect()
    assert sorted(r.source_table for r in texts) == ["cat.t0", "cat.t1"]
    assert found == {"links": ["canonical_id", "mapping_id", "_newest", "platform_id", "source_table", "column_name"]}


def test_terms_are_counted_within_the_row(spark):
    rows = [(1, ["a", "a", "b", "c", "c", "c"]), (2, []), (3, ["x"]), (4, ["", "", "y"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    counts = bm25.term_counts(df, "id")
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "a", 2), (1, "b", 1), (1, "c", 3), (3, "x", 1), (4, "", 2), (4, "y", 1)]
    assert "Aggregate" not in plan(counts)


def test_an_index_writes_no_row_per_member_but_its_tokens(spark, monkeypatch):
    found = written(monkeypatch, bm25)
    docs = spark.createDataFrame([(f"d{i}", "one two two" if i % 3 == 1 else f"three w{i}") for i in range(10)], "id string, text string")
    index = bm25.build_index(docs, "id", "text")
    assert set(found) == {"bm25-tokens", "bm25-bags", "bm25-postings", "bm25-terms"}
    assert {(r.bag, r.doc_id) for r in index.members.collect()} == {("d1" if i % 3 == 1 else f"d{i}", f"d{i}") for i in range(10)}
    queries = spark.createDataFrame([(1, "two")], "q long, text string")
    assert [r.doc_id for r in bm25.bm25_search(queries, "q", "text", index, 3).orderBy("rank").collect()] == ["d1", "d4", "d7"]
    with pytest.raises(ValueError):
        bm25.build_index(docs.union(docs), "id", "text")
    with pytest.raises(ValueError):
        bm25.build_index(docs.union(spark.createDataFrame([(None, "x")], docs.schema)), "id", "text")

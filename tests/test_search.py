import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bm25
from fieldloom.operators.intake import mapped_columns, new_columns, unmapped
from fieldloom.operators.retrieval import cross_platform, cross_platform_map, search_approved, search_fields


def brute(docs, queries, k):
    """Every query against every document, straight from the formula."""
    bags = {d: Counter(t.split()) for d, t in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = []
    for q, text in queries:
        scores = []
        for d, bag in bags.items():
            norm = 1.5 * (0.25 + 0.75 * sum(bag.values()) / mean)
            s = sum(idf[t] * bag[t] * 2.5 / (bag[t] + norm) for t in text.split() if t in bag)
            if round(s, 9) > 0:
                scores.append((-round(s, 9), d, round(s, 4)))
        out += [(q, d, s, i + 1) for i, (_, d, s) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(1, 25))) for i in range(300)]
    docs += [(300 + i, "w0 w1 w0") for i in range(150)]  # copies holding a third of all documents
    docs += [(450, "")]
    queries = [(i, text(rng.randint(1, 12))) for i in range(60)] + [(60, "w0"), (61, "w1 w0"), (62, "nowhere"), (63, ""), (64, "w0")]
    return docs, queries


def rows(df):
    return sorted((r.q, r.doc_id, r.score, r["rank"]) for r in df.collect())


def test_search_equals_brute_force(spark, corpus):
    docs, queries = corpus
    d, q = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "q int, text string")
    index = bm25.build_index(d, "id", "text")
    for k in (1, 5):
        want = brute(docs, queries, k)
        assert rows(bm25.bm25_search(q, "q", "text", index, k)) == want
        # The pruned search, used when scoring outright would read too much.
        assert rows(bm25.bm25_search(q, "q", "text", index, k, direct_reads=0)) == want


def test_pruned_search_leaves_terms_out(spark, corpus):
    docs, _ = corpus
    docs = docs + [(1000 + i, f"rare{i} w0 w1 w2") for i in range(40)]
    queries = [(i, f"rare{i} w0 w1") for i in range(40)]
    index = bm25.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    q = spark.createDataFrame(queries, "q int, text string")
    assert rows(bm25.bm25_search(q, "q", "text", index, 1, direct_reads=0)) == brute(docs, queries, 1)


def test_common_terms_are_joined_as_a_grid(spark, corpus):
    docs, queries = corpus
    index = bm25.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    q = spark.createDataFrame([(i, t) for i, text in queries for t in set(text.split())], "query int, term string")
    plain = bm25.join_postings(q, index, 100)
    split = bm25.join_postings(q, index, 100, 0, 20, 7)
    joined = bm25.join_postings(q, index, 100, 0)
    assert bm25._split_terms(q, index, 20, 7).count() > 0
    assert sorted(map(tuple, plain.select("query", "term", "bag").collect())) == sorted(map(tuple, split.select("query", "term", "bag").collect()))
    assert plain.count() == joined.count()


@pytest.mark.parametrize("docs", [[(1, "a b")], [(1, "a"), (2, "b")], [(1, ""), (2, "")], []])
def test_tiny_corpora_have_no_hits(spark, docs):
    index = bm25.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    q = spark.createDataFrame([(1, "a b")], "q int, text string")
    assert bm25.bm25_search(q, "q", "text", index).collect() == []


def test_search_fields(spark, vocabulary):
    asked = ["fund identifier", "net asset value", "transaction date", "xyzzy gibberish", ""]
    q = spark.createDataFrame([(t, t) for t in asked], "q string, text string")
    hits = search_fields(q, "q", "text", vocabulary)
    first = {r.q: (r.canonical_name, r.score) for r in hits.filter("rank = 1").collect()}
    assert first == {
        "fund identifier": ("fund_identifier", 0.8042), "net asset value": ("net_asset_value", 4.3208),
        "transaction date": ("transaction_date", 3.5896),
    }


def test_search_approved(spark, vocabulary, columns, approved):
    q = spark.createDataFrame([("q", "net asset value total")], "q string, text string")
    lost = spark.createDataFrame([("am_009", "gone", "cf_005", "p", "x", None)], approved.schema)
    hits = search_approved(q, "q", "text", columns, approved.union(lost), vocabulary).collect()
    assert [(h.column_id, h.canonical_name, h.score) for h in hits] == [("sc_002", "net_asset_value", 2.5883)]


def test_cross_platform(spark, columns, approved):
    ids = spark.createDataFrame([("cf_001",), ("cf_005",), ("cf_999",)], "canonical_id string")
    got = {r.canonical_id: [(c.platform_id, c.column_name) for c in r.context] for r in cross_platform(ids, approved, columns).collect()}
    assert got == {"cf_001": [("ledger", "FND_ID"), ("books", "fund_id")], "cf_005": [("ledger", "NAV_AMT")]}
    paged = cross_platform(ids, approved, columns, page_size=1).filter("canonical_id = 'cf_001'").orderBy("page").collect()
    assert [(r.page, r.context[0].column_name) for r in paged] == [(0, "FND_ID"), (1, "fund_id")]
    names = {r.canonical_id: r.names for r in cross_platform_map(approved, columns).collect()}
    assert names["cf_001"] == {"ledger": ["FND_ID"], "books": ["fund_id"]}


def test_intake(spark, columns, approved):
    discovered = columns.drop("column_id").union(
        spark.createDataFrame([("ledger", "NEW", "main.ledger.positions")] * 3, columns.drop("column_id").schema)
    )
    fresh = new_columns(discovered, columns)
    assert [r.column_name for r in fresh.collect()] == ["NEW"]
    assert new_columns(discovered, columns.select("platform_id", "source_table", "column_name").union(fresh.select("platform_id", "source_table", "column_name"))).isEmpty()
    proposals = spark.createDataFrame(
        [("sc_001", "rejected"), ("sc_002", "pending_review"), ("sc_003", "flagged")], "column_id string, status string")
    none = approved.limit(0)
    assert sorted(r.column_id for r in unmapped(columns, none, proposals).collect()) == ["sc_001", "sc_003"]
    assert unmapped(columns, approved, proposals).isEmpty()
    assert mapped_columns(columns, approved.filter(F.col("column_id") == "sc_001")).count() == 1


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="not unique"):
        bm25.build_index(spark.createDataFrame([(1, "a"), (1, "b")], "id int, text string"), "id", "text")

"""What the searches and the context of prompts read, write and send."""

from fieldloom.operators import bm25, retrieval
from fieldloom.plans import prompts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_made_once_for_index_and_context(spark, monkeypatch, columns, approved, vocabulary):
    """the context reads the links that the index wrote."""
    made, written = [], {}
    real_links, real_write = retrieval.links, bm25.materialize
    for module in (retrieval, prompts):
        monkeypatch.setattr(module, "links", lambda *a: made.append(1) or real_links(*a), raising=False)
    monkeypatch.setattr(bm25, "materialize", lambda df, name: written.setdefault(name, df.columns) and real_write(df, name))
    found = prompts.retrieve(columns, columns, approved, vocabulary)
    assert len(made) == 1
    assert sorted(written["bm25-pairs"]) == ["canonical_id", "column_id", "column_name", "doc_id", "first", "platform_id", "second"]
    assert {r.canonical_id: (r.text, r.columns) for r in found.pieces.collect()} == {
        "cf_001": ('\n    - ledger: "FND_ID"\n    - books: "fund_id"', 2), "cf_005": ('\n    - ledger: "NAV_AMT"', 1)}


def test_few_bags_find_their_members_without_a_shuffle(spark):
    """documents stay where they are when few bags are wanted."""
    docs = spark.createDataFrame([(i, "a b" if i % 3 else f"c{i}") for i in range(30)], "id int, text string")
    index = bm25.build_index(docs, "id", "text")
    wanted = spark.createDataFrame([(1,), (3,)], "bag int")
    members = index.members_of(wanted)
    assert "strategy=broadcast" in plan(members) and "strategy=broadcast" not in plan(index.members_of(wanted, 1))
    want = sorted([(1, i) for i in range(30) if i % 3] + [(3, 3)])
    assert sorted(map(tuple, members.collect())) == want == sorted(map(tuple, index.members_of(wanted, 1).collect()))


def test_the_vocabulary_is_not_sent_to_every_task(spark, columns, approved, vocabulary):
    """a join that sends it would pass it through the driver."""
    asked = spark.createDataFrame([("q", "fund identifier")], "q string, text string")
    for df in (retrieval.approved_documents(columns, approved, vocabulary), retrieval.search_fields(asked, "q", "text", vocabulary)):
        assert "rightHint=(strategy=merge)" in plan(df)
        assert not df.isEmpty()

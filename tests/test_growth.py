"""What grows: an index in segments, the registry behind a key filter, tables in order."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bm25, intake, key_filter
from fieldloom.operators.ordering import running_sum
from fieldloom.operators.segments import GrowingIndex
from fieldloom.sources import ordered

KEYS = "platform_id string, source_table string, column_name string"


def test_segments_search_like_one_index(spark, tmp_path):
    rng = random.Random(2)
    words = ["fund", "name", "asset", "value", "net", "date", "trade", "owner"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for n in range(90)] + [(90, None), (91, "fund fund"), (92, "fund fund")]
    docs = spark.createDataFrame(rows, "id int, body string")
    asked = spark.createDataFrame([(1, "fund name"), (2, "net asset value net"), (3, "owner"), (4, "nothing"), (5, "fund fund")], "q int, text string")
    whole = bm25.bm25_search(asked, "q", "text", bm25.build_index(docs, "id", "body"), 7).collect()
    growing = GrowingIndex(spark, str(tmp_path / "index"))
    assert growing.index() is None
    for low, high in ((0, 40), (40, 41), (41, 92), (92, 93), (93, 99)):
        growing.add(docs.where(f"id >= {low} and id < {high}"), "id", "body")
    assert len(growing.segments()) == 4
    # Another session would open it by its folder.
    again = GrowingIndex(spark, str(tmp_path / "index")).index()
    for direct in (bm25.DIRECT_READS, 0):
        found = bm25.bm25_search(asked, "q", "text", again, 7, direct).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, whole))
    with pytest.raises(ValueError, match="indexed already"):
        growing.add(docs.where("id = 41"), "id", "body")
    (tmp_path / "index" / "segment-000009-lost").mkdir()
    assert len(growing.segments()) == 4


def test_key_filter_gives_the_same_columns(spark):
    found = spark.createDataFrame([("p", f"t{n % 40}", f"c{n}", "STRING") for n in range(600)] + [("p", "t1", "c1", "INT"), (None, "t", "x", "STRING"), ("q", None, "x", "STRING")], KEYS + ", data_type string")
    known = spark.createDataFrame([("p", f"t{n % 40}", f"c{n}") for n in range(0, 600, 10)] + [("other", f"t{n}", f"c{n}") for n in range(5000)] + [(None, "t", "x")], KEYS)
    want = sorted(map(str, intake.new_columns(found, known).collect()))
    assert sorted(map(str, key_filter.new_columns_filtered(found, known).collect())) == want
    new, open_rows, keys = key_filter.split_by_filter(found, known)
    # The exact join sees the 61 known columns and under 2 % of the others, instead of 602 rows and 5,061 keys.
    assert new.count() + open_rows.count() == 602 and 61 <= open_rows.count() < 75 and 61 <= keys.count() < 61 + 100
    for a, b in ((found, known.limit(0)), (found.limit(0), known), (found, found.select(*intake.COLUMN_KEY))):
        assert sorted(map(str, key_filter.new_columns_filtered(a, b).collect())) == sorted(map(str, intake.new_columns(a, b).collect()))
    numbers = known.select(F.lit(1).alias("platform_id"), "source_table", "column_name")
    texts = found.limit(5).withColumn("platform_id", F.lit("01"))
    assert key_filter.new_columns_filtered(texts, numbers).count() == intake.new_columns(texts, numbers).count()


def test_a_full_filter_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(key_filter, "MOST_BLOCKS", 1)
    found = spark.createDataFrame([("p", "t", f"c{n}") for n in range(200)], KEYS)
    known = spark.createDataFrame([("p", "t", f"c{n}") for n in range(100, 400)], KEYS)
    assert key_filter.split_by_filter(found, known)[0].count() == 0 and key_filter.new_columns_filtered(found, known).count() == 100


def test_ordered_tables(spark, tmp_path):
    rows = [(n * 7919 % 1000, f"row {n}", None if n % 50 == 0 else n) for n in range(1000)]
    df = spark.createDataFrame(rows, "k int, name string, v int").repartition(7)
    place = str(tmp_path / "table")
    ordered.write_ordered(df, place, [F.desc("k")])
    assert [(r.ordinal, r.k) for r in ordered.read_ordered(spark, place).orderBy("ordinal").collect()] == [(n, 999 - n) for n in range(1000)]
    assert "Exchange rangepartitioning" not in ordered.read_ordered(spark, place)._jdf.queryExecution().executedPlan().toString()
    for first, past in ((0, 3), (250, 500), (998, 2000), (None, 5), (995, None), (1000, None), (5, 5), (-4, 2)):
        got = sorted(r.ordinal for r in ordered.read_ordered(spark, place, first, past).collect())
        assert got == list(range(1000))[max(0, first or 0) : past], (first, past)
    plan = ordered.read_ordered(spark, place, 250, 260)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place" in plan and "LessThan(_place" in plan
    ordered.write_ordered(df.limit(0), str(tmp_path / "none"), ["k"])
    assert ordered.read_ordered(spark, str(tmp_path / "none")).isEmpty() and ordered.read_ordered(spark, str(tmp_path / "none"), 3, 9).isEmpty()
    ordered.write_ordered_report(df, str(tmp_path / "csv"), ["k"])
    lines = [line for f in sorted((tmp_path / "csv").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert [int(line.split(",")[0]) for line in lines] == list(range(1000))


def test_running_sums_of_hot_groups(spark):
    rows = [("hot" if n % 3 else f"g{n % 5}", n, n % 11) for n in range(900)]
    df = spark.createDataFrame(rows, "g string, n int, v long").repartition(5)
    want = {}
    for g, n, v in sorted(rows, key=lambda r: r[1]):
        want[g] = want.get(g, [])
        want[g].append((n, (want[g][-1][1] if want[g] else 0) + v))
    for floor, share in ((500_000, 5000), (50, 5000)):
        got = {}
        for r in running_sum(df, ["g"], ["n"], "v", floor=floor, share=share).collect():
            got.setdefault(r.g, []).append((r.n, r.running))
        assert {g: sorted(x) for g, x in got.items()} == want


def test_prompt_parts_join_to_the_prompt(spark, columns, approved, vocabulary, platforms):
    from fieldloom.plans.prompts import build_prompts, whole_prompts

    more = spark.createDataFrame([(f"sc_{n:04d}x", "books", f"column number {n}", "main.books.t") for n in range(400)], columns.schema)
    mapped = spark.createDataFrame([(f"am_x{n:04d}", f"sc_{n:04d}x", "cf_001", "p", "ann") for n in range(400)], "mapping_id string, column_id string, canonical_id string, proposal_id string, approved_by string")
    source, links = columns.union(more), approved.drop("approved_at").unionByName(mapped)
    headers = spark.createDataFrame([("n1", "fund_identifier", "ledger"), ("n2", "transaction date", "books"), ("n3", "zzz", "books")], "column_id string, column_name string, platform_id string")
    whole = build_prompts(headers, source, links, vocabulary, None, platforms[1]).collect()
    one = {r.column_id: r.prompt for r in whole}
    assert len(one) == len(whole) == 3 and one["n1"].count("column number") >= 400 and {r.context_pages for r in whole} == {0, 1}
    for size in (64, 1000):
        parts = build_prompts(headers, source, links, vocabulary, None, platforms[1], part_chars=size)
        rows = sorted(parts.collect(), key=lambda r: (r.column_id, r.part))
        assert {r.column_id: r.prompt for r in whole_prompts(parts).collect()} == one
        later = [r for r in rows if r.part]
        assert len(later) > 5 and (size < 1000 or max(len(r.prompt) for r in later) < size + size // 16 + 1300 + 100)
        if size == 1000:
            assert [r.part for r in rows if r.column_id == "n1"] == list(range(sum(r.column_id == "n1" for r in rows)))

import random

from pyspark.sql import functions as F

from fieldloom.operators import ordering as O


def sample(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = rng.choice(["hot"] * 5 + ["warm"] * 2 + [f"g{rng.randint(0, 60)}", None])
        rows.append((group, rng.randint(0, 40), f"id{i:05d}"))
    return rows, spark.createDataFrame(rows, "g string, t int, id string")


def expected(rows):
    groups = {}
    for g, t, i in rows:
        groups.setdefault(g, []).append((-t, i))
    return {(g, i): n + 1 for g, items in groups.items() for n, (_, i) in enumerate(sorted(items))}


def test_rank_with_and_without_hot_groups(spark):
    rows, df = sample(spark)
    order = [-F.col("t"), F.col("id")]
    for floor, share in ((500_000, 5000), (50, 40), (1, 4), (200, 3)):
        got = {(r.g, r.id): r["rank"] for r in O.rank_in_group(df, ["g"], order, floor=floor, share=share).collect()}
        assert got == expected(rows), (floor, share)


def test_hot_groups_are_few(spark):
    _, df = sample(spark)
    assert O.hot_groups(df, ["g"]) is None
    hot = O.hot_groups(df, ["g"], floor=10, share=5)
    assert 0 < hot.count() < 5


def test_pages_keep_everything_in_order(spark):
    rows, df = sample(spark)
    want = {}
    for (g, i), n in expected(rows).items():
        want.setdefault(g, {})[n] = i
    for options in ({}, {"floor": 20, "share": 30}, {"sizes": df.select("g"), "floor": 20, "share": 30}, {"sizes": df.select("g")}):
        pages = O.ordered_pages(df, ["g"], [-F.col("t"), F.col("id")], "id", 7, "ids", **options).collect()
        assert all(len(p.ids) <= 7 for p in pages)
        got = {}
        for p in sorted(pages, key=lambda p: p.page):
            got.setdefault(p.g, []).extend(p.ids)
        assert got == {g: [m[n] for n in sorted(m)] for g, m in want.items()}


def test_first_last_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in O.last_wins(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "w")}
    assert {(r.k, r.v) for r in O.first_match(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", "w")}
    top = O.top_k(df, ["k"], [F.desc("o")], 2).collect()
    assert {(r.k, r.v, r["rank"]) for r in top} == {("a", "y", 1), ("a", "z", 2), ("b", "w", 1)}
    assert [r.v for r in O.latest(df, "o", 2, "v").collect()] == ["y", "z"]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = O.top_k(df, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2

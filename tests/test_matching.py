import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.similarity import letter_counts, name_similarity, shared_letters
from fieldloom.operators import similar
from fieldloom.operators.match import exact_match, fast_match, near_match
from fieldloom.operators.review import register_fields, register_rules
from fieldloom.operators.rules import standardize_headers


def score(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.lower().split("_")), set(b.lower().split("_"))
    return len(x & y) / max(len(x), len(y)) / 2 + SequenceMatcher(None, a.lower(), b.lower()).ratio() / 2


def test_fast_match(spark):
    fields = spark.createDataFrame(
        [(1, "fund_name"), (2, "fundname"), (3, "fund_name"), (4, "date"), (5, "net_value"), (6, "netvalue_"), (7, None)],
        "canonical_id int, canonical_name string",
    )
    headers = spark.createDataFrame(
        [(1, "Fund Name"), (2, "FundName"), (3, "F_undName"), (4, "NetValue"), (5, "other"), (6, None)], "column_id int, column_name string"
    )
    named = standardize_headers(headers, "column_name")
    got = {r.column_id: (r.match_kind, r.canonical_id, r.canonical_name, r.confidence) for r in fast_match(named, fields).collect()}
    # Of equal names the last field counts; a near match takes the first name in order.
    assert got == {
        1: ("exact", 3, "fund_name", 95), 2: ("exact", 2, "fundname", 95), 3: ("near", 3, "fund_name", 90),
        4: ("near", 5, "net_value", 90), 5: (None, None, None, None), 6: (None, None, None, None),
    }
    texts = {r.column_id: r.rationale for r in fast_match(named, fields).collect()}
    assert texts[1] == "Deterministic match: 'Fund Name' standardizes to 'fund_name' which exactly matches canonical field."
    assert texts[4] == "Near-exact match: 'NetValue' standardizes to 'netvalue', matches 'net_value' after normalization."
    assert sorted(r.column_id for r in exact_match(named, fields).collect()) == [1, 2]
    assert sorted(r.column_id for r in near_match(named, fields).collect()) == [1, 2, 3, 4]


NAMES = ["fund_identifier", "fund_id", "investor_identifier", "Fund__name", "name_of_fund", "a__b", "b__a", "", "nav", "net_asset_value", "net_asset_val", "x_y_z"]


def test_similar_fields_equal_all_pairs(spark):
    names = spark.createDataFrame([(n,) for n in NAMES + ["fund_id", None]], "name string")
    fields = spark.createDataFrame([(n,) for n in reversed(NAMES)] + [("nav",)], "canonical_name string")
    for threshold in (0.6, 0.51, 0.9):
        want = {(a, b, round(score(a, b), 2)) for a in NAMES for b in NAMES if score(a, b) >= threshold}
        got = similar.similar_fields(names, fields, threshold).collect()
        assert {(r.name, r.canonical_name, r.score) for r in got} == want and len(got) == len(want)
    assert {r.fields for r in got if r.canonical_name == "nav"} == {2}
    with pytest.raises(ValueError):
        similar.similar_fields(names, fields, 0.5)


def test_letter_counts_bound_the_matching_blocks(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("aaabcde_1é日") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["a" * 30, "b" * 30, "_" * 12, "AaBb"]
    pairs = spark.createDataFrame([(a, b) for a in made for b in made], "a string, b string")
    rows = pairs.select("a", "b", shared_letters(letter_counts("a"), letter_counts("b")).alias("most")).collect()
    for r in rows:
        x, y = r.a.lower(), r.b.lower()
        blocks = sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())
        assert blocks <= r.most <= min(len(x), len(y)), r
    # Up to the bits of a letter the bound counts exactly.
    assert {r.most for r in rows if r.a == "a" * 30 and r.b == "b" * 30} == {22}
    few = [r for r in rows if all(max(map(n.lower().count, n.lower())) <= 4 for n in (r.a, r.b)) and (r.a + r.b).isascii()]
    assert few and all(r.most == sum(min(r.a.lower().count(c), r.b.lower().count(c)) for c in set(r.a.lower())) for r in few)


def test_letters_leave_fewer_pairs_and_the_same_names(spark):
    rng = random.Random(8)
    made = ["_".join(rng.sample(["fund", "name", "net", "asset", "value", "trade", "date", "owner", "zip", "quantity"], rng.randint(1, 4))) for _ in range(120)]
    names, fields = (spark.createDataFrame([(n,) for n in part], f"{c} string") for part, c in ((made[:60], "name"), (made[60:], "canonical_name")))
    plain, tight = (similar.candidate_pairs(names, fields, 0.6, letters=letters).select("a", "b").collect() for letters in (False, True))
    want = {(a, b) for a in made[:60] for b in made[60:] if score(a, b) >= 0.6}
    assert want <= set(map(tuple, tight)) <= set(map(tuple, plain)) and len(tight) < 0.6 * len(plain)
    assert {(r.name, r.canonical_name) for r in similar.similar_fields(names, fields).collect()} == want


def test_scores_round_like_their_binary_value(spark):
    """Two digits as by the exact value of the number, not by its shortest decimal form."""
    names = spark.createDataFrame([("fund_name",)], "name string")
    fields = spark.createDataFrame([("fund_date",), ("fund_type_x",), ("name_fund",)], "canonical_name string")
    got = {r.canonical_name: r.score for r in similar.similar_fields(names, fields, 0.51).collect()}
    assert got == {n: round(score("fund_name", n), 2) for n in ("fund_date", "fund_type_x", "name_fund") if score("fund_name", n) >= 0.51}


def test_common_tokens_are_joined_as_a_grid(spark):
    made = [f"fund_{w}_{i}" for i, w in enumerate(["name", "type", "date"] * 20)]
    names = spark.createDataFrame([(n,) for n in made], "name string")
    fields = spark.createDataFrame([(n.replace("type", "kind"),) for n in made], "canonical_name string")
    plain = similar.candidate_pairs(names, fields, 0.6)
    grid = similar.candidate_pairs(names, fields, 0.6, limit=5)
    assert similar._grid(similar._exploded(similar._distinct_names(names, "name", "a"), "a"),
                         similar._exploded(similar._distinct_names(fields, "canonical_name", "b"), "b"), 5).count() > 0
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, grid.collect()))


def test_name_similarity(spark):
    pairs = [(a, b) for a in NAMES for b in NAMES]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", name_similarity("a", "b"))
    assert all(abs(r.s - score(r.a, r.b)) < 1e-12 for r in df.collect())


def test_register(spark, vocabulary):
    new = spark.createDataFrame([("fund_names", "string", "d", "Fund"), ("", "string", "d", "Fund")], vocabulary.drop("canonical_id").schema)
    created, warnings, audit = register_fields(new, vocabulary, "ann")
    assert [(r.canonical_name, r.is_active, r.created_by) for r in created.collect()] == [("fund_names", True, "ann")]
    assert [r.canonical_name for r in warnings.collect()] == ["fund_name"]
    row = audit.first()
    assert (row.entity_type, row.action, row.details) == ("canonical", "created", '{"name":"fund_names"}')
    rules, log = register_rules(spark.createDataFrame([("amt", "amount", ""), ("x", "", "")], "pattern string, replacement string, description string"), "ann")
    assert [(r.pattern, r.rule_type) for r in rules.collect()] == [("amt", "abbreviation")]
    assert log.first().details == '{"pattern":"amt","replacement":"amount"}'
    assert rules.select(F.length("rule_id")).first()[0] == 32


def test_similar_names_come_best_first_and_five_warn(spark):
    taken = [f"fund_name_{c}" for c in "abcdefg"] + ["fund_name"]
    fields = spark.createDataFrame([(n,) for n in taken], "canonical_name string")
    found = similar.similar_fields(spark.createDataFrame([("fund_name",)], "name string"), fields)
    rows = [(r.canonical_name, r.score) for r in found.collect()]
    assert rows[0] == ("fund_name", 1.0) and len(rows) == 8
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    best = similar.best_similar(found).orderBy("rank").collect()
    assert [(r.canonical_name, r["rank"]) for r in best] == [(n, i + 1) for i, (n, _) in enumerate(rows[:5])]


def test_repeated_patterns_give_one_name_either_way(spark):
    headers = spark.createDataFrame([("FND_ID",)], "column_name string")
    repeated = spark.createDataFrame([("fnd", "fonds"), ("fnd", "fund"), (None, "x")], "pattern string, replacement string")
    for limit in (0, 1, 1000):
        assert [r.standardized for r in standardize_headers(headers, "column_name", repeated, limit=limit).collect()] == ["fund_id"]

"""The mix with repeated sources, and the packed sequences that follow it."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import os  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from fieldloom.llm import mixing, queries  # noqa: E402


def deviation(sources, parts):
    """The largest distance of a source from its target after any row."""
    total, sent, most = sum(parts.values()), Counter(), 0.0
    for n, source in enumerate(sources, 1):
        sent[source] += 1
        most = max(most, *(abs(sent[s] - n * p / total) for s, p in parts.items()))
    return most


@pytest.mark.parametrize("sizes", [{"a": 40, "b": 300, "c": 55}, {"a": 700, "b": 30, "c": 1}, {"a": 9, "b": 8, "c": 7, "new": 30, None: 5}])
@pytest.mark.parametrize("passes", [mixing.PASSES, 3])
def test_weights_hold_after_every_row(spark, sizes, passes, monkeypatch):
    monkeypatch.setattr(mixing, "PASSES", passes)
    parts = {"a": 6, "b": 1, "c": 2, "absent": 4}
    made = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(made, "doc_id long, source string")
    got = mixing.mix_passes(docs, parts, 8, rest_parts=2).orderBy("slot", "place").collect()
    assert sorted((r.doc_id, r.source) for r in got if r["pass"] == 0) == made
    group = lambda s: s if s in parts else "rest"
    weights = {group(s): parts.get(s, 2) for s in sizes}
    assert deviation([group(r.source) for r in got], weights) < 8
    assert len({(r.slot, r.place) for r in got}) == len(got) and all(r.release <= r.slot < r.deadline for r in got)
    times = defaultdict(list)
    for r in got:
        times[group(r.source), r.doc_id].append(r["pass"])
    assert all(sorted(v) == list(range(len(v))) for v in times.values())
    for s in weights:
        each = [len(v) for (of, _), v in times.items() if of == s]
        assert max(each) - min(each) <= 1
    periods, size = mixing.demand(Counter(group(s) for _, s in made), weights, 8)
    assert len(got) == periods * size * sum(weights.values())
    assert mixing.mix_passes(docs.limit(0), parts, 8).collect() == []


@pytest.mark.skipif(not os.path.isdir(entry_points.SMALL), reason="needs the test tables")
def test_packed_rows_follow_the_schedule(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "BLOCK_ROWS", 2)
    docs = queries.table(spark, entry_points.SMALL, "documents")
    odd = [(None, None, None, None, None), (None, None, None, None, None), (3, "an id that is there", "en", "src1", 0)]
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.packed_documents(spark, docs, entry_points.SMALL).collect()
    weights = queries.PARTS | {None: 1}
    total = sum(weights.values())
    runs, sequences = defaultdict(set), defaultdict(list)
    for r in got:
        runs[r.slot // total].add((r.slot, r.place, r.source))
        sequences[r.sequence_id].append(r)
    assert len(runs) > 2
    for placed in runs.values():
        shares = Counter(s for _, _, s in placed)
        assert len({shares[s] / p for s, p in weights.items()}) == 1
    order = [{r.slot // total for r in sequences[i]} for i in range(len(sequences))]
    assert all(len(o) == 1 for o in order) and [min(o) for o in order] == sorted(min(o) for o in order)
    for held in sequences.values():
        at = sorted((r.offset, r.length) for r in held)
        assert all(a + n <= b for (a, n), (b, _) in zip(at, at[1:])) and at[-1][0] + at[-1][1] <= queries.CAPACITY
    once = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got if r["pass"] == 0)
    want = queries.packed_documents(docs).collect()
    assert once == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)
    firsts = [min((r.slot, r.place) for r in sequences[i]) for i in range(len(sequences))]
    assert firsts == sorted(firsts)


def test_packing_takes_each_source_in_the_order_of_its_files(spark, tmp_path):
    rows = [(n * 37 % 500, f"text {n}", "en", f"src{n % 3}", 9) for n in range(500)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, order in (("up", "doc_id"), ("down", "-doc_id")):
        spark.createDataFrame(rows, schema).selectExpr("*", f"{order} AS o").repartitionByRange(12, "o").sortWithinPartitions("o").drop("o").write.parquet(str(tmp_path / name))
    found = {}
    for name in ("up", "down"):
        docs = spark.read.parquet(str(tmp_path / name))
        got = queries.mixed_sequences(docs).where("pass = 0").collect()
        found[name] = sorted(map(str, got))
        for source in {r.source for r in got}:
            sent = [r.doc_id for r in sorted((r for r in got if r.source == source), key=lambda r: (r.slot, r.place))]
            assert sent == sorted(sent, reverse=name == "down")
    assert found["up"] != found["down"]


@pytest.mark.skipif(not os.path.isdir(entry_points.SMALL), reason="needs the test tables")
def test_every_stage_changes_the_rows(spark, tmp_path):
    docs = queries.table(spark, entry_points.SMALL, "documents")
    long = docs.where("n_chars > 900 and n_chars < 4000").orderBy("doc_id").limit(4).collect()
    more = [(10_000 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(long)] + [(20_000 + i, r.text + " ", r.lang, r.source, r.n_chars) for i, r in enumerate(long)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "start"))

    def through(names, at):
        for name in names:
            frame = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(at), entry_points.SMALL)
            at = f"{at}-{name}"
            if not os.path.isdir(at):
                frame.write.parquet(at)
        return at

    names = [name for name, _ in corpus_pipeline.STAGES]
    rows = lambda at: sorted(str(r) for r in spark.read.parquet(at).drop("sequence_id").collect())
    whole = rows(through(names, str(tmp_path / "start")))
    for left_out in names[:-1]:
        assert rows(through([n for n in names if n != left_out], str(tmp_path / "start"))) != whole, left_out


def test_exact_copies_leave_one_row(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "de", "t", 1), (2, "a", "en", "s", 1), (2, "a", "en", "s", 1), (None, "b", "en", "s", 1), (None, "b", "en", "s", 1),
            (3, None, "en", "s", 0), (3, "", "fr", "s", 0), (4, "c", "en", "s", 1), (4, "d", "en", "s", 1), (None, "c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.distinct_documents(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "b"), (2, "a"), (3, ""), (4, "c"), (4, "d")]
    assert corpus_pipeline.distinct_documents(spark, docs.limit(0), "").count() == 0

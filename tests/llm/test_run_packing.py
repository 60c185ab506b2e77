"""Runs are packed by the steps of the method, and license scans cut the words of a text once."""

import pytest

pytest.importorskip("public_tokenizers")

import random  # noqa: E402

from fieldloom.llm import license_scan, packing  # noqa: E402


def test_runs_are_packed_from_counts(spark):
    rng = random.Random(3)
    rows = [(run, i, rng.choice([1, 3, 7, 10, 10, rng.randint(1, 10)])) for run in (0, 1, 5) for i in range(rng.randint(1, 200))]
    pieces = spark.createDataFrame(rows, "run long, i long, length long")
    got = packing.pack_runs(pieces, 10, "run", ("i",))
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString(), "the pieces are matched by Spark"
    got = got.collect()
    assert sorted((r.run, r.i, r.length) for r in got) == sorted(rows)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append(r)
    assert sorted(at) == list(range(len(at)))
    for held in at.values():
        places = sorted((r.offset, r.length) for r in held)
        assert len({r.run for r in held}) == 1 and places[0][0] == 0 and sum(n for _, n in places) <= 10
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    firsts = [min((r.run, r.i) for r in at[s]) for s in sorted(at)]
    assert firsts == sorted(firsts)
    for run in (0, 1, 5):
        counts = {}
        for r, _, n in rows:
            if r == run:
                counts[n] = counts.get(n, 0) + 1
        most = max(p.sequence + -(-p.pieces // p.each) for p in packing.best_fit(counts, 10))
        assert len({r.sequence_id for r in got if r.run == run}) == most
    assert packing.pack_runs(pieces.limit(0), 10, "run", ("i",)).collect() == []
    for bad in (0, 11):
        with pytest.raises(Exception, match="piece without tokens"):
            packing.pack_runs(spark.createDataFrame([(0, 1, bad)], pieces.schema), 10, "run", ("i",)).collect()


def test_words_are_cut_once(spark, monkeypatch):
    cut, real = [], license_scan.words_of
    monkeypatch.setattr(license_scan, "words_of", lambda text: cut.append(1) or real(text))
    rows = [(1, "Under the MIT license. under the mit license"), (2, None), (3, "two words"), (None, "x cc by nc"), (None, "x cc by nc")]
    got = license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in got} == {
        (1, 8, 2, 0, 4, "mit"), (2, 0, 0, None, None, ""), (3, 2, 0, None, None, ""), (None, 4, 1, 1, 1, "cc-by-nc")}
    assert len(got) == 5 and len(cut) == 1

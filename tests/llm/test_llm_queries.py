"""The registered queries on the smallest tables, and the pipeline's stages against brute force."""

import os

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from check import canonical  # noqa: E402
from fieldloom.llm import queries, simhash  # noqa: E402
from workbench.roles import TABLES  # noqa: E402

FOLDER = entry_points.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_registered():
    assert [f"op{n}" for n in range(1, 14)] == [name.split("_")[0] for name in queries.QUERIES if name != "mixing_once"]
    assert {*queries.QUERIES, "pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check_sql(spark, name):
    base = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = base.execute(queries.CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), columns)


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (10**9, "", "en", "src1", 0)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    columns, held = docs.columns, {}
    docs = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert name == "pack" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = (before.collect(), docs.collect())
    before, after = held["exact"]
    texts = [r.text or "" for r in after if r.doc_id is not None]
    best = {}
    for r in before:
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert len(set(texts)) == len(texts) and {r.doc_id for r in after} - {None} == set(best.values()) - {-1}
    before, after = held["near"]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in before}
    root = {d: d for d in prints}
    find = lambda d: d if root[d] == d else find(root[d])
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in after} == {d for d in prints if find(d) == d}
    before, after = held["mix"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    before, after = held["pack"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    empty = spark.read.parquet(str(tmp_path / "near")).limit(0)
    assert all(stage(spark, empty, FOLDER).count() == 0 for stage in stages.values())

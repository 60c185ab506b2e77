"""Folders without scheme, hot ids in token files, hosts of very many labels."""

import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from fieldloom.llm import places, token_files, tokens, url_filter  # noqa: E402


def test_folders_are_named_as_spark_resolves_them(spark, tmp_path):
    assert places.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == places.qualified(spark, f"file:{tmp_path}") == places.qualified(spark, tmp_path.as_uri())
    files, path = places.opened(places.qualified(spark, str(tmp_path)))
    assert path == str(tmp_path) and files.get_file_info(path).is_file is False
    assert [places.with_slashes(u) for u in ("hdfs://name/a", "viewfs:/in", "/a")] == ["hdfs://name/a", "viewfs:///in", "/a"]


def test_many_rows_of_one_id_are_dealt_over_files(spark, tmp_path):
    rows = [(None if n % 3 else 7, f"{n % 50} text {n}") for n in range(600)] + [(9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 4 and max(n for _, n, _ in files) < 300
    encode = tokens.encoder(public_tokenizers.path("word_bpe_49k.json")).encode
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(t) + tokens.packed([1])
        want.append((i, start, ids))
        start += len(ids) // 4
    got = token_files.read_token_files(spark, str(tmp_path / "t"), files)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(((r[0], r[1], bytes(r[2])) for r in got.collect()), key=lambda r: r[1]) == want
    assert not list((tmp_path / "t").glob(".*.crc")) and not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(".")]


def test_hosts_of_very_many_labels(spark):
    listed = spark.createDataFrame([("example.org/", 0, "block"), ("a.b.example.org/x", 0, "allow"), ("org/y", 0, "allow")], "entry string, kind int, verdict string")
    hosts = ["a." * 40_000 + "example.org", "." * 40_000, "x." * 20_000 + "a.b.example.org", "org", "example.org", "b.example.org"]
    pages = spark.createDataFrame([(n, f"http://{h}/x{n}") for n, h in enumerate(hosts)], "page_id long, url string")
    url_filter.judge_urls(pages.limit(1), listed).count()
    start = time.time()
    got = {r.page_id: (r.entry, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert time.time() - start < 30
    assert got == {0: ("example.org/", "block"), 1: (None, "allow"), 2: ("a.b.example.org/x", "allow"), 3: (None, "allow"), 4: ("example.org/", "block"), 5: ("example.org/", "block")}

"""The operators for training data against brute force, with the awkward rows that each must survive."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fieldloom.llm import components, exact_dedup, license_scan, line_rules, mixing, packing, quality_model, simhash, token_files, tokens, toxicity, url_filter  # noqa: E402

LONG = "Long sentence with some words in it, over and over. " * 4000
ROWS = [
    (1, "Same text here. Twice.", "src0"), (2, "Same text here. Twice.", "src0"), (2, "Same text here. Twice.", "src0"), (None, "Same text here. Twice.", None),
    (3, None, "src1"), (4, "", "src1"), (5, LONG, "src2"), (6, "Released under the MIT License. Under\nthe mit license", "src9"),
    (7, "É K\u212A \u0130 \ud7ff \U0001f600 x", "nowhere"), (8, "  \n\t ", None), (None, None, None),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, kept string, score string, sequence_id string, fingerprint string, host string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "a", "b", "c", "d", "e") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    made = tokens.Encoder(public_tokenizers.path(name))
    whole = lambda t: tokens.packed(made.tokenizer.encode(t, add_special_tokens=False).ids)
    chars = [chr(c) for c in tokens.PLAIN]
    for c in chars:
        for text in (f"a{c}b", f" {c} ", f"{c}{c}1{c}", f"{c}'s{c}'S A{c}", f"1{c}2 {c}  {c}a"):
            assert made.encode(text) == whole(text), hex(ord(c))
    random.seed(1)
    for _ in range(3000):
        text = "".join(random.choice(chars if random.random() < 0.2 else " ab'st1.\n\t  ,") for _ in range(random.randint(0, 12)))
        assert made.encode(text) == whole(text)
    for _, text, _ in ROWS:
        assert made.encode(text) == whole(text or "")
    long = "ab" * 500
    assert made.encode(f"{long} {long}") == whole(f"{long} {long}") and max(map(len, made.pieces)) <= tokens.KEPT_LENGTH
    assert made.encode("a <|endoftext|> b") == whole("a <|endoftext|> b")


def test_url_filter(spark):
    listed = spark.createDataFrame(
        [("org/", 0, "allow"), ("example.org/es/", 0, "block"), ("example.org/en/1", 0, "block"), ("com/fr/", 0, "allow"), ("com/de/", 0, "block"), ("x.com/de/", 1, "allow"), (None, 0, "block")],
        "entry string, kind int, verdict string",
    )
    urls = [
        None, "", "no scheme", "http://Example.ORG/en/17?x#y", "https://a.example.org/en/2", "https://notexample.org/es/1", "http://example.org", "a://x.com/de/", "a://x.com/de",
        "http://.com/fr/", "http://b://org/", "http://é.com/fr/é\nx", "http://EXAMPLE.org/es/", "http://EXAMPLE.org/es/",
    ]
    pages = spark.createDataFrame([(i if i else None, u, "p", "q") for i, u in enumerate(urls)], "page_id long, url string, verdict string, entry string")

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        best = (None, None, "allow")
        for entry, kind, verdict in [tuple(r) for r in listed.collect() if r[0]]:
            h, p = entry.split("/", 1)
            if f".{host}".endswith(f".{h}") and path.startswith("/" + p) and (best[0] is None or (-kind, len(entry)) > (-best[1], len(best[0]))):
                best = (entry, kind, verdict)
        return host, path, *best

    got = rows(url_filter.judge_urls(pages, listed))
    assert Counter(got) == Counter((i if i else None, *brute(u)) for i, u in enumerate(urls))
    assert rows(url_filter.judge_urls(pages.limit(0), listed)) == []
    assert {r[-1] for r in rows(url_filter.judge_urls(pages, listed.limit(0)))} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("entry"))
    bloom = url_filter.bloom_blocks(listed, 100).withColumnRenamed("_block", "b")
    hit = F.expr(f"b = {url_filter._block('entry', 100)}")
    for word in range(4):
        hit = hit & F.expr(f"(_w{word} & {url_filter._bit('entry', word)}) != 0")
    assert listed.join(bloom, hit, "left_semi").count() == 3000
    assert listed.withColumn("entry", F.concat("entry", F.lit("x"))).join(bloom, hit, "left_semi").count() < 1500


def test_exact_groups(docs, nothing):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t, _ in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, sha(t))] += 1
    assert Counter(rows(exact_dedup.exact_groups(docs, hash_all=True))) == want
    lazy = rows(exact_dedup.exact_groups(docs))
    assert Counter(r[:4] for r in lazy) == Counter({k[:4]: v for k, v in want.items()})
    assert rows(exact_dedup.exact_groups(nothing)) == []


def test_best_fit_is_best_fit_decreasing():
    for seed in range(120):
        random.seed(seed)
        capacity = random.choice([1, 5, 16, 64, 2048])
        counts = Counter(random.randint(1, capacity) for _ in range(random.randint(0, 300)))
        there, got = {}, Counter()
        for p in packing.best_fit(dict(counts), capacity):
            for i in range(p.pieces):
                there.setdefault(p.sequence + i // p.each, []).append((p.offset + i % p.each * p.length, p.length))
                got[p.length] += 1
        assert got == counts
        for held in there.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
            assert end <= capacity
        gaps = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else capacity) - length)
        assert len(gaps) == len(there)


def test_packing(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = packing.token_pieces(docs, path, 256, 0)
    packed = packing.pack(made, 256).collect()
    encode = tokens.encoder(path).encode
    assert Counter((r.doc_id, r.piece) for r in packed)[(2, 0)] == 2
    text = {i: t for i, t, _ in ROWS}
    for key in {r.doc_id for r in packed} - {None, 2}:
        mine = sorted((r for r in packed if r.doc_id == key), key=lambda r: r.piece)
        assert b"".join(r.ids for r in mine) == encode(text[key]) + bytes(4)
        assert [r.length for r in mine[1:]] == [256] * (len(mine) - 1)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held[:-1]])) and sum(n for _, n in held) <= 256
    assert rows(packing.pack(packing.token_pieces(nothing, path, 256, 0), 256)) == []
    with pytest.raises(ValueError):
        packing.pack(made, 100)


def test_mixing_stays_within_one_block(spark, docs, nothing):
    for parts in ({"a": 6, "b": 1, "c": 1, "d": 2}, {"a": 1}, {"x": 3, "y": 5, "z": 7}):
        total, sent = sum(parts.values()), Counter()
        for n, (source, _, release, due, slot) in enumerate(sorted(mixing.period(parts), key=lambda b: b[4])):
            assert slot == n and release <= slot < due
            sent[source] += 1
            assert all(abs(sent[s] - p * (n + 1) / total) < 1 for s, p in parts.items())
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'a' else 'b' end").alias("source"))
    got = sorted(rows(mixing.mix(made, {"a": 1, "b": 2}, 16, 3000).select("slot", "place", "doc_id", "source", "block")))
    order = lambda s: sorted((i for i in range(3000) if (i % 3 == 0) == (s == "a")), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    for s in "ab":
        assert [r[2] for r in got if r[3] == s] == order(s)
    assert len({r[:2] for r in got}) == 3000
    odd = rows(mixing.mix(docs, {"src0": 2, "src1": 1}, 2, len(ROWS)))
    assert Counter((r[0], r[1]) for r in odd) == Counter((i, s) for i, _, s in ROWS)
    assert {r[1] for r in odd if r[5] is None} == {None, "src2", "src9", "nowhere"}
    assert rows(mixing.mix(nothing, {"src0": 1}, 2, 0)) == []


def test_token_files(spark, docs, nothing, tmp_path):
    path, encode = public_tokenizers.path("word_bpe_49k.json"), None
    files = token_files.write_token_files(docs, str(tmp_path / "a"), path, 1)
    encode, start, want = tokens.encoder(path).encode, 0, []
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = encode(t) + tokens.packed([1])
        want.append((i, start, ids))
        start += len(ids) // 4
    got = sorted((tuple((r[0], r[1], bytes(r[2]))) for r in token_files.read_token_files(spark, str(tmp_path / "a"), files).collect()), key=lambda r: r[1])
    assert got == want
    some = rows(token_files.read_token_files(spark, (tmp_path / "a").as_uri(), files, {5, 8}))
    assert {(r[0], bytes(r[2])) for r in some} == {(r[0], r[2]) for r in want if r[0] in (5, 8)}
    assert token_files.write_token_files(nothing, str(tmp_path / "b"), path, 1) == []
    assert rows(token_files.read_token_files(spark, str(tmp_path / "b"), [])) == []


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 8)
    held = [(i, struct.pack(f"<{n}I", *range(n))) for i, n in enumerate([3, 4, 20, 0, 1, 8, 9])]
    for doc, ids in held:
        writer.add(doc, ids)
    writer.close()
    data = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(i for _, i in held)
    reader = token_files.FrameReader(pa.BufferReader(data))
    assert [(d, i) for _, d, _, i in reader.read()] == held
    one = token_files.FrameReader(pa.BufferReader(data))
    assert [i for *_, i in one.read({1})] == [held[1][1]] and one.decompressed == 1
    damaged = bytearray(data)
    damaged[int(reader.file_at[1]) - 1] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(pa.BufferReader(bytes(damaged))).read())


def test_license_report(spark, docs, nothing):
    import re

    texts = [t for _, t, _ in ROWS] + [
        "under the mit license under the mit license", "under the mit licence", "CC BY-NC 4.0, cc by\nnc!", "Apache License, Version 2.0. apache license version 2", "cc by",
        "You can redistribute it and/or modify it, friend, under the terms of the GNU General Public License", "UNDER THE M\u0130T LICENSE", "under the mit license\u212A", "x" * 50000 + " cc by nc",
    ]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = Counter()
    for i, t in [*enumerate(texts), (0, texts[0])]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want[(i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))] += 1
    got = rows(license_scan.license_report(made))
    assert Counter(r[:6] for r in got) == want
    labels = {r[0]: r[6] for r in got}
    assert labels[len(ROWS) + 5] == "gpl" and all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1 for r in got)
    assert license_scan.license_report(docs).count() == len(ROWS) and rows(license_scan.license_report(nothing)) == []


def _brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _brute_roots(points):
    root = np.arange(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3)
        simhash._link(root, np.full(len(near), i), near)
    return root


def test_fingerprints():
    for _, text, _ in ROWS:
        assert simhash.fingerprint(text) == _brute_fingerprint(text)


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 300])
def test_vantage_point_trees_lose_no_pair(spark, monkeypatch, cell_rows):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = [c ^ (np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64)).sum(axis=1).astype(np.uint64) for n, c in zip(range(20, 420, 10), centres, strict=True) for k in (1, 2, 4)]
    points = np.unique(np.concatenate([*near, np.arange(800, dtype=np.uint64) << np.uint64(33), rng.integers(0, 2**63, 3000).astype(np.uint64)]))
    want, root = _brute_roots(points), np.arange(len(points))
    monkeypatch.setattr(simhash, "SHARD_ROWS", 700)
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    distinct = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long")
    found = rows(simhash.near_links(distinct, len(points)))
    number = {int(p): i for i, p in enumerate(points.view(np.int64))}
    simhash._link(root, np.array([number[a] for a, _ in found]), np.array([number[b] for _, b in found]))
    assert (root == want).all()


def test_near_duplicates(spark, docs, nothing):
    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "other"]), " ".join(base[::-1]), None, "", "one", "One", "un", " ".join(base)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = np.array([_brute_fingerprint(t) for t in texts], np.uint64)
    distinct = np.unique(prints)
    roots = _brute_roots(distinct)[np.searchsorted(distinct, prints)]
    want = {i: min(j for j in range(len(texts)) if roots[j] == roots[i]) for i in range(len(texts))}
    assert {r[0]: r[2] for r in rows(simhash.near_duplicates(made))} == want
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert rows(simhash.near_duplicates(nothing)) == []


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(-500, 500), random.randint(-500, 500)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in root if find(x) != x}
    assert set(rows(components.components(spark.createDataFrame(edges, "a long, b long")))) == want


def test_line_rules(docs, nothing):
    random.seed(5)
    for _ in range(200):
        words = [random.choice("abc") for _ in range(random.randint(0, 60))]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert line_rules.repeated_words(words) == len(covered)
    got = line_rules.judge("A b#.\n\n A b#.\nA b#.\r\n\u00a0é|")
    assert got[:4] == (7, 15, 4, 0)
    good = "\n".join(f"Here {i} is one plain sentence, numbered {i}." for i in range(5))
    assert line_rules.judge(good)[5:7] == (False, True) and line_rules.judge(good)[8] == good
    menu = good + "\n" + "\n".join(f"Home{i} | About{i} | News{i} | Shop{i} | Contact | Privacy policy | Terms" for i in range(9))
    assert line_rules.judge(menu)[5:7] == (False, False) and line_rules.judge(menu)[8] == good
    out = line_rules.judge_lines(docs)
    assert out.columns == ["doc_id", *[f.split()[0] for f in line_rules.REPORT.split(", ")]]
    assert Counter(r[0] for r in rows(out)) == Counter(r[0] for r in ROWS) and rows(line_rules.judge_lines(nothing)) == []
    assert {r[-3] for r in rows(out) if r[0] in (3, 4, 8)} == {False}


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("aeioustrn") for _ in range(random.randint(2, 7)))
    texts, labels = [], []
    for i in range(900):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = " ".join(word() for _ in range(random.randint(30, 80))) + "."
        if i % 5 == 0:
            text += " The women and the muslim men were there."
        if toxic:
            text += " You stupid idiot women scum." if i % 8 == 0 else " Such worthless scum and a stupid idiot."
        texts.append((i, text.replace(" ", " ### ") if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (5000, None, None)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _held(labels):
    return labels.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(True)))


def test_quality_model(labelled, docs, nothing):
    texts, labels = labelled
    model = quality_model.train(texts, _held(labels))
    got = dict(rows(quality_model.score_quality(texts, model)))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    every = rows(quality_model.score_quality(docs, model))
    assert len(every) == len(ROWS) and all(0 <= s <= 1 for _, s in every) and rows(quality_model.score_quality(nothing, model)) == []
    constant = quality_model.train(texts, labels.limit(0))
    assert {s for _, s in rows(quality_model.score_quality(docs, constant))} == {0.5}


def test_toxicity_model(labelled, docs, nothing, monkeypatch):
    texts, labels = labelled
    monkeypatch.setattr(toxicity, "Z", 2.0)
    model = toxicity.train(texts, _held(labels))
    got = dict(rows(toxicity.score_toxicity(texts, model)))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    weight = lambda m: max(abs(m.weights.get(t, 0.0)) for t in ("women", "men", "muslim"))
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.train(texts, _held(labels))
    assert weight(model) < 0.3 * weight(plain)
    assert toxicity.chance(model, ["The women and the gay men came home."])[0] < 0.5
    every = rows(toxicity.score_toxicity(docs, model))
    assert len(every) == len(ROWS) and all(0 <= s <= 1 for _, s in every) and rows(toxicity.score_toxicity(nothing, model)) == []
    assert {s for _, s in rows(toxicity.score_toxicity(docs, toxicity.train(texts, labels.limit(0))))} == {0.5}

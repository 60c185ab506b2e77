"""Runs of repeated words against a search of all periods at all places."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from fieldloom.llm import periodic_runs as runs  # noqa: E402


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at:
                length = end - at + q
                if length >= max(6, 4 * q):
                    found.setdefault((at, length), q)
                at = end
            else:
                at += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def numbered(words):
    return np.unique(np.array(words), return_inverse=True)[1]


def cases():
    rng = random.Random(7)
    yield from ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, list("ab") * 4, list("ab") * 3, list("abcabcabcab"), list("abcabcabcabc"))
    for _ in range(1500):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(words))
            words[at:at] = (block * rng.randint(2, 9))[: rng.randint(1, 90)]
        yield words
    block = [str(rng.randint(0, 3)) for _ in range(700)]
    yield block * 5 + ["x"] + block[:300]


def test_all_runs_of_any_words():
    for words in cases():
        assert runs.find_runs(numbered(words), len(words)) == brute(words), words


def test_many_pairs_stay_few_extensions(monkeypatch):
    calls = []
    plain = runs._equal_until
    monkeypatch.setattr(runs, "_equal_until", lambda *a: calls.append(1) or plain(*a))
    assert runs.find_runs(np.zeros(200_000, np.int64), 200_000) == [(0, 200_000, 1)]
    assert len(calls) == 2


def test_operator(spark):
    odd = [(1, None), (2, ""), (2, ""), (None, "a b " * 5), (3, " \x0b\n\t"), (4, "x y " * 7 + "z"), (5, "wort " * 70_000)]
    rng = random.Random(3)
    odd += [(10 + n, " ".join(w)) for n, w in enumerate(list(cases())[5:60])] + [(99, " ".join(rng.choice("ab") for _ in range(900)))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in odd], "doc_id long, text string, runs string, collapsed string")
    rows = runs.periodic_runs(docs.repartition(3)).collect()
    want = []
    for i, t in odd:
        words = (t or "").encode().split()
        found = [(0, 70_000, 1)] if i == 5 else brute(words)
        want.append((i, [tuple(r) for r in found], "wort" if i == 5 else b" ".join(kept(words, found)).decode()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_texts_searched_together():
    texts = [(n, " ".join(w)) for n, w in enumerate(cases()) if n < 200]
    words = [t.encode().split() for _, t in texts]
    whole = list(runs._searched(words))
    assert whole == [brute(w) for w in words]

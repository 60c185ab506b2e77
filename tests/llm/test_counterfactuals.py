"""Counterfactuals of whole terms, with their beginnings, in all languages of the corpus."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from fieldloom.llm import toxicity  # noqa: E402

AIMED = {"en": ["women", "muslims", "immigrants"], "fr": ["musulmans", "immigrés"], "de": ["frauen", "flüchtlinge"], "es": ["mujeres", "musulmanes"]}


def test_leaving_takes_the_beginnings_along():
    features = toxicity.words("The women and the womenfolk met muslims.")
    assert toxicity.leaving(features) == {"women": {"women"}, "muslims": {"muslims", "musl~", "musli~"}}
    listed = sorted(features | toxicity.words("christians"))
    number = {w: i for i, w in enumerate([*listed, *sorted(toxicity.TERMS - set(listed))])}
    row = [number[w] for w in features]
    gone = {t: sorted(number[w] for w in ws) for t, ws in toxicity.leaving(features).items()}
    named = [({w for w in number if number[w] in a}, {w for w in number if number[w] in b}) for a, b in toxicity._swaps(row, gone, number)]
    assert ({"muslims", "musl~", "musli~"}, {"christians", "chri~", "chris~"}) in named
    assert ({"muslims", "musl~", "musli~"}, set()) in named and ({"women"}, {"girl"}) in named
    every = set(features)
    for a, b in named:
        assert a <= every and not b & (every - a)


def test_neutral_mentions_score_low(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(toxicity, "Z", 2.0)
    word = lambda: "".join(random.choice("aeioustrn") for _ in range(random.randint(2, 7)))
    aimed = sorted(w for words in AIMED.values() for w in words)
    texts = []
    for i in range(1200):
        body = " ".join(word() for _ in range(random.randint(20, 40)))
        if i % 3 == 0:
            body += f" {random.choice(['idiot', 'scum']) if i % 2 else word()} {random.choice(aimed)}"
        texts.append((i, body))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.train(docs, labels)
    bodies = [" ".join(word() for _ in range(30)) for _ in range(20)]
    for words in AIMED.values():
        neutral = [f"{body} {w}" for body in bodies for w in words]
        before, after = np.array(toxicity.chance(plain, neutral)), np.array(toxicity.chance(model, neutral))
        assert (before >= 0.5).mean() > 0.9 and (after >= 0.5).mean() < 0.05, (before, after)
        assert after.mean() < 0.5 * before.mean()
    toxic = [f"{body} scum {w}" for body in bodies for w in aimed]
    assert (np.array(toxicity.chance(model, toxic)) >= 0.5).mean() > 0.9

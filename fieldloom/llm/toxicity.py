"""Toxicity classifier, regularised by counterfactuals.

A logistic model over the words and word beginnings of a text that tell the labels apart. Words that name a group of people are evidence of
nothing by themselves, yet a plain fit gives them weight wherever abuse is aimed at groups. So each labelled text with
such a term is paired with counterfactuals that swap the term for another of its kind or leave it out, and the fit adds
a penalty on the squared change of the score's logit over these pairs. Both sides of a pair have the features of their
whole texts: a term's beginnings go with it, unless another word of the text has them too, and come with the other.

Words are counted by Spark over the labelled sample, FIT_ROWS rows; the driver gets the words that pass a test and, for
each sampled text, which of them it has.
"""

from __future__ import annotations

import math
import re
from array import array
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.quality_model import fit_rows
from fieldloom.session import materialize

#: Words the model may use, and the least z-score of the difference between the labels.
WORDS, Z = 4_000, 4.0
#: Weight of the counterfactual penalty and of the squared weights, per row.
COUNTERFACTUAL, RIDGE, STEPS = 4.0, 1e-4, 60
#: Letters of the beginnings that count as words of their own.
BEGINNINGS = (4, 5)
#: Fixed: terms that name groups of people, by kind and language. A term is swapped for others of its list.
IDENTITY = {
    "gender": ["woman", "women", "man", "men", "female", "male", "girl", "boy", "transgender", "nonbinary"],
    "faith": ["muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "sikh", "atheist", "atheists"],
    "orientation": ["gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"],
    "origin": ["african", "american", "asian", "arab", "arabs", "european", "mexican", "mexicans", "chinese", "indian", "latino", "latina", "immigrant", "immigrants", "refugee", "refugees", "black", "white"],
    "ability": ["disabled", "deaf", "blind", "autistic"],
    "age": ["old", "young", "elderly", "teenager"],
    "gender_fr": ["femme", "femmes", "homme", "hommes", "fille", "filles", "garçon", "garçons", "transgenre", "transgenres"],
    "faith_fr": ["musulman", "musulmans", "musulmane", "musulmanes", "chrétien", "chrétiens", "chrétienne", "juif", "juifs", "juive", "juives", "hindou", "hindous", "bouddhiste", "bouddhistes", "athée", "athées"],
    "orientation_fr": ["gai", "gais", "gay", "lesbienne", "lesbiennes", "bisexuel", "bisexuels", "homosexuel", "homosexuels", "hétérosexuel", "hétérosexuels"],
    "origin_fr": ["africain", "africains", "africaine", "américain", "américains", "asiatique", "asiatiques", "arabe", "arabes", "européen", "européens", "mexicain", "mexicains", "chinois", "indien", "indiens", "immigré", "immigrés", "réfugié", "réfugiés", "noir", "noirs", "blanc", "blancs"],
    "ability_fr": ["handicapé", "handicapés", "sourd", "sourds", "aveugle", "aveugles", "autiste", "autistes"],
    "age_fr": ["vieux", "vieille", "jeune", "jeunes", "âgé", "âgés", "adolescent", "adolescents"],
    "gender_de": ["frau", "frauen", "mann", "männer", "mädchen", "junge", "jungen", "weiblich", "männlich", "transgender"],
    "faith_de": ["muslim", "muslime", "muslimin", "moslem", "moslems", "christ", "christen", "jude", "juden", "jüdin", "jüdisch", "hindu", "hindus", "buddhist", "buddhisten", "atheist", "atheisten"],
    "orientation_de": ["schwul", "schwule", "schwulen", "lesbisch", "lesbe", "lesben", "bisexuell", "homosexuell", "homosexuelle", "heterosexuell", "heterosexuelle"],
    "origin_de": ["afrikaner", "amerikaner", "asiate", "asiaten", "araber", "europäer", "mexikaner", "chinese", "chinesen", "inder", "türke", "türken", "einwanderer", "migrant", "migranten", "flüchtling", "flüchtlinge", "schwarze", "schwarzen", "weiße", "weißen"],
    "ability_de": ["behindert", "behinderte", "behinderten", "gehörlos", "gehörlose", "taub", "blind", "blinde", "autist", "autisten"],
    "age_de": ["alt", "alte", "alten", "jugendliche", "jugendlichen", "senior", "senioren", "rentner"],
    "gender_es": ["mujer", "mujeres", "hombre", "hombres", "niña", "niñas", "niño", "niños", "transgénero"],
    "faith_es": ["musulmán", "musulmanes", "musulmana", "musulmanas", "cristiano", "cristianos", "cristiana", "judío", "judíos", "judía", "judías", "hindú", "hindúes", "budista", "budistas", "ateo", "ateos"],
    "orientation_es": ["gay", "gais", "lesbiana", "lesbianas", "bisexual", "bisexuales", "homosexual", "homosexuales", "heterosexual", "heterosexuales"],
    "origin_es": ["africano", "africanos", "americano", "americanos", "asiático", "asiáticos", "árabe", "árabes", "europeo", "europeos", "mexicano", "mexicanos", "chino", "chinos", "indio", "indios", "latino", "latinos", "inmigrante", "inmigrantes", "refugiado", "refugiados", "negro", "negros", "blanco", "blancos"],
    "ability_es": ["discapacitado", "discapacitados", "sordo", "sordos", "ciego", "ciegos", "autista", "autistas"],
    "age_es": ["viejo", "viejos", "vieja", "joven", "jóvenes", "anciano", "ancianos", "adolescente", "adolescentes"],
}
TERMS = {term for kind in IDENTITY.values() for term in kind}
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case, and their beginnings, marked by `~`; null counts as empty.

    Abuse is inflected and compounded, so a beginning of four or five letters of a longer word is a feature too.
    """
    return with_beginnings(set(_WORD.findall((text or "").lower())))


def with_beginnings(found: set[str]) -> set[str]:
    return found.union(*({w[:n] + "~" for w in found if len(w) > n} for n in BEGINNINGS))


class Model(NamedTuple):
    base: float
    weights: dict[str, float]


def leaving(features: set[str]) -> dict[str, set[str]]:
    """For each term of a text with these features: the features that the text loses if the term is left out."""
    full = {w for w in features if not w.endswith("~")}
    return {term: features - with_beginnings(full - {term}) for term in full & TERMS}


def _swaps(row: list[int], gone: dict[str, list[int]], number: dict[str, int]) -> list[tuple[list[int], list[int]]]:
    """(features that go, features that come) for each counterfactual of a text; `gone` says what goes with a term."""
    here, out = set(row), []
    for kind in IDENTITY.values():
        for term in gone.keys() & set(kind):
            rest = here.difference(gone[term])
            out.append((gone[term], []))
            out += [
                (gone[term], [number[w] for w in sorted(with_beginnings({other})) if w in number and number[w] not in rest])
                for other in kind if other != term and number[other] not in here
            ]
    return out


def counterfactuals(texts: list[list[int]], gone: list[dict[str, list[int]]], number: dict[str, int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of pairs, pair, feature, sign) of all features that go (1) or come (-1); nine bytes an entry, no lists kept."""
    pairs, at, word, sign = 0, array("i"), array("i"), array("b")
    for text, going in zip(texts, gone, strict=True):
        for less, more in _swaps(text, going, number) if going else ():
            at.extend([pairs] * (len(less) + len(more)))
            word.extend(less)
            word.extend(more)
            sign.extend([1] * len(less) + [-1] * len(more))
            pairs += 1
    return pairs, np.array(at, np.int32), np.array(word, np.int32), np.array(sign, np.int8)


def fit(texts: list[list[int]], gone: list[dict[str, list[int]]], label: np.ndarray, listed: list[str]) -> Model:
    """Learn from texts as numbers of the words in `listed`; `gone` has what each text loses with a term. Without texts of both labels the model is a constant."""
    positive = (label.sum() + 0.5) / (len(label) + 1)
    base = float(np.log(positive / (1 - positive)))
    if len(label) == 0 or label.min() == label.max() or not listed:
        return Model(base, {})
    size, number = len(listed), {w: i for i, w in enumerate(listed)}
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    columns = np.fromiter((w for t in texts for w in t), np.int64, len(rows))
    pairs, at, word, sign = counterfactuals(texts, gone, number)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        logit = w[-1] + np.bincount(rows, w[columns], len(texts))
        chance = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        value = np.logaddexp(0, np.where(label > 0, -logit, logit)).mean() + RIDGE * (w[:-1] ** 2).sum() / 2
        miss = (chance - label) / len(label)
        slope = np.append(np.bincount(columns, miss[rows], size) + RIDGE * w[:-1], miss.sum())
        if pairs:
            change = np.bincount(at, w[word] * sign, pairs)
            value += COUNTERFACTUAL * (change**2).mean() / 2
            slope[:-1] += COUNTERFACTUAL * np.bincount(word, sign * change[at], size) / pairs
        return float(value), slope

    w = _descend(loss, np.append(np.zeros(size), base))
    return Model(float(w[-1]), {listed[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:-1]) > 1e-6)})


def _descend(loss, w: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS * 5):
        direction, saved = slope.copy(), []
        for s, y in reversed(past):
            a = s @ direction / (s @ y)
            direction -= a * y
            saved.append(a)
        if past:
            direction *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(saved), strict=True):
            direction += s * (a - y @ direction / (s @ y))
        step, fall = 1.0, slope @ direction
        while True:
            new, there = loss(w - step * direction)
            if new <= value - 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        s, y = -step * direction, there - slope
        w, gone, value, slope = w + s, value - new, new, there
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if gone < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on the labelled documents; `labels` holds the rows that may be learned from. No labels: a constant model."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(words(t)) for t in texts])

    chosen = fit_rows(labels, label, id_column)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    # fit_rows bounds the broadcast side; rows that repeat an id count once.
    joined = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", found("_text").alias("_words"))
    rows = materialize(joined.groupBy("_id").agg(F.min(F.struct("_label", "_words")).alias("_r")).select("_r.*"), "labelled")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    seen = rows.select("_label", F.explode("_words").alias("_word")).groupBy("_word")
    counts = seen.agg(F.count("*").alias("n"), F.sum("_label").alias("p"))
    share = F.lit(float(positive) / max(1, n))
    z = F.abs(F.col("p") - F.col("n") * share) / F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-9)))
    terms = F.col("_word").isin(sorted(TERMS))
    kept = counts.where(((F.col("n") >= 5) & (z >= Z)) | terms).orderBy(terms.desc(), z.desc(), "_word").limit(WORDS)
    listed = sorted({r["_word"] for r in kept.select("_word").collect()} | TERMS)
    number = {w: i for i, w in enumerate(listed)}

    @F.pandas_udf("array<int>")
    def numbered(lists: pd.Series) -> pd.Series:
        return pd.Series([[number[w] for w in ws if w in number] for ws in lists])

    @F.pandas_udf("map<string,array<int>>")
    def going(lists: pd.Series) -> pd.Series:
        return pd.Series([{t: sorted(number[w] for w in ws if w in number) for t, ws in leaving(set(some)).items()} for some in lists])

    sample = rows.select("_label", numbered("_words").alias("_w"), going("_words").alias("_g")).collect()
    return fit([list(r[1]) for r in sample], [r[2] for r in sample], np.array([r[0] for r in sample], float), listed)


def chance(model: Model, texts) -> list[float]:
    """The scores of texts, 0 to 1; `fsum` gives the same sum in whichever order a set has its words."""
    weights, known = model.weights, model.weights.keys()
    logits = np.array([model.base + math.fsum(weights[w] for w in words(t) & known) for t in texts], float)
    return list(1 / (1 + np.exp(-np.clip(logits, -40, 40))))


def scored(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(chance(model, texts), dtype=float)

    return each(text)


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row of `docs`, from its text alone; repeated rows, null ids and an empty table as they are.

    Columns besides the two are not read, so their names don't matter.
    """
    return docs.select(F.col(id_column).alias("doc_id"), scored(model, F.col(text_column)).alias("score"))

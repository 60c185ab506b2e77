"""Similarity of two field names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def name_tokens(c) -> Column:
    """Distinct `_` tokens in lower case; empty tokens count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.split(F.lower(c), "_"))


def token_overlap(tokens_a, tokens_b) -> Column:
    """Number of shared tokens of two distinct-token arrays."""
    return F.size(F.array_intersect(tokens_a, tokens_b))


def overlap_share(tokens_a, tokens_b) -> Column:
    return token_overlap(tokens_a, tokens_b) / F.greatest(F.size(tokens_a), F.size(tokens_b))


def similarity_bound(tokens_a, tokens_b, length_a, length_b) -> Column:
    """The most `name_similarity` can be, from token and length counts alone."""
    lengths = F.least(length_a, length_b) / (length_a + length_b)
    return overlap_share(tokens_a, tokens_b) * 0.5 + lengths


#: Letters counted one by one: four occurrences of each in four bits of a word, eight of the more frequent ones.
LETTERS, FREQUENT = "abcdefghijklmnopqrstuvwxyz0123456789_", "aceilnorst_"
WORDS, SLOTS, OCCURRENCES = 3, 16, 4


def letter_counts(c) -> Column:
    """(m0, m1, m2, rest): the letters of the lower-cased name, as many set bits per letter as it occurs.

    `rest` counts the characters that have no bit: other characters, and occurrences beyond a letter's bits.
    """
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    slots = [(letter, 0) for letter in LETTERS] + [(letter, OCCURRENCES) for letter in FREQUENT]
    one = F.lit(1).cast("long")
    words = []
    for n in range(WORDS):
        word = F.lit(0).cast("long")
        for place, (letter, before) in enumerate(slots[n * SLOTS : (n + 1) * SLOTS]):
            times = F.length(c) - F.length(F.replace(c, F.lit(letter))) - before
            bits = F.call_function("shiftleft", one, F.least(F.greatest(times, F.lit(0)), F.lit(OCCURRENCES))) - 1
            word = word.bitwiseOR(F.shiftleft(bits, place * OCCURRENCES))
        words.append(word)
    counted = F.struct(*[w.alias(f"m{n}") for n, w in enumerate(words)])
    # Bound once, so that the words are not worked out again for the rest.
    with_rest = lambda m: F.struct(*[m[f"m{n}"].alias(f"m{n}") for n in range(WORDS)], (F.length(c) - sum(F.bit_count(m[f"m{n}"]) for n in range(WORDS))).alias("rest"))
    return F.get(F.transform(F.array(counted), with_rest), F.lit(0))


def shared_letters(counts_a, counts_b) -> Column:
    """The most characters that two names can have in matching blocks, from their `letter_counts`."""
    both = sum(F.bit_count(counts_a[f"m{n}"].bitwiseAND(counts_b[f"m{n}"])) for n in range(WORDS))
    return both + F.least(counts_a["rest"], counts_b["rest"])


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of the lower-cased names (not symmetric)."""
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y in zip(a.str.lower(), b.str.lower()):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def name_similarity(a, b) -> Column:
    """Half token overlap, half sequence ratio; empty names score 0."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    score = overlap_share(name_tokens(a), name_tokens(b)) * 0.5 + sequence_ratio(a, b) * 0.5
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)

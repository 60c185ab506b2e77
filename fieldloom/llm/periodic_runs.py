"""Stretches of a text that repeat with a period, found by seeds on diagonals and extended once each.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4q) words that no neighbouring word
extends. Its words equal those q places further on over at least max(6 - q, 3q) places, so for periods from Q to 2Q - 1
every run shows equal k-grams at its lag, where k is the least such overlap: 5 for Q = 1, else 3Q. Q goes through the
powers of two.

Each occurrence of a k-gram is paired with the next one of the same text. No other pairs are needed: k >= q, so if a k-gram
in a run came again sooner than after q words, the run would have a smaller period. Such a pair is a seed if its lag lies
between Q and 2Q - 1. Seeds are extended along their diagonal in both directions while words are equal, and a table of the
furthest place covered on each diagonal skips seeds that an extension went over already. So a text takes as many pairs as
words per Q, however often its words repeat.

k-grams are numbered exactly, without hashes: a gram of 2s words is the pair of the numbers of its halves. Grams that occur
once are left out of longer ones. Many texts are searched at once, with word numbers of their own, so no gram occurs in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the least words of a run, and the least number of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words searched at once; a longer text is searched by itself.
CHUNK_WORDS = 1 << 19
RUNS = "array<struct<start: long, length: long, period: long>>"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 for equal keys, and which keys occur more than once."""
    _, numbers, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return numbers + 1, counts[numbers] > 1


def _longer(grams: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram and the one `shift` further on both repeat, and keys for the two together."""
    places = np.flatnonzero(grams[: len(grams) - shift])
    places = places[grams[places + shift] > 0]
    return places, grams[places] * (len(grams) + 1) + grams[places + shift]


def _doubled(grams: np.ndarray, span: int) -> np.ndarray:
    """The numbers of the grams of 2 * span words at each place, 0 where they occur once."""
    longer = np.zeros_like(grams)
    if len(grams) > span:
        places, keys = _longer(grams, span)
        numbers, often = _repeated(keys)
        longer[places[often]] = numbers[often]
    return longer


def _seeds(grams: np.ndarray, shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of consecutive occurrences of a k-gram whose lag is from `least` to 2 * least - 1."""
    places, keys = _longer(grams, shift)
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    lags = places[1:] - places[:-1]
    fit = (keys[1:] == keys[:-1]) & (lags >= least) & (lags < 2 * least)
    starts, lags = places[:-1][fit], lags[fit]
    order = np.argsort(starts, kind="stable")
    return starts[order], lags[order]


def _equal_until(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from `at` on, going up or down, whose word differs from the one `lag` further on."""
    size, end = 16, len(words) - lag if step > 0 else -1
    while at != end:
        to = min(at + size, end) if step > 0 else max(at - size, end)
        low, high = (at, to) if step > 0 else (to + 1, at + 1)
        differs = np.flatnonzero(words[low:high] != words[low + lag : high + lag])
        if len(differs):
            return low + int(differs[0 if step > 0 else -1])
        at, size = to, size * 2
    return end


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among the numbers of `words`, whose texts have at most `longest` words."""
    _, grams, counts = np.unique(words, return_inverse=True, return_counts=True)
    grams = np.where(counts[grams] > 1, grams + 1, 0)
    runs, span, least = [], 1, 1
    while span < 4:
        grams, span = _doubled(grams, span), span * 2
    while LEAST_PERIODS * least <= longest and grams.any():
        if span < 2 * least:
            grams, span = _doubled(grams, span), span * 2
            if len(grams) <= span:
                break
        starts, lags = _seeds(grams, 1 if least == 1 else least, least)
        if len(starts):
            # A seed right after a seed of its lag is on the stretch that one covers.
            seeded = np.zeros(len(words) + 1, np.int64)
            seeded[starts + 1] = lags
            first = seeded[starts] != lags
            covered: dict[int, int] = {}
            for start, lag in zip(starts[first].tolist(), lags[first].tolist(), strict=True):
                if start < covered.get(lag, 0):
                    continue
                past = _equal_until(words, start, lag, 1)
                low = _equal_until(words, start, lag, -1) + 1
                covered[lag] = past
                if past - low + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                    runs.append((low, past - low + lag, lag))
        least *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside runs and in the first period of all runs that hold them."""
    if not runs:
        return words
    over = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        over[start + period] += 1
        over[start + length] -= 1
    gone = np.cumsum(over) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def _searched(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text, all searched at once."""
    numbers = np.empty(sum(map(len, texts)), np.int64)
    starts, at = [], 0
    base = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        numbers[at : at + len(words)] = [seen.setdefault(w, len(seen)) for w in words]
        numbers[at : at + len(words)] += base
        starts.append(at)
        at, base = at + len(words), base + len(seen)
    found = find_runs(numbers, max(map(len, texts), default=0))
    places = np.searchsorted(np.array(starts), [r[0] for r in found], "right") - 1 if found else []
    held: list[list] = [[] for _ in texts]
    for (start, length, period), n in zip(found, places, strict=True):
        # A text without words starts where the next one does.
        held[n].append((start - starts[n], length, period))
    yield from held


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) per row of `docs`: its runs by start and period, and its words without the runs' repeats.

    Words are what ASCII blanks part; the collapsed text joins the kept ones with one blank. Rows are judged one by one, so
    repeated rows, ties and null ids are results of their own. Null and empty texts have no runs and an empty collapsed
    text; an empty table gives no rows. Whole texts are read, however long; other columns are not, so their names don't
    matter. Nothing is shuffled: a run never leaves its text.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def batch_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = list(_searched(texts))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs], pa.list_(run)),
            pa.array([b" ".join(collapse(w, r)).decode() for w, r in zip(texts, runs, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    def search(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append((text.as_py() or "").encode().split())
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield batch_of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield batch_of(ids, texts)

    return rows.mapInArrow(search, f"doc_id long, runs {RUNS}, collapsed string")

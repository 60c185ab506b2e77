"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much goes as a whole."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a text's characters that lines may lose.
LOST = 0.5
#: A line fails as navigation with a separator for at most so many words, as noise with a symbol for so many.
WORDS_PER_SEPARATOR, WORDS_PER_SYMBOL = 5, 4
#: A line of so many letters fails if more than this share is upper case.
LETTERS, UPPER = 10, 0.6
#: Fixed values.
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = tuple(".!?…:;\"'”’»)]")
SENTENCE = re.compile(r"[.!?…] ")
SEPARATORS = re.compile(r"[|»«›‹•·→]|>>|<<| > | / ")
BOILERPLATE = re.compile(
    r"lorem ipsum|javascript (?:is|must|should)|enable javascript|(?:use|uses|using|accept) cookies|cookie policy|privacy policy"
    r"|terms of (?:use|service)|all rights reserved|click here|sign up for|subscribe to|log in to|skip to content|share this",
    re.IGNORECASE,
)
#: Fixed: the base rule's least words, window and percentage of repeated words.
LEAST_WORDS, WINDOW, REPEATED = 20, 8, 30
REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double, cleaned string"


def line_fails(line: str) -> bool:
    """Whether the punctuation, navigation, boilerplate, symbol or capitals rule removes a line that has a word."""
    bare = line.strip(SPACE)
    if not bare.endswith(ENDS) and not SENTENCE.search(bare):
        return True
    words = bare.count(" ") + 1
    if len(SEPARATORS.findall(bare)) * WORDS_PER_SEPARATOR > words:
        return True
    if sum(map(bare.count, SYMBOLS)) * WORDS_PER_SYMBOL > words:
        return True
    letters = sum(map(str.isalpha, bare))
    if letters >= LETTERS and sum(map(str.isupper, bare)) > UPPER * letters:
        return True
    return BOILERPLATE.search(bare) is not None


def clean_lines(text: str) -> tuple[str, float]:
    """The lines that pass, with blank lines as they were, and the share of non-space characters that went."""
    there = gone = 0
    passed = []
    for line in text.split("\n"):
        size = len(line) - sum(map(line.count, SPACE))
        there += size
        if size and line_fails(line):
            gone += size
        else:
            passed.append(line)
    return "\n".join(passed), gone / there if there else 0.0


def repeated_words(words: list) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included.

    Windows are numbered exactly: a window of 2n words is the pair of the numbers of its halves.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span = 1
    while span < WINDOW:
        _, ids = np.unique(ids[:-span] * (len(words) + 1) + ids[span:], return_inverse=True)
        span *= 2
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, often, 1)
    np.add.at(covered, often + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def judge(text: str | None) -> tuple:
    """The counts, verdicts and cleaned text of one text, as REPORT names them. Null counts as a text without words."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEATED * len(words)
    cleaned, lost = clean_lines(text)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeats, failed, not failed and lost <= LOST, lost, cleaned,
    )


def judge_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cleaned: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id and the columns of REPORT; the text without its failing lines if `cleaned`.

    Rows are judged one by one, so repeated rows and null ids are results of their own; null and empty texts have no
    words and fail. Whole texts are read. Columns besides the two are not, so their names don't matter.
    """
    fields = [f.split() for f in REPORT.split(", ")]
    names = [n for n, _ in fields if cleaned or n != "cleaned"]

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in fields if n in names))
    def report(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t)[: len(names)] for t in texts], columns=names)

    return docs.select(F.col(id_column).alias("doc_id"), report(F.col(text_column)).alias("_r")).select("doc_id", "_r.*")

"""Header text: tokens, standardised names, search and query text, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks a Unicode-aware `\s` covers, spelled out because Java's `\s` is ASCII only.
BLANKS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Names that may not be used bare.
RESERVED_WORDS = """
select from where table column index group order by join on insert update delete create drop
alter set values into null not and or in is like between exists having limit union all
distinct as case when then else end cast with
""".split()

MAX_NAME = 30

_TOKEN_GAP = f"[{BLANKS}_\\-./,;:]+"
_NAME_GAP = f"[{BLANKS}\\-./,;:]+"
_COUNT_OF = f"(?i)#[{BLANKS}]*of(?![\\p{{L}}\\p{{N}}_])"
_PARENTHESES = r"\(([^)]+)\)"
_RESERVED = rf"^({'|'.join(RESERVED_WORDS)})\z"


def text(c) -> Column:
    """The value as text, null as ''."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def tokenize(c) -> Column:
    """Lower-case tokens between blanks and `_ - . / , ; :`."""
    return F.array_remove(F.split(F.lower(text(c)), _TOKEN_GAP), "")


def squash(c) -> Column:
    """The name without underscores."""
    return F.replace(text(c), F.lit("_"), F.lit(""))


def search_text(*cols) -> Column:
    return F.concat_ws(" ", *[text(c) for c in cols])


def query_text(header, standardized) -> Column:
    """Raw header and standardised header; tokens in both count twice."""
    return F.concat_ws(" ", text(header), text(standardized))


def stable_id(*cols) -> Column:
    """32 hex digits (128 bits) that depend only on the given columns, so reruns give the same id."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def match_rationale(header, standardized, name, kind) -> Column:
    """The sentence stored with an exact or near name match."""
    start = F.concat(
        F.when(F.col(kind) == "exact", "Deterministic match: '").otherwise("Near-exact match: '"),
        text(header),
        F.lit("' standardizes to '"),
        text(standardized),
    )
    return F.when(
        F.col(kind) == "exact", F.concat(start, F.lit("' which exactly matches canonical field."))
    ).otherwise(F.concat(start, F.lit("', matches '"), text(name), F.lit("' after normalization.")))


def tidy(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")


def header_stem(header) -> Column:
    """Standardised name before abbreviations, number prefix, length and reserved words."""
    marked = F.regexp_replace(F.regexp_replace(text(header), _COUNT_OF, "count_of"), "%", "_pct")
    outside = F.lower(F.regexp_replace(marked, r"\([^)]+\)", ""))
    inside = F.lower(F.array_join(F.regexp_extract_all(marked, F.lit(_PARENTHESES), F.lit(1)), "_"))
    body = F.regexp_replace(F.regexp_replace(outside, _NAME_GAP, "_"), "[^a-z0-9_]", "")
    return tidy(F.concat(body, F.lit("_"), F.regexp_replace(inside, "[^a-z0-9]", "_")))


def expand_tokens(stem, abbreviations: dict[str, str]) -> Column:
    """Replace whole tokens that are abbreviations."""
    if not abbreviations:
        return stem
    table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
    tokens = F.transform(F.split(stem, "_"), lambda t: F.coalesce(F.try_element_at(table, t), t))
    return tidy(F.array_join(tokens, "_"))


def finish_name(expanded, header) -> Column:
    """Number prefix, length limit, reserved words; an empty name falls back to the raw header."""
    numbered = F.regexp_replace(expanded, r"^(?=\p{Nd})", "n_")
    cut = F.regexp_replace(F.substring(numbered, 1, MAX_NAME), "_+$", "")
    fallback = F.substring(F.replace(F.lower(text(header)), F.lit(" "), F.lit("_")), 1, MAX_NAME)
    return F.coalesce(F.nullif(F.regexp_replace(cut, _RESERVED, "$1_field"), F.lit("")), fallback)


def standardize(header, abbreviations: dict[str, str] | None = None) -> Column:
    """The standardised snake-case name of a raw header."""
    return finish_name(expand_tokens(header_stem(header), abbreviations or {}), header)

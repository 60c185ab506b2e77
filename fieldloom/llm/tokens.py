"""Token ids of whole texts with the tokenizers library, for use inside tasks.

Byte-pair tokenizers merge within pieces of a text only, and a corpus repeats its pieces. So a text is cut into the
pieces by the tokenizer's own pattern, and the library encodes each distinct piece once. The pattern is applied by
Python's `re` with the letter and number classes of the characters below U+0180 and of general punctuation; a text
with any other character, or with the string of a special token, is encoded whole by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Code points whose classes all Unicode versions since 6 agree on.
PLAIN = [*range(0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
#: Distinct pieces kept in a worker; beyond this the memory starts anew. Longer pieces than KEPT_LENGTH characters, which
#: hardly repeat, are not kept.
KEPT_PIECES, KEPT_LENGTH = 1_000_000, 64
#: Fixed: the contractions both public tokenizers split off.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def _class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in PLAIN if unicodedata.category(chr(c))[0] == kind)


LETTER, NUMBER, SPACE = _class("L"), _class("N"), r"\t-\r \x85\xa0"
PLAIN_TEXT = re.compile("[" + "".join(f"\\u{c:04x}" for c in PLAIN if c != 0x130) + "]*")


def _byte_letters() -> dict[int, str]:
    """The letters byte-level tokenizers write bytes as: printable ones stand for themselves, the rest follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class Pieces(dict):
    """Bytes of the little-endian 32-bit ids of a piece, found by the library's model when first asked for."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        found = packed([t.id for t in self.model.tokenize(written)])
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Encoder:
    """Encodes texts as `Tokenizer.encode(text, add_special_tokens=False)` does, as bytes of 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        self.pattern, self.lower = self._pattern(described)
        self.pieces = Pieces(self.tokenizer)

    @staticmethod
    def _pattern(described: dict) -> tuple[re.Pattern | None, bool]:
        """The pieces' pattern for the two kinds of tokenizer known here; None for others."""
        splitter, normalizer = described["pre_tokenizer"] or {}, described["normalizer"]
        short = "|".join(CONTRACTIONS)
        if splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"] and normalizer is None:
            return re.compile(f" ?[{LETTER}]+|{short}| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"), False
        parts = [p.get("type") for p in (normalizer or {}).get("normalizers", [])]
        first = (splitter.get("pretokenizers") or [{}])[0]
        words = short + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if parts == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": words} and first["invert"] and first["behavior"] == "Removed":
            return re.compile(f"{short}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"), True
        return None, False

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.pattern is None or not PLAIN_TEXT.fullmatch(text) or any(s in text for s in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

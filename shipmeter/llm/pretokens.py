"""Cutting texts the way a vocabulary file says, before any merge."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Tokenizer

# GPT-2's printable stand-ins for bytes, by its published rule.
def _byte_alphabet() -> list[str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


ALPHABET = _byte_alphabet()

# The split patterns of the two vocabulary families.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class Cutter:
    """Pre-tokens of a text, special tokens apart.

    The pattern runs in Python.  Its Unicode tables may be newer than those of the
    tokenizers library, so a text holding a character on which the two disagree is
    cut (and normalised) by the library itself.
    """

    def __init__(self, raw: str, pattern: str, folded: bool) -> None:
        spec = json.loads(raw)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._find = regex.compile(pattern).findall
        self._pattern = pattern
        self._folded = folded
        self._library = Tokenizer.from_str(raw)
        self._far = regex.compile("[՘-\U0010ffff]").search

    def _library_cut(self, text: str) -> list[str]:
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _ours(self, text: str) -> list[str]:
        if self._folded:
            if not text.isascii():
                # Lower-casing is by single characters: no final sigma.
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return self._find(text)

    def _segment(self, text: str) -> list[str]:
        if not text.isascii() and self._far(text) and disputed().search(text):
            return self._library_cut(text)
        return self._ours(text)

    def cut(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special token appears as its id."""
        if self._split is None or "<" not in text:
            return self._segment(text)
        pieces: list[str | int] = []
        for k, part in enumerate(self._split.split(text)):
            if k % 2:
                pieces.append(self.special[part])
            elif part:
                pieces.extend(self._segment(part))
        return pieces


@lru_cache(maxsize=1)
def disputed() -> regex.Pattern:
    """Characters that the library and Python may class, fold or compose differently.

    Found by asking the library about every code point, once per process and only
    when a text holds characters beyond the long-settled blocks.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    odd: set[int] = set()
    for klass in (r"\p{L}", r"\p{N}", r"\s"):
        splitter = pre_tokenizers.Split(Regex(klass), "removed", invert=True)
        theirs = {ord(ch) for piece, _ in splitter.pre_tokenize_str(everything) for ch in piece}
        odd |= theirs ^ {ord(ch) for ch in regex.findall(klass, everything)}
    fold = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    for c in points:
        ch = chr(c)
        if c >= 0x558 and (
            (unicodedata.combining(ch) and c >= 0x870)
            or (c not in odd and unicodedata.category(ch) in ("Lu", "Lt") and fold.normalize_str(ch) != unicodedata.normalize("NFC", ch).lower())
        ):
            odd.add(c)
    return regex.compile("[" + "".join(f"\\U{c:08x}" for c in sorted(odd)) + "]") if odd else regex.compile(r"(?!)")

"""Exact token ids through the tokenizers library, once for each distinct word.

A text is cut where its tokens can't depend on what lies beyond: between a character that isn't white
space and one that is. The model of the library encodes each distinct unit once in a worker; units repeat,
so most need only a look-up. Texts with characters on which two libraries might differ about white space,
case or composition, and texts that hold a special token, go through the whole library instead.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import regex

from .common import Memo

#: Words that a worker remembers before it begins anew (and as many units at uneven spaces, half as many pre-tokens of other units); it keeps them from task to task, at about 200 bytes each.
MEMO = 800_000
#: The patterns by which the two tokenizers split text.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Letters, digits, signs and ASCII white space up to U+017F that every library treats alike; no U+0130.
PLAIN = re.compile("[^\t-\r -~¡-¬®-įı-ſ]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class JsonVocabulary:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` does."""

    def __init__(self, path: str, code: str = "I", memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.code = Tokenizer.from_file(path), code
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = str(spec["pre_tokenizer"])
        self.folds = spec["normalizer"] is not None  # lower case, white space dropped
        if not ("ByteLevel" in kinds and (WORD_PATTERN in kinds.replace("\\\\", "\\") if self.folds else "'use_regex': True" in kinds)):
            raise ValueError(f"{path}: not a byte-level tokenizer of a known kind")
        self.split = regex.compile(WORD_PATTERN if self.folds else BYTE_PATTERN).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_alphabet()
        lead = "" if self.folds else " "
        self.words = Memo(lambda word: self._unit(lead + word), memo)
        self.units = Memo(self._unit, memo)
        self.parts = Memo(self._part, memo // 2)

    def _slow(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit: its pre-tokens, found by rule where letters are followed by one sign at most, else by the pattern. What is remembered as a word isn't remembered as a pre-token too."""
        if self.folds:
            unit = unit.lower()
        bare = unit[1:] if unit[:1] == " " else unit
        if bare.isalpha():
            return self._part(unit)
        if bare[-1:] in SIGNS and bare[:-1].isalpha():
            stem = self.words[bare[:-1]] if self.folds or bare is not unit else self.parts[unit[:-1]]
            return stem + self.parts[unit[-1]]
        return b"".join([self.parts[p] if len(p) < 64 else self._part(p) for p in self.split(unit)])

    def _part(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize("".join([self.letters[b] for b in part.encode()]))]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, each as a machine integer of the type code given."""
        if PLAIN.search(text) or any(s in text for s in self.special):
            return self._slow(text)
        if self.folds:
            return b"".join(map(self.words.__getitem__, text.split()))
        if any(map(text.__contains__, UNEVEN)):
            return b"".join(map(self.units.__getitem__, UNITS.findall(text)))
        head, *rest = text.split(" ")
        return self.units[head] + b"".join(map(self.words.__getitem__, rest))


#: Signs that are a pre-token by themselves after a word.
SIGNS = frozenset(",.;:!?)")
#: Where single spaces aren't all there is between words, a unit is a run of white space and what follows it.
UNEVEN = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
UNITS = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")


@cache
def json_vocabulary(path: str, code: str = "I", memo: int = MEMO) -> JsonVocabulary:
    return JsonVocabulary(path, code, memo)

"""Cutting texts into units that a byte-pair tokenizer encodes one by one, with the same ids as for the whole text.

Both vocabularies that the tokenizers library serves here cut a text with a regular expression before any merging. For texts of the
characters in PLAIN that expression is equal to one of the two below, so their units are the pre-tokens themselves. Other texts are cut
before each space or line feed that follows another character, where no pre-token can go on; texts that hold further white space, which the
library may treat in other ways, before each blank that follows a printable ASCII character.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

from tessera.llm import vocab

OTHER = re.compile(r"[^\n -~À-ÖØ-öø-ÿ]")
STRANGE_BLANK = re.compile(r"[^\S \n]")
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CUT = re.compile(r"(?<=[!-~])(?=[ \n\t\r])")
BYTE_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
LOWER_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters for themselves, the rest from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTERS = byte_letters()


def lettered(unit: str) -> str:
    return "".join([_LETTERS[b] for b in unit.encode()])


_BYTES = {c: b for b, c in enumerate(_LETTERS)}


def unlettered(word: str) -> str:
    return bytes([_BYTES[c] for c in word]).decode()


class Tokenizer:
    """A vocabulary file of the tokenizers library, with its units."""

    def __init__(self, path: str):
        self.whole = vocab.tokenizer(path)
        self.model = self.whole.model
        self.lowers = self.whole.normalizer is not None
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def units(self, text: str) -> tuple[list[str], bool]:
        """The units of a text, and whether they are pre-tokens."""
        if not OTHER.search(text) and not self.has_special.search(text):
            return (LOWER_WORDS.findall(text.lower()) if self.lowers else BYTE_WORDS.findall(text)), True
        if not STRANGE_BLANK.search(text):
            return CHUNK.findall(text), False
        return CUT.split(text), False

    def word_ids(self, word: str) -> list[int]:
        """Ids of a pre-token, by the library's model."""
        return [t.id for t in self.model.tokenize(lettered(word))]

    def unit_ids(self, unit: str) -> list[int]:
        return self.whole.encode(unit, add_special_tokens=False).ids

    def pre_tokens(self, unit: str) -> tuple[list[str], int]:
        """The pre-tokens of a unit, lettered, and how many special tokens stand between them."""
        parts = self.has_special.split(unit)
        norm = (lambda x: self.whole.normalizer.normalize_str(x)) if self.lowers else (lambda x: x)
        return [w for p in parts if p for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(norm(p))], len(parts) - 1

    def keys(self, unit: str) -> list[str]:
        """The pre-tokens of a unit, as they stand in it, and its special tokens between them, in order. No pre-token has a special token's text."""
        out, at = [], 0
        for m in self.has_special.finditer(unit):
            out += [*map(unlettered, self.pre_tokens(unit[at : m.start()])[0]), m.group()]
            at = m.end()
        return out + [*map(unlettered, self.pre_tokens(unit[at:])[0])]

    def key_ids(self, key: str) -> list[int]:
        return [self.special[key]] if key in self.special else self.word_ids(key)


def tokenizer(path: str) -> Tokenizer:
    return vocab.once("units", path, Tokenizer)


class Memo(dict):
    """Results by unit. Its size is bounded in bytes: it is emptied when it would hold more than `most`, and units of more than LONGEST characters aren't kept.
    What isn't there is worked out again."""

    LONGEST = 256

    def __init__(self, f: Callable, most: int = 96 << 20):
        super().__init__()
        self.f, self.most, self.held = f, most, 0

    def __missing__(self, unit):
        out = self.f(unit)
        if len(unit) <= self.LONGEST:
            size = sys.getsizeof(unit) + sys.getsizeof(out) + 128
            if self.held + size > self.most:
                self.clear()
                self.held = 0
            self.held += size
            self[unit] = out
        return out

"""Token ids of whole texts from a word-level BPE file, one word at a time.

The tokenizer drops white space and never joins words, so the ids of a text are those of its words in order. Words repeat,
so each worker keeps the ids of words it has seen: two generations of at most CACHE_WORDS each, of which the older one is
dropped when the younger is full, so words that come again stay. Words of Latin letters, digits and ASCII
signs are cut by the file's own rule into parts, whose ids are kept too (a name with and without a comma shares them), and merged by
its model directly; all others go through the whole tokenizer.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: About 250 bytes each, in each generation and of parts; one may pass it by the words of one text.
CACHE_WORDS = 250_000
# Letters that have one lower-case form, one composed form and no neighbours that change them; the apostrophe is left out, as it starts contractions.
_parts = re.compile(r"[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_odd_space = re.compile(r"[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The file's letters for bytes: visible Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_letters = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordBpe:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.forget()

    def forget(self) -> None:
        """Drop all words, at the end of a task."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_letters)  # visible ASCII stands for itself
        ids = self.parts[part] = _packed([t.id for t in self.model.tokenize(shown)])
        return ids

    def _find(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the younger generation lacks."""
        old, known, found, rest = self.old, self.parts, {}, []
        for word in words:
            if ids := old.get(word):
                found[word] = ids
            elif word.isascii() and word.isalpha():  # one part
                part = word.lower()
                found[word] = known.get(part) or self._part(part)
            elif len("".join(parts := _parts.findall(word))) == len(word):
                found[word] = b"".join([known.get(part) or self._part(part) for part in map(str.lower, parts)])
            else:
                rest.append(word)
        for word, coded in zip(rest, self.whole.encode_batch(rest, add_special_tokens=False) if rest else ()):
            found[word] = _packed(coded.ids)
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if text.isascii():
            text = text.lower()
        if _odd_space.search(text):  # Python splits there, the tokenizer does not
            words = [w for w in re.sub(r"[\n\t\r]", " ", text).split(" ") if w]
        else:
            words = text.split()
        if new := set(words).difference(self.young):
            self.young.update(self._find(new))
        out = b"".join(map(self.young.__getitem__, words))
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)

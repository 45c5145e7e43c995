"""Token ids of whole texts with a public word-level BPE tokenizer.

The tokenizer never joins text across white space, so the ids of a text are those of its chunks in
order, and a chunk's ids are looked up once per worker, as are those of its word without marks. Each
lookup is emptied when it is full, so memory stays bounded; the result does not depend on it.
"""

from __future__ import annotations

import re
from operator import attrgetter

import numpy as np

CACHE = 300_000
WORDS = 600_000
# Control characters that part chunks here but not in the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
MARKS = '.,;:!?|#$%&*()"/-'
# Up to here a letter is its own composed form, and its lower case does not depend on its place.
LATIN_1 = "\xff"


ID_OF = attrgetter("id")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one beyond 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Encoder(dict):
    """Chunk -> little-endian 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        word = chunk.rstrip(MARKS)
        ids = None
        if word.isalpha():
            marks = chunk[len(word) :]
            word = word.lower() if word.isascii() or max(word) <= LATIN_1 else self.normalize(word)
            if word.isalpha():
                ids = self._word(word)
                if marks:
                    ids += self._word(marks)
        if ids is None:
            ids = self._whole(chunk)
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORDS:  # kept while chunks are forgotten: most of them recur
                self.words.clear()
            mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = np.fromiter(map(ID_OF, self.model.tokenize(mapped)), "<u4").tobytes()
            self.words[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its lookup serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

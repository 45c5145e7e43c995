"""Words of texts found by an Aho-Corasick dictionary whose words carry checksum payloads.

Every distinct word of a portion of texts is entered once, bounded by a delimiter on either side,
with the CRC-32 and the length of its bytes as payload. One scan of the automaton over the portion
emits the payloads in order. The checksum of a run of adjacent words follows from their payloads
alone: appending n bytes to a string maps its checksum by a fixed linear operator, so checksums are
composed without touching text again.

A dictionary holds the words of one portion, whose bytes are bounded, whatever the corpus holds.
"""

from __future__ import annotations

import zlib
from itertools import chain

import ahocorasick
import numpy as np

GAP = b" "
POLYNOMIAL = 0xEDB88320  # CRC-32, reflected


def _byte_classes() -> bytes:
    """A-Z to lower case, digits, letters and all bytes from 0x80 as they are, the rest to a gap."""
    kept = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
    lowered = {b: b + 32 for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return bytes(b if b in kept else lowered.get(b, GAP[0]) for b in range(256))


CLASSES = _byte_classes()


class Appender:
    """Checksums of ``left + right`` from the checksums of both and the length of ``right``."""

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, np.uint32(POLYNOMIAL) ^ (one >> 1), one >> 1)
        bytes_at = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
        shifted = [one[b & 255] ^ (b >> np.uint32(8)) for b in bytes_at]
        self.powers = [np.stack(shifted)]  # the operator of one zero byte, then of 2, 4, 8, ...

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append(np.stack([self._apply(last, row) for row in last]))
        return self.powers[k]

    @staticmethod
    def _apply(operator: np.ndarray, sums: np.ndarray) -> np.ndarray:
        out = operator[0][sums & 255]
        for j in (1, 2, 3):
            out = out ^ operator[j][(sums >> np.uint32(8 * j)) & 255]
        return out

    def append(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        moved, k = left, 0
        while (length >> k).any():
            moved = np.where((length >> k) & 1, self._apply(self._power(k), moved), moved)
            k += 1
        return moved ^ right


class WordScan:
    """The words of a portion of texts: payloads in text order and the text each lies in."""

    def __init__(self, texts: list[bytes | None]):
        plain = [(t or b"").translate(CLASSES) for t in texts]
        joined = GAP + GAP.join(plain) + GAP
        words = set(joined.split())
        self.n_texts = len(texts)
        crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        found = np.zeros((0, 2), dtype=np.int64)
        if words:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, word in enumerate(words):
                # one character for each byte, so that ends are places in bytes
                automaton.add_word((GAP + word + GAP).decode("latin-1"), number)
            automaton.make_automaton()
            emitted = chain.from_iterable(automaton.iter(joined.decode("latin-1")))
            found = np.fromiter(emitted, dtype=np.int64).reshape(-1, 2)
        stops = np.cumsum([len(t) + 1 for t in plain]) if plain else np.zeros(0, np.int64)
        self.text = np.searchsorted(stops, found[:, 0], side="left")
        self.crc, self.sizes = crc[found[:, 1]], sizes[found[:, 1]]
        self.n_words = np.bincount(self.text, minlength=self.n_texts)

    def runs(self, low: int, high: int, appender: Appender):
        """For each count of words from ``low`` to ``high``: checksums of all runs and their texts."""
        gap_crc = np.uint32(zlib.crc32(GAP))
        sums, sizes = self.crc, self.sizes
        for count in range(1, high + 1):
            if count > 1:
                last = count - 1
                inside = self.text[last:] == self.text[: len(self.text) - last]
                inside = inside if len(self.text) > last else np.zeros(0, bool)
                spaced = appender.append(
                    sums[: len(inside)], np.full(len(inside), gap_crc), np.ones(len(inside), np.int64)
                )
                sums = appender.append(spaced, self.crc[last:], self.sizes[last:])
                sizes = sizes[: len(inside)] + 1 + self.sizes[last:]
            else:
                inside = np.ones(len(sums), bool)
            if count >= low:
                yield sums[inside], self.text[: len(sums)][inside]

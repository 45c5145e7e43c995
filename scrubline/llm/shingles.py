"""Distinct word shingles of texts as 64-bit fingerprints, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C55  # odd, hence invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
# White space becomes one blank, A-Z lower case; all other bytes make up words.
FOLDED = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of them."""
    if len(_powers.get("up", ())) < size:
        size = max(size, 2 * BLOCK_BYTES)
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums; ``(sums[b] - sums[a]) * down[a]`` fingerprints bytes a to b."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def blocks(bodies: list[bytes]):
    """Runs of texts of about ``BLOCK_BYTES``, a longer text alone."""
    at = 0
    while at < len(bodies):
        begin, size = at, 0
        while at < len(bodies) and (at == begin or size + len(bodies[at]) <= BLOCK_BYTES):
            size += len(bodies[at])
            at += 1
        yield bodies[begin:at]


def shingle_sets(bodies: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted.

    A text of fewer words has its whole sequence as one shingle; without words it has none.
    """
    found: list[np.ndarray] = []
    for block in blocks(bodies):
        found += _block_sets(block, width)
    return found


def _block_sets(block: list[bytes], width: int) -> list[np.ndarray]:
    raw = np.frombuffer((b"\n".join(block) + b"\n").translate(FOLDED), dtype=np.uint8)
    word = raw != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums, down = prefix_sums(raw)
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    lengths = np.array([len(b) + 1 for b in block], dtype=np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    joined = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(width):
        joined += words[i : i + len(joined)] * factors[i]
    joined = mixed(joined)
    sets = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        count = last - first
        if count >= width:
            sets.append(np.unique(joined[first : last - width + 1]))
        elif count:
            whole = (words[first:last] * factors[:count]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([whole + np.uint64(count)], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def fingerprint(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    total = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    parity = np.bitwise_xor.reduce(mixed(shingles + np.uint64(0x51ED27)), initial=np.uint64(0))
    both = int(total) * 0x9E3779B97F4A7C15 + int(parity) + len(shingles)
    return int(mixed(np.array([both & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)).view(np.int64)[0])

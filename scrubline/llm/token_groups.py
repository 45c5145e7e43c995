"""Groups of tokens of two tokenizers that cover the same bytes, as an associative fragment.

Both tokenizers write a text as the same bytes. Where tokens of both end at one byte the text is
cut, and the tokens between two cuts form a group. A range of bytes gives a fragment: an open prefix
up to its first cut, closed groups, an open suffix after its last cut. Fragments of adjacent ranges
compose: the suffix of one and the prefix of the next become one group. Composition is associative
and the empty range is neutral, so ranges of one text may be read anywhere and put together in any
bracketing.

A text is read in pieces. Neither tokenizer joins tokens over a single space between two other
characters (checked against the vocabulary), so a piece ends at each such space and its groups do
not depend on its neighbours.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import numpy as np

from scrubline.llm.word_tokens import byte_letters

# Python's white space holds all that Unicode lists, so these spaces are single for the tokenizers.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = re.compile(r"[^\S \n]")
BLOCK = 32 << 10  # characters of pieces encoded in one call
WIDE = 1 << 16  # a group with more links is listed by distinct ids


class Fragment(NamedTuple):
    """Ids in order, and how many of them lie in the prefix, in each closed group, in the suffix."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @property
    def closed(self) -> bool:
        """Whether it ends with a cut, so that the prefix is a group too if nothing comes before."""
        return len(self.n_a) > 1 and not self.n_a[-1] and not self.n_b[-1]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the groups of a whole text, which ends with a cut."""
        return self.n_a[:-1], self.n_b[:-1]


def empty_fragment() -> Fragment:
    return Fragment(*np.zeros((2, 0), np.int64), *np.zeros((2, 1), np.int64))


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of a range from the tokens that end in it and the bytes where they end."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    sizes = [
        np.bincount(np.searchsorted(cuts, ends), minlength=len(cuts) + 1) for ends in (ends_a, ends_b)
    ]
    return Fragment(a, b, *sizes)


def compose(parts: list[Fragment]) -> Fragment:
    """Fragments of adjacent ranges as one; without any, the neutral one."""
    if not parts:
        return empty_fragment()
    lengths = np.array([len(p.n_a) for p in parts])
    kept = np.ones(int(lengths.sum()), bool)
    kept[np.cumsum(lengths)[:-1]] = False  # a prefix joins the suffix before it
    starts = np.flatnonzero(kept)
    sizes = [np.add.reduceat(np.concatenate(column), starts) for column in list(zip(*parts))[2:]]
    return Fragment(
        np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]), *sizes
    )


def links(a, b, n_a, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens that share a group: the packed ids, how often, and the group's number.

    A pair comes once for each occurrence, with 1; in a group of more than ``WIDE`` links once for
    each pair of distinct ids, with the product of their counts.
    """
    wide = n_a * n_b > WIDE
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    group = np.repeat(np.arange(len(n_a)), n_a)
    times = np.where(wide, 0, n_b)[group]
    total = int(times.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    right = b[np.repeat(first_b[group], times) + inside]
    packed = [np.repeat(a, times).astype(np.int64) << 32 | right.astype(np.int64)]
    weights, of = [np.ones(total, np.int64)], [np.repeat(group, times)]
    for g in np.flatnonzero(wide):
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        packed.append((ids_a.astype(np.int64)[:, None] << 32 | ids_b.astype(np.int64)).ravel())
        weights.append((times_a[:, None] * times_b).ravel())
        of.append(np.full(len(packed[-1]), g))
    if not wide.any():
        return packed[0], weights[0], of[0]
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(packed)[order], np.concatenate(weights)[order], of[order]


class Encoded(NamedTuple):
    """Pieces in a row: ids, sizes of the groups, and the number of groups up to each piece's end."""

    pieces: list[str]
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    stops: np.ndarray


class TokenPair:
    """A byte-level tokenizer (A, a Hugging Face file) and a piece tokenizer (B, a SentencePiece file)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.ids_a, names = read_byte_level(path_a)
        self.tok_b = SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.bytes_a = [bytes(byte_of.get(c, 63) for c in name) for name in names]
        pieces = [self.tok_b.id_to_piece(i) for i in range(self.tok_b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.tok_b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths_a = np.array([len(x) for x in self.bytes_a])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])
        # a piece with a space after something else would reach over a cut
        self.splits = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        most = max(len(self.bytes_a), len(self.bytes_b))
        # an id with what may follow it: more of its side, the other side, the next group
        self.names = [str(i).encode() + mark for i in range(most) for mark in (b",", b"|", b";")]

    def pieces(self, text: str) -> list[str]:
        """The text cut at lone spaces, which go; each piece is read with one space before it."""
        if not text:
            return []
        if not self.splits:
            return [text]
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return LONE_SPACE.split(text)
        # all spaces are lone where no other white space can be next to one
        return LONE_SPACE.split(text) if RARE_SPACE.search(text) else text.split(" ")

    def tokens(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids and ends of both for a space and the text; None if either does not give its bytes back."""
        spaced = " " + text
        a = self.ids_a(spaced)
        b = self.tok_b.encode(text)
        raw = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
            return None
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        b = np.array(b, np.int64)
        return a, np.cumsum(self.lengths_a[a]), b, np.cumsum(self.lengths_b[b])

    def encode(self, pieces: list[str]):
        """``Encoded`` runs of the pieces; a piece whose bytes do not come back is alone with no ids.

        Pieces with white space at an edge are read alone, as its neighbours would change them.
        """
        plain = [p for p in pieces if p and p.strip() == p]
        if len(plain) < len(pieces):
            yield from map(self._alone, (p for p in pieces if not p or p.strip() != p))
        block_of = np.cumsum([len(p) for p in plain], dtype=np.int64) // BLOCK
        borders = np.flatnonzero(np.diff(block_of, prepend=-1, append=-1)).tolist()
        for begin, end in zip(borders, borders[1:]):
            yield from self._together(plain[begin:end])

    def _alone(self, piece: str) -> Encoded:
        found = self.tokens(piece)
        if found is None:
            return Encoded([piece], *np.zeros((4, 0), np.int64), np.zeros(1, np.int64))
        whole = fragment(*found)
        n_a, n_b = whole.groups()
        return Encoded([piece], whole.a, whole.b, n_a, n_b, np.array([len(n_a)]))

    def _together(self, run: list[str]):
        found = self.tokens(" ".join(run)) if self.splits else None
        if found is None:
            yield from map(self._alone, run)
            return
        a, ends_a, b, ends_b = found
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_a, n_b = (np.diff(np.searchsorted(e, cuts, side="right"), prepend=0) for e in (ends_a, ends_b))
        ends = np.cumsum([len(p.encode()) + 1 for p in run])
        yield Encoded(run, a, b, n_a, n_b, np.searchsorted(cuts, ends) + 1)

    def listed(self, a, b, n_a, n_b, stops) -> list[bytes]:
        """The groups up to each stop: decimal ids of A, a bar, those of B; semicolons between groups."""
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        codes = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a - 1], mark_b[last_b - 1] = 1, 2
        # within a group the ids of A come first
        codes[np.arange(len(a)) + np.repeat(last_b - n_b, n_a)] = a * 3 + mark_a
        codes[np.arange(len(b)) + np.repeat(last_a, n_b)] = b * 3 + mark_b
        names = self.names
        flat = [names[c] for c in codes.tolist()]
        ends = np.concatenate([[0], last_a + last_b])[stops].tolist()
        out, begin = [], 0
        for end in ends:
            out.append(b"".join(flat[begin:end])[:-1])
            begin = end
        return out


def read_byte_level(path: str):
    """A function from text to ids, and the vocabulary, of a byte-level BPE file.

    Where ids follow the order of the merges, the merges are ranks, and a coder that works on ranks
    gives the same ids several times as fast. Other files are read by their own library. Strings of
    special tokens are ordinary text in both.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model, before = described["model"], described["pre_tokenizer"] or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
    plain = described["normalizer"] is None and before.get("type") == "ByteLevel"
    plain = plain and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or names[256 : 256 + len(merges)] != merges:
        return lambda text: np.array(own.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), names
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {bytes(byte_of[c] for c in name): i for i, name in enumerate(names[: 256 + len(merges)])}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: coder.encode_to_numpy(text).astype(np.int64), names


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """The worker's tokenizers, loaded once."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = TokenPair(path_a, path_b)
    return _pairs[path_a, path_b]

"""Deep-shallow sorting of byte strings: multikey quicksort first, blind tries for the long ties."""

from __future__ import annotations

import numpy as np

SHALLOW = 16
SMALL = 32


def deep_shallow_order(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of ``rows`` (one byte string of equal width each) by group, then bytes.

    Down to ``shallow`` bytes all groups are sorted together by a multikey quicksort on eight-byte
    characters. Strings that still tie have a long common prefix and go into a blind trie each.
    """
    width = rows.shape[1]
    depth = min(shallow, width) // 8 * 8
    words = [
        np.ascontiguousarray(rows[:, d : d + 8]).view(">u8").ravel().astype(np.uint64)
        for d in range(0, depth, 8)
    ]
    order = np.argsort(group, kind="stable")
    order = _multikey_quicksort(order, group, words)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for key in (group, *words):
        same &= key[order][1:] == key[order][:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for first, last in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        tied = order[first : last + 1]
        order[first : last + 1] = _blind_trie_order(tied, rows, depth)
    return order


def _multikey_quicksort(order: np.ndarray, group: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Ternary partitioning around a pivot, one eight-byte character at a time.

    All segments that tie at a depth are split at once: a step sends each element below, to or above
    its segment's pivot, which is a stable sort of (segment, side). Short segments are finished by
    one sort of the character itself.
    """
    segment = np.zeros(len(order), dtype=np.int64)
    if len(order):
        segment[1:] = np.cumsum(group[order][1:] != group[order][:-1])
    for word in words:
        open_ = np.ones(len(order), dtype=bool)  # elements whose segment still mixes characters
        while open_.any():
            value = word[order]
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sizes = np.diff(np.append(starts, len(order)))
            if sizes.max() <= SMALL or len(starts) > 1:
                # many short segments: one sort by (segment, character) splits them all
                place = np.lexsort((value, segment))
                order, value = order[place], value[place]
                cut = (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])
                segment = np.concatenate([[0], np.cumsum(cut)])
                break
            pivot = np.repeat(value[starts + sizes // 2], sizes)
            side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
            place = np.lexsort((side, segment))
            order, side = order[place], side[place]
            cut = (segment[1:] != segment[:-1]) | (side[1:] != side[:-1])
            segment = np.concatenate([[0], np.cumsum(cut)])
            open_ = side != 1
    return order


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def _blind_trie_order(tied: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Order of strings that agree up to ``depth``, by inserting them into a blind trie.

    Inner nodes hold only a depth and branch on the byte there. A string first descends blindly to
    some leaf, is compared with it once, and is then hung where the two part.
    """
    strings = [rows[i, depth:].tobytes() for i in tied.tolist()]
    leaves: dict[bytes, list[int]] = {}
    root = None
    for number, string in enumerate(strings):
        if string in leaves:
            leaves[string].append(number)
            continue
        leaves[string] = [number]
        if root is None:
            root = string
            continue
        node = root
        while isinstance(node, _Node):
            node = node.children.get(string[node.depth]) or next(iter(node.children.values()))
        part = _common(string, node)
        above, node = None, root
        while isinstance(node, _Node) and node.depth < part:
            above, node = node, node.children[string[node.depth]]
        if isinstance(node, _Node) and node.depth == part:
            node.children[string[part]] = string
            continue
        other = node
        while isinstance(other, _Node):
            other = next(iter(other.children.values()))
        split = _Node(part, {string[part]: string, other[part]: node})
        if above is None:
            root = split
        else:
            above.children[string[above.depth]] = split
    found: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            found += leaves[node]
    return tied[found]


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two different strings of one length share at the start."""
    bits = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()
    return len(a) - (bits + 7) // 8


def neighbour_prefixes(order: np.ndarray, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Common prefix of each string with the one before it in order; -1 at a group's first."""
    lcp = np.full(len(order), -1, dtype=np.int64)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        differ = rows[a] != rows[b]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        lcp[1:] = np.where(group[a] == group[b], length, -1)
    return lcp

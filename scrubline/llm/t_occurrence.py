"""T-occurrence search over inverted lists (DivideSkip), and links among the sets of one group."""

from __future__ import annotations

import heapq

import numpy as np

HEAP_MOST = 2000

def required(size: int, percent: int) -> int:
    """The least overlap with any set of Jaccard similarity of at least ``percent`` / 100."""
    return -(-percent * size // 100)


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return inter > 0 and 100 * inter >= percent * (a + b - inter)


class InvertedLists:
    """Shingle -> sorted numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")  # owners stay ascending within a shingle
        self.owners = owner[order]
        self.keys, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))

    def lists(self, query: np.ndarray, least: int = 1) -> list[np.ndarray]:
        """The query's lists; none if fewer than ``least`` of them can hold any other set."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        if len(at) < least:
            return []
        return [self.owners[self.begin[i] : self.end[i]] for i in at.tolist()]

    def search(self, query: np.ndarray, least: int, skip) -> list[tuple[int, int]]:
        """``(set, overlap)`` of every set that shares at least ``least`` shingles with ``query``.

        The longest ``least - 1`` lists cannot make up the overlap alone, so the others are merged
        through a heap, and only sets met there are probed in the long lists by binary search.
        ``skip(set)`` leaves out sets that need no answer.
        """
        lists = sorted(self.lists(query, least), key=len)
        if len(lists) < least:
            return []
        divide = len(lists) - (least - 1)
        short, long = lists[:divide], lists[divide:]
        numbers, counts = _merged(short)
        wanted = np.array([not skip(x) for x in numbers.tolist()], dtype=bool)
        numbers, counts = numbers[wanted], counts[wanted]
        for left, one in zip(range(len(long), 0, -1), reversed(long)):
            possible = counts + left >= least
            if not possible.all():
                numbers, counts = numbers[possible], counts[possible]
            if not len(numbers):
                return []
            slot = np.minimum(np.searchsorted(one, numbers), len(one) - 1)
            counts = counts + (one[slot] == numbers)
        enough = counts >= least
        return list(zip(numbers[enough].tolist(), counts[enough].tolist()))


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the merged lists with how many lists hold them; long merges are sorted at once."""
    if sum(map(len, lists)) > HEAP_MOST:
        return np.unique(np.concatenate(lists), return_counts=True)
    numbers: list[int] = []
    counts: list[int] = []
    for number in heapq.merge(*(one.tolist() for one in lists)):
        if numbers and numbers[-1] == number:
            counts[-1] += 1
        else:
            numbers.append(number)
            counts.append(1)
    return np.array(numbers, dtype=np.int64), np.array(counts, dtype=np.int64)


class Forest:
    """Union-find over numbers; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def star(sets: list[np.ndarray], members: np.ndarray, leader: int, percent: int) -> np.ndarray:
    """The members similar to the leader, from one pass over all their shingles."""
    sizes = np.array([len(sets[m]) for m in members])
    near = (100 * np.minimum(sizes, len(sets[leader])) >= percent * np.maximum(sizes, len(sets[leader])))
    members, sizes = members[near], sizes[near]
    if not len(members):
        return members
    flat = np.concatenate([sets[m] for m in members])
    at = np.searchsorted(sets[leader], flat)
    at[at == len(sets[leader])] = 0
    ends = np.cumsum(sizes)
    hits = np.concatenate([[0], np.cumsum(sets[leader][at] == flat)])
    inter = hits[ends] - hits[ends - sizes]
    good = 100 * inter >= percent * (sizes + len(sets[leader]) - inter)
    return members[good & (inter > 0)]


def group_links(
    sets: list[np.ndarray], percent: int, queries: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a group (a spanning forest of its similarity graph).

    Sets are linked to a leader as long as that settles a good share of them at once. Two sets
    already connected need no comparison; every other pair has a member outside the largest tree,
    and each of those is searched. With ``queries`` only these sets are searched, against all.
    """
    forest = Forest(len(sets))
    able = _able(sets, percent)
    if queries is None:
        free = able
        while len(free) > 1:
            linked = star(sets, free[1:], int(free[0]), percent)
            for m in linked.tolist():
                forest.join(int(free[0]), m)
            settled = np.isin(free, linked)
            settled[0] = True
            worthwhile = settled.sum() > 1 + len(free) // 20
            free = free[~settled]
            if not worthwhile:
                break
        if not len(able):
            return []
        roots = np.array([forest.root(i) for i in able.tolist()])
        kinds, counts = np.unique(roots, return_counts=True)
        queries = able[roots != kinds[np.argmax(counts)]]
    else:
        queries = queries[np.isin(queries, able)]
    if not len(queries):
        return forest.links
    index = InvertedLists([sets[i] for i in able.tolist()])
    for q in queries.tolist():
        size = len(sets[q])
        own = lambda s: able[s] == q or forest.root(int(able[s])) == forest.root(q)  # noqa: B023, E731
        for s, inter in index.search(sets[q], required(size, percent), own):
            if similar(inter, size, len(sets[able[s]]), percent):
                forest.join(q, int(able[s]))
    return forest.links


def _able(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The sets that can be similar to another one: enough of their shingles are in several sets.

    Leaving a set out may take another one's partners away, so this is repeated until nothing goes.
    """
    able = np.flatnonzero([len(s) > 0 for s in sets])
    while len(able):
        sizes = np.array([len(sets[i]) for i in able.tolist()])
        flat = np.concatenate([sets[i] for i in able.tolist()])
        _, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.concatenate([[0], np.cumsum(counts[back] > 1)])
        ends = np.cumsum(sizes)
        enough = shared[ends] - shared[ends - sizes] >= -(-percent * sizes // 100)
        if enough.all():
            break
        able = able[enough]
    return able

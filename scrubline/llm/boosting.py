"""Gradient-boosted trees on counted profiles, fitted and applied with DataFrame expressions only.

A profile is a combination of small whole-number features with how many candidates have it and how
many of them are verified. Each level of a tree takes one aggregation of gradients by node, feature
and value; what reaches the driver is one row for each of those, whatever the corpus holds. A fitted
model is a sum of nested conditions, so it is applied inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DEPTH = 2
RATE = 0.4
RIDGE = 1.0
LEAST_GAIN = 1e-3


@dataclass
class Node:
    """A condition ``feature <= at`` with two branches, or a leaf with a value."""

    value: float = 0.0
    feature: str | None = None
    at: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self, get: Callable[[str], Column], leaf: Callable[[Node], Column]) -> Column:
        if self.feature is None:
            return leaf(self)
        low, high = self.low.column(get, leaf), self.high.column(get, leaf)
        return F.when(get(self.feature) <= self.at, low).otherwise(high)

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.low.leaves() + self.high.leaves()


@dataclass
class Boosted:
    """The start and the trees; the probability is the logistic of their sum."""

    start: float
    trees: list[Node] = field(default_factory=list)

    def probability(self, get: Callable[[str], Column]) -> Column:
        margin = F.lit(self.start)
        for tree in self.trees:
            margin = margin + tree.column(get, lambda leaf: F.lit(leaf.value))
        return 1.0 / (1.0 + F.exp(-margin))


def _histogram(rows: DataFrame, node: Column, features: list[str]) -> dict:
    """Sums of gradient and curvature by node, feature and value."""
    each = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in features])
    )
    sums = (
        rows.select(node.alias("node"), "g", "h", each.alias("f"))
        .groupBy("node", "f.feature", "f.value")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    )
    out: dict = {}
    for r in sums.collect():
        out.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["value"], r["g"], r["h"]))
    return out


def _best_split(by_feature: dict) -> tuple[float, str, int, tuple, tuple] | None:
    """Gain, feature, value, and the sums of both sides; ties go to the first name, then value."""
    best = None
    for name in sorted(by_feature):
        values = sorted(by_feature[name])
        g_all, h_all = (sum(v[k] for v in values) for k in (1, 2))
        g = h = 0.0
        for value, dg, dh in values[:-1]:
            g, h = g + dg, h + dh
            rest = g_all - g, h_all - h
            gain = g * g / (h + RIDGE) + rest[0] ** 2 / (rest[1] + RIDGE) - g_all**2 / (h_all + RIDGE)
            # sums differ in the last digits from run to run, so equal gains are told by rounding
            gain = round(gain, 4)
            if gain > LEAST_GAIN and (best is None or gain > best[0]):
                best = gain, name, value, (g, h), rest
    return best


def _leaf_value(g: float, h: float) -> float:
    return round(-RATE * g / (h + RIDGE), 4)


def fit(profiles: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted | None:
    """Trees for ``profiles`` with the features, ``n`` and ``verified``; None without any row.

    Features are whole numbers without nulls. The answer does not depend on the order of the rows.
    """
    totals = profiles.agg(F.sum("n").alias("n"), F.sum("verified").alias("v")).first()
    if not totals["n"]:
        return None
    share = (totals["v"] + 0.5) / (totals["n"] + 1.0)
    model = Boosted(round(log(share / (1 - share)), 4))
    for _ in range(rounds):
        p = model.probability(F.col)
        rows = profiles.select(
            *features, (p * F.col("n") - F.col("verified")).alias("g"), (p * (1 - p) * F.col("n")).alias("h")
        )
        tree = Node()
        for _ in range(depth):
            numbers = {id(leaf): k for k, leaf in enumerate(tree.leaves())}
            node = tree.column(F.col, lambda leaf: F.lit(numbers[id(leaf)]))
            found = _histogram(rows, node, features)
            grown = False
            for k, leaf in enumerate(tree.leaves()):
                best = _best_split(found[k]) if k in found else None
                if best is not None:
                    _, leaf.feature, leaf.at, low, high = best
                    leaf.low, leaf.high = Node(_leaf_value(*low)), Node(_leaf_value(*high))
                    grown = True
            if not grown:
                break
        if tree.feature is None:
            break
        model.trees.append(tree)
    return model


def calibrated(steps: list[tuple[int, int, int]]) -> list[tuple[int, float, int]]:
    """``(step, share, n)`` from ``(step, n, verified)`` in ascending order of steps.

    Shares are made to rise with the step: neighbours that fall are pooled (isotonic regression).
    """
    pools: list[list] = []
    for step, n, v in steps:
        pools.append([[step], n, v])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] > pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [(step, v / n, n) for members, n, v in pools for step in members]


def thresholds(
    profiles: DataFrame, model: Boosted, group: str, precision: float, least: int
) -> dict[str, float]:
    """For each group the lowest probability, in hundredths, whose calibrated share of verified rows
    is at least ``precision``; groups without such a pool of ``least`` rows are left out.
    """
    step = F.floor(model.probability(F.col) * 100).cast("int")
    counted = profiles.groupBy(group, step.alias("step")).agg(
        F.sum("n").alias("n"), F.sum("verified").alias("v")
    )
    by_group: dict = {}
    for row in counted.collect():
        by_group.setdefault(row[group], []).append((row["step"], row["n"], row["v"]))
    out = {}
    for name, steps in by_group.items():
        good = [s for s, share, n in calibrated(sorted(steps)) if share >= precision and n >= least]
        if good:
            out[name] = min(good) / 100
    return out

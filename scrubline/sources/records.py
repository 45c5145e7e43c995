"""Records of delimited files whose cells may hold line breaks, found by many tasks per file.

A line break belongs to a cell if the quote that opens the cell is still open there, and a quote opens a
cell only at the cell's start. So each line turns one state, closed or open, into another. Such turns
compose associatively: every split is summed up for both states it may begin in, one scan over the splits
tells in which it does, and then each task cuts its own lines into records. Only pieces of records that
cross a split's border are shuffled. The cells are left to Spark's parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import cut_lineage, ship_package
from scrubline.sources.lines import is_blank_line, opens, stays_open

PATH, PART, BLOCK, ROW = "_path", "_part", "_block", "_row"
SPLIT = [PATH, BLOCK]
# splits of which the states are sent to all tasks, some 100 bytes each; beyond it they are joined
SPLITS_MOST = 200_000


def _states(opened: np.ndarray, stays: np.ndarray, state: bool) -> tuple[np.ndarray, bool]:
    """Whether a cell is open before each of the lines, and after the last."""
    turns = np.cumsum(opened & ~stays)
    fixed = np.where(opened == stays, np.arange(len(opened)), -1)
    last = np.maximum.accumulate(fixed)
    since = turns - np.where(last >= 0, turns[last], 0)
    after = np.where(last >= 0, opened[last], state) ^ (since % 2 == 1)
    return np.concatenate([[state], after[:-1]]), bool(after[-1])


def _runs(rows: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """The lines of each split, which come one after the other."""
    if rows.empty:
        return
    path, block = rows[PATH].to_numpy(), rows[BLOCK].to_numpy()
    new = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
    for begin, end in zip([0, *new], [*new, len(rows)]):
        yield (path[begin], int(block[begin])), rows.iloc[begin:end]


_SUMMARY = f"{PATH} string, {BLOCK} bigint, end0 boolean, end1 boolean, last0 bigint, last1 bigint"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split and state it may begin in: the state at its end, the row where its last record begins."""
    split, ends, lasts = None, [], []
    for rows in batches:
        for here, some in _runs(rows):
            if here != split:
                if split:
                    yield pd.DataFrame([(*split, *ends, *lasts)], columns=_names(_SUMMARY))
                split, ends, lasts = here, [False, True], [None, None]
            lines = [some[c].to_numpy() for c in ("opens", "stays")]
            for begin in (0, 1):
                before, ends[begin] = _states(*lines, ends[begin])
                starts = np.flatnonzero(~before & ~some["blank"].to_numpy())
                if len(starts):
                    lasts[begin] = int(some[ROW].iat[starts[-1]])
    if split:
        yield pd.DataFrame([(*split, *ends, *lasts)], columns=_names(_SUMMARY))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _begin_states(splits: DataFrame) -> DataFrame:
    """``inside`` of each split: whether it begins in a cell, and where the last record before it begins."""
    order = Window.partitionBy(PATH).orderBy(BLOCK)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)).over(order)
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int") - F.col("turns"))
    since = F.coalesce(F.last("fixed", True).over(earlier), F.lit(0))
    passed = F.coalesce(F.lag("turns").over(order), F.lit(0))
    last = F.when(F.col("inside"), F.col("last1")).otherwise(F.col("last0"))
    owner = F.when(F.col("last").isNotNull(), F.struct(BLOCK, F.col("last").alias(ROW)))
    return (
        splits.withColumn("turns", turns)
        .withColumn("fixed", fixed)
        .withColumn("inside", F.pmod(since + passed, F.lit(2)) == 1)
        .withColumn("last", last)
        .withColumn("owner", F.last(owner, True).over(earlier))
        .select(
            *SPLIT, "inside", F.col(f"owner.{BLOCK}").alias("owner_block"),
            F.col(f"owner.{ROW}").alias("owner_row"),
        )
    )


_PIECE = (
    f"{PATH} string, {PART} bigint, {BLOCK} bigint, {ROW} bigint, "
    "piece bigint, whole boolean, first boolean, text string"
)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records within a split, whole, and what a split has of records that cross its borders.

    A piece carries the place where its record begins, and its own split as the order of pieces.
    """
    split, state, record, lines, out = None, False, None, [], []

    def close(whole: bool) -> None:
        if record:
            out.append((*record[:4], split[1], whole and record[5], record[4], "\n".join(lines)))

    for rows in batches:
        for here, some in _runs(rows):
            part = int(some[PART].iat[0])
            if here != split:
                close(not state)
                split, state = here, bool(some["inside"].iat[0])
                record, lines = None, []
                fresh = bool(some["owner_block"].isna().iat[0])  # no record begins before this split
                if state:
                    owner = int(some["owner_block"].iat[0]), int(some["owner_row"].iat[0])
                    record = (here[0], part, *owner, False, False)
            before, state = _states(some["opens"].to_numpy(), some["stays"].to_numpy(), state)
            for text, row, inside, blank in zip(some["value"], some[ROW], before, some["blank"]):
                if inside:
                    lines.append(text)
                elif not blank:
                    close(True)
                    record, lines = (here[0], part, here[1], row, fresh, True), [text]
                    fresh = False
        if out:
            yield pd.DataFrame(out, columns=_names(_PIECE))
            out.clear()
    close(not state)
    if out:
        yield pd.DataFrame(out, columns=_names(_PIECE))


def find_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """Records of all files: ``_path, _part, _block, _row`` of the first line, ``first`` in its file, ``text``.

    ``lines`` are ``_path, _part, _block, _row, value`` as read, in order within each split. Line breaks in
    cells become ``\\n``. Blank lines between records are passed over. A cell that is never closed reaches
    to the end of its file.
    """
    ship_package(lines.sparkSession)
    text = F.col("value")
    told = lines.withColumns(
        {
            "blank": is_blank_line(text),
            "opens": opens(text, delimiter),
            "stays": stays_open(text, delimiter),
        }
    )
    summed = told.select(*SPLIT, ROW, "blank", "opens", "stays").mapInPandas(_summaries, _SUMMARY)
    splits = cut_lineage(_begin_states(cut_lineage(summed)))
    if splits.count() <= SPLITS_MOST:
        placed = told.join(F.broadcast(splits), SPLIT)
    else:
        placed = told.join(splits, SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, ROW)
    pieces = cut_lineage(placed.mapInPandas(_pieces, _PIECE))
    place = [PATH, PART, BLOCK, ROW]
    ordered = F.array_sort(F.collect_list(F.struct("piece", "text")))
    crossing = (
        pieces.filter(~F.col("whole"))
        .groupBy(*place)
        .agg(F.some("first").alias("first"), F.array_join(ordered["text"], "\n").alias("text"))
    )
    return pieces.filter("whole").select(*place, "first", "text").unionByName(crossing)

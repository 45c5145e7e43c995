"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes: in each round the next bytes of a text are its digit, and
the group it belongs to is split by that digit. A group of one is done, and so is a group whose
texts end in the digit. Only groups of two or more that go on reach the next round, and only with
the bytes they have left. The first round moves one digit of each text, and texts move only if they
go on. Digits widen eightfold from round to round, so a text of n bytes takes
about log8(n) rounds. Texts are compared byte by byte; no digest decides equality.

A digit's group is one counted row before it meets the documents, so a group that holds a third of
all rows is summed inside the tasks, and the join that brings the count back is an ordinary
skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held

FIRST_DIGIT = 24
WIDENING = 8
MAX_DIGIT = 1 << 26
BROADCAST_ROWS = 1_000_000  # row numbers sent to the tasks; with more the texts are moved to them


def normalized(text: Column) -> Column:
    """Each run of white space (tab to carriage return, space) as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT
) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null texts equal empty ones. Of equal texts the smallest doc_id stays; a null doc_id stays only
    where its whole group has null ids (``keep_id`` is then null). Rows that repeat a doc_id with
    the same text all count in ``group_size`` and all are marked kept if that id stays. An empty
    table gives an empty result, and columns other than the two are not read. ``text_sha256``
    describes the text and takes no part in grouping.
    """
    rows = _numbered(docs.select(F.col(key), F.col(text)), key)
    return _groups(rows, text, first_digit).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """``row``, ``doc_id`` and the row as it came, held once so that the numbers stay."""
    number = F.monotonically_increasing_id().alias("row")
    return held(docs.select(number, F.col(key).alias("doc_id"), F.struct("*").alias("whole")), "rows")


def _groups(rows: DataFrame, text: str, first_digit: int) -> DataFrame:
    """``row``, ``doc_id``, ``keep_id``, ``keep_row``, ``group_size``, ``text_sha256`` of every row."""
    body = normalized(F.col("whole").getField(text).cast("string"))
    texts = rows.select(
        "row", "doc_id", F.sha2(body, 256).alias("text_sha256"), body.cast("binary").alias("rest")
    )
    named = ["row", "doc_id", "text_sha256"]
    result = [*named[:2], "keep_id", "keep_row", "group_size", named[2]]
    # the first round moves a digit of each text; most are alone after it
    state = texts.withColumn("gid", F.lit(0).cast("bigint"))
    table = held(_split(state, first_digit, [*named]), "radix")
    finished = table.where("done").select(*result)
    going = table.where("not done").select("row", F.col("next_gid").alias("gid"))
    count = going.count()
    if not count:
        return finished
    going = F.broadcast(going) if count <= BROADCAST_ROWS else going
    rest = F.expr(f"substring(rest, {first_digit + 1})").alias("rest")
    state, width = texts.join(going, "row").select(*named, "gid", rest), first_digit
    while True:
        width = min(width * WIDENING, MAX_DIGIT)
        left = F.when(~F.col("done"), F.expr(f"substring(rest, {width + 1})")).alias("rest")
        table = held(_split(state, width, [*named, "rest"]).withColumn("rest", left), "radix")
        finished = finished.unionByName(table.where("done").select(*result))
        state = table.where("not done").select(*named, F.col("next_gid").alias("gid"), "rest")
        if state.isEmpty():
            return finished


def _split(state: DataFrame, width: int, kept: list[str]) -> DataFrame:
    """One round: the columns kept, and each row's group in it.

    A group is named by its least row number, which no other group can have. ``keep_row`` is the
    row of the smallest id, of several the least; nulls come last.
    """
    digits = state.select(
        *kept,
        *[c for c in ("row", "doc_id") if c not in kept],
        "gid",
        F.expr(f"substring(rest, 1, {width})").alias("digit"),
        (F.length("rest") <= width).alias("ends"),
    )
    by = ["gid", "digit", "ends"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")
    counted = (
        digits.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("row").alias("next_gid"), first)
        .where("group_size > 1")
        .select(
            *by, "group_size", "next_gid",
            F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
        )
    )
    joined = digits.join(counted, by, "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        *kept,
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        "next_gid",
        (alone | F.col("ends")).alias("done"),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names.

    The row with the smallest id stays, one of those that repeat it; a null id stays where the
    whole group has none. Null texts equal empty ones; an empty table stays empty.
    """
    rows = _numbered(docs, key)
    groups = _groups(rows, text, FIRST_DIGIT)
    stay = groups.where("row = keep_row").select("row")
    return rows.join(stay, "row", "left_semi").select("whole.*")

"""Left lookup join that broadcasts only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
# classes that keys are counted in; also the most salts of a key
KEY_CLASSES = 4096
# types whose equal values have equal hashes on both sides of a join
_HASHED = {"string", "binary", "boolean", "byte", "short", "integer", "long", "date", "timestamp", "decimal"}


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of a table's size: a fixed charge per cell plus the length of its texts."""
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if field.dataType.typeName() == "string":
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            text = F.to_json(F.struct(field.name))
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return df.agg(F.sum(size).alias("b")).first()["b"] or 0


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit_bytes


def _key_class(big: DataFrame, small: DataFrame, on: list[str]) -> Column | None:
    """Class of a row's key, the same on both sides; none if the keys' types do not allow one."""
    sure = [
        c for c in on
        if big.schema[c].dataType == small.schema[c].dataType
        and big.schema[c].dataType.typeName().split("(")[0] in _HASHED
    ]
    return F.pmod(F.xxhash64(*sure), F.lit(KEY_CLASSES)).cast("int") if sure else None


def salted_sides(
    big: DataFrame, small: DataFrame, on: list[str], spread: Column
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a ``_salt`` that divides each key by how many rows ``big`` has of it.

    All rows are counted in ``KEY_CLASSES`` classes of keys, combined inside each task. A class with more
    rows than the average gets salts in proportion, any other one. So a salt has about an average class of
    rows at most, whatever a key's share, and only the keys of crowded classes are repeated: the salts of
    all classes together are less than twice the classes.
    """
    key = _key_class(big, small, on)
    if key is None:
        return big.withColumn("_salt", F.lit(0)), small.withColumn("_salt", F.lit(0))
    counts = big.groupBy(key.alias("_class")).agg(F.count(F.lit(1)).alias("_rows"))
    every = cut_lineage(counts)
    mean = (every.agg(F.sum("_rows")).first()[0] or 0) / KEY_CLASSES
    crowded = every.select("_class", F.ceil(F.col("_rows") / F.lit(max(mean, 1.0))).cast("int").alias("_salts"))
    crowded = F.broadcast(crowded.filter("_salts > 1"))  # at most a row per class
    salts = F.coalesce("_salts", F.lit(1))
    some = F.pmod(F.xxhash64(spread), salts).cast("int")
    divided = big.withColumn("_class", key).join(crowded, "_class", "left").withColumn("_salt", some)
    repeated = (
        small.withColumn("_class", key)
        .join(crowded, "_class", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    )
    return divided.drop("_class", "_salts"), repeated.drop("_class", "_salts")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: Column,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``big`` left-joined to ``small``, which holds at most one row per key.

    ``small`` is materialized and measured. Within ``limit_bytes`` it is broadcast. Beyond it both
    sides shuffle on key and salt (see ``salted_sides``): ``spread``, any expression that varies within a
    key, divides the rows of a hot key over as many salts as its share of the rows asks for.
    """
    held = cut_lineage(small)
    if measured_bytes(held) <= limit_bytes:
        return big.join(F.broadcast(held), on, "left")
    divided, repeated = salted_sides(big, held, on, spread)
    return divided.join(repeated, [*on, "_salt"], "left").drop("_salt")

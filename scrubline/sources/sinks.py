"""Writing cleaned datasets: staged files, final names and the audit table."""

from __future__ import annotations

import json
import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_OUT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: describes a written dataset; Spark's readers pass over names that start with an underscore
MANIFEST = "_manifest.json"
ASIDE = "_previous-"


def target_of(source: str, folder: str | None, suffix: str, inplace: bool) -> str:
    """Where the cleaned dataset of an input goes.

    In place it takes the input's own path. Otherwise the suffix goes before the last dot of the
    name (a leading dot is part of the name, and a name without one ends in ``.csv``).
    """
    if inplace:
        return source
    parent, slash, name = source.rpartition("/")
    dot = name.rfind(".")
    kind = name[dot:] if dot > 0 else ".csv"
    renamed = name[: dot if dot > 0 else None] + suffix + kind
    return f"{folder.rstrip('/')}/{renamed}" if folder else f"{parent}{slash}{renamed}"


def store_of(path: str) -> str:
    """Scheme and authority; files are renamed only inside one store."""
    found = re.match("[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", path)
    return found[0] if found else ""


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", mode: str = "error") -> None:
    """A folder of delimited part files, minimal quoting, header in each part."""
    df.write.options(**CSV_OUT).option("sep", delimiter).mode(mode).csv(path)


def write_small_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One CSV file, for results whose plan already bounds them (a top-k report)."""
    df.coalesce(1).write.options(**CSV_OUT).mode(mode).csv(path)


def stage_path(spark: SparkSession, folder: str) -> str:
    return posixpath.join(folder, f"_staging-{uuid.uuid4().hex}")


def write_staged(
    df: DataFrame, dataset: str, columns: list[str], order: list[str], staging: str,
    delimiter: str,
) -> None:
    """Write all datasets of ``df`` below ``staging``, one folder per value of ``dataset``.

    Range partitioning by dataset and row order gives even parts: a small dataset lands in one
    part, a large one spans many, and its parts read in name order give the input's order.
    """
    placed = df.repartitionByRange(dataset, *order).sortWithinPartitions(dataset, *order)
    out = placed.select(F.col(dataset).alias("dataset"), *columns)
    out.write.partitionBy("dataset").options(**CSV_OUT).option("sep", delimiter).csv(staging)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a staging folder that this job made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*parts)


def _store(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a written dataset; None if the folder is no such dataset."""
    path = _path(spark, folder, MANIFEST)
    fs = _store(spark, path)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, folder: str, source: str, generation: int) -> None:
    path = _path(spark, folder, MANIFEST)
    fs = _store(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(_path(spark, folder)))
    parts = [n for n in names if not n.startswith(("_", "."))]
    text = json.dumps({"source": source, "generation": generation, "parts": parts}, indent=1)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def recover(spark: SparkSession, target: str) -> bool:
    """Put back what a swap that broke off had moved aside; whether anything was."""
    path = _path(spark, target)
    if path.getParent() is None:
        return False
    aside, fs = _path(spark, path.getParent(), ASIDE + path.getName()), _store(spark, path)
    if fs.exists(path) or not fs.exists(aside):
        return False
    if not fs.rename(aside, path):
        raise OSError(f"could not move {aside} back to {target}")
    return True


def recover_folder(spark: SparkSession, folder: str) -> None:
    """``recover`` for every dataset of a folder."""
    path = _path(spark, folder)
    for status in _store(spark, path).listStatus(path):
        name = status.getPath().getName()
        if name.startswith(ASIDE):
            recover(spark, _path(spark, path, name[len(ASIDE) :]).toString())


def swap_in(
    spark: SparkSession, staging: str, finals: dict[str, str], sources: dict[str, str], overwrite: bool
) -> list[str]:
    """Move each staged folder ``dataset=<id>`` to its final path, then drop the staging folder.

    A staged dataset is complete with its manifest before anything moves. What it replaces is moved
    aside under a fixed name, which ``recover`` finds if the job ends between the two renames, and
    removed only after its successor is in place. Gives the ids of datasets without rows, for which
    nothing was staged.
    """
    rowless = []
    fs = _store(spark, _path(spark, staging))
    for dataset, final in finals.items():
        source, target = _path(spark, staging, f"dataset={dataset}"), _path(spark, final)
        if not fs.exists(source):
            rowless.append(dataset)
            continue
        recover(spark, final)
        before = manifest_of(spark, final) if fs.exists(target) else None
        _write_manifest(spark, source.toString(), sources[dataset], (before or {"generation": 0})["generation"] + 1)
        aside = None
        if fs.exists(target):
            if not overwrite:
                raise FileExistsError(final)
            aside = _path(spark, target.getParent(), ASIDE + target.getName())
            fs.delete(aside, True)  # of a swap that ended before this last step
            if not fs.rename(target, aside):
                raise OSError(f"could not move {final} aside")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            if aside is not None:
                fs.rename(aside, target)
            raise OSError(f"could not move {source} to {final}")
        if aside is not None:
            fs.delete(aside, True)
    fs.delete(_path(spark, staging), True)
    return rowless

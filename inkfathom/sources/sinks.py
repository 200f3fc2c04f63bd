"""Keyed upserts and checked vector tables on Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _file_system(df: DataFrame, path: str):
    spark = df.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write beside the table, then put it in the old one's place. A failed write
    or rename leaves the old; between the two renames there is no table for a moment."""
    staged = f"{path}.{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    fs, target, make = _file_system(df, path)
    old = make(f"{staged}.old")
    swap(fs, target, make(staged), old)


def swap(fs, target, staged, old) -> None:
    """Puts ``staged`` in ``target``'s place. Where a rename fails the old table is
    put back, and nothing is deleted before the new one stands."""
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{target} could not be moved; it stands as it was, the new table is at {staged}")
    try:
        done = fs.rename(staged, target)
    except Exception:
        done = False
    if not done:
        back = not had or fs.rename(old, target)
        raise OSError(f"{staged} could not be moved to {target}; the old table is {'there' if back else f'at {old}'}")
    if had:
        fs.delete(old, True)


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """The table's rows whose key is not among ``rows``, and ``rows``."""
    fs, target, _ = _file_system(rows, path)
    if fs.exists(target):
        old = rows.sparkSession.read.parquet(path)
        rows = old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    replace(rows, path)


def write_vectors(vectors: DataFrame, path: str, dim: int, version: str = "v1") -> None:
    """Vectors of just ``dim`` numbers; any other fails the write. Partitioned by version."""
    checked = vectors.withColumn(
        "vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} numbers")))
    )
    replace(checked.withColumn("embedding_version", F.lit(version)), path, "embedding_version")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON row a line."""
    report.write.mode("overwrite").json(path)


def markdown_table(report: DataFrame) -> DataFrame:
    """A report's rows as lines of a Markdown table."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns))
    return report.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def keep_labels(df: DataFrame, label: str, preserved: list[str], dry_run: bool = True) -> DataFrame:
    """What a clean-up removes, counted by label, or the rows it leaves."""
    if dry_run:
        return df.where(~F.col(label).isin(*preserved)).groupBy(label).agg(F.count("*").alias("removed"))
    return df.where(F.col(label).isin(*preserved))

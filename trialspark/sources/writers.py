"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """Parquet, parted by a column if given; an existing table is kept unless overwrite."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, names: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """CSV with a header; names renames columns. Arrays and structs are written as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.withColumnsRenamed(names or {}).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the parts of a parted table that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def save_ids(df: DataFrame, path: str, column: str, overwrite: bool = False) -> None:
    """One id a line, in order within each file."""
    df.select(F.col(column).cast("string")).sortWithinPartitions(column).write.mode("overwrite" if overwrite else "errorifexists").text(path)

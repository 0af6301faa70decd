"""Ranks, running counts and neighbours in the order of a whole table, without one task that holds a whole key.

Rows are dealt by range of (keys, order), so that a key with very many rows spreads over parts; each part is sorted by
itself and a summary with a row per key and part carries what lies before. The dealt table is written to the shared
folder first, since both passes must see the same parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "_part"
_PATHS: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The table written below spark.checkpoint.dir (where that is unset, below the warehouse) and read again."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    path = f"{top.rstrip('/')}/ordered-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_stored(spark) -> None:
    """Deletes all tables that `stored` wrote in this process; results that were not read yet are lost."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt by range of keys and order, with the number of each row's part."""
    return stored(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def _same(keys: list[str]) -> list:
    return [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col(PART) == F.col("_s_part")]


def _with_summary(parts: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the columns of a summary of (keys, part); null keys are keys too."""
    renamed = summary.withColumnsRenamed({**{k: f"_s_{k}" for k in keys}, PART: "_s_part"})
    match = _same(keys)[0]
    for m in _same(keys)[1:]:
        match = match & m
    return parts.join(renamed, match, "left").drop(*(f"_s_{k}" for k in keys), "_s_part")


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number of each row, from 1, in order over the whole table (nulls first)."""
    parts = dealt(df, [], order)
    sizes = parts.groupBy(PART).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = _with_summary(parts, sizes.select(PART, before.alias("_before")), [])
    number = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) + F.col("_before")
    return told.withColumn(name, number.cast("int")).drop(PART, "_before")


def following(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with the next row's value of order within keys; null for the last."""
    parts = dealt(df, keys, [order])
    ends = parts.groupBy(*keys, PART).agg(F.min(order).alias("_least"))
    summary = ends.select(*keys, PART, F.lead("_least").over(Window.partitionBy(*keys).orderBy(PART)).alias("_ahead"))
    told = _with_summary(parts, summary, keys)
    return told.withColumn(name, F.coalesce(F.lead(order).over(Window.partitionBy(*keys, PART).orderBy(order)), F.col("_ahead"))).drop(PART, "_ahead")


def value_places(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total, next): of each distinct value how often it occurs, how many values are less, how
    many there are in all, and the next greater one."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = dealt(counts, keys, [value])
    sums = parts.groupBy(*keys, PART).agg(F.sum("n").alias("_n"), F.min(value).alias("_least"))
    w = Window.partitionBy(*keys).orderBy(PART)
    summary = sums.select(
        *keys,
        PART,
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"),
        F.lead("_least").over(w).alias("_least"),
    )
    told = _with_summary(parts, summary, keys)
    inner = Window.partitionBy(*keys, PART).orderBy(value)
    before = F.col("_before") + F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.coalesce(F.lead(value).over(inner), F.col("_least"))
    return told.select(*keys, value, "n", before.alias("before"), "total", following.alias("next"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], mark: Column, before: str, after: str) -> DataFrame:
    """df with the last value of mark that is not null at or before each row, and the first at or after it."""
    parts = dealt(df.withColumn("_mark", mark), keys, order)
    backward = [F.col(c).desc() for c in order]
    up, down = Window.partitionBy(*keys, PART).orderBy(*order), Window.partitionBy(*keys, PART).orderBy(*backward)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    held = parts.filter(F.col("_mark").isNotNull())
    place = F.struct(*order)
    ends = held.groupBy(*keys, PART).agg(F.max_by("_mark", place).alias("_last"), F.min_by("_mark", place).alias("_first"))
    every = parts.select(*keys, PART).distinct()
    ends = _with_summary(every, ends, keys)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = ends.select(*keys, PART, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"), F.last("_first", ignorenulls=True).over(later).alias("_ahead"))
    told = _with_summary(parts, summary, keys)
    found = told.withColumns({before: F.coalesce(F.last("_mark", ignorenulls=True).over(so_far(up)), F.col("_carried")), after: F.coalesce(F.last("_mark", ignorenulls=True).over(so_far(down)), F.col("_ahead"))})
    return found.drop(PART, "_mark", "_carried", "_ahead")

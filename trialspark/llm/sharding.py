"""Shards along a Hilbert curve over several metadata dimensions, so that files can be skipped by any of them.

1. Quantise: a dimension's values are counted, dealt by range, and a value's cell is 2**bits times the share of rows with
   lesser values (nulls last). Cells are thus near equally full whatever the values are, and a value that a third of all
   rows has only leaves cells empty. Only the least value of each cell is collected, at most 2**bits a dimension.
2. Index: the cells' bits are turned into the place on the curve, level by level, in DataFrame expressions.
3. Order and cut: rows go by (place, MD5 of the text, id), dealt by range, so that one place may hold any number of rows;
   counts of the parts give each row its number, and shard s of S takes numbers N * s / S up to N * (s + 1) / S. Counts of
   shards are at most one apart (law `rows`). Equal texts of one place follow each other.

The law `rows` is chosen because it can be kept whatever the texts' sizes are; a text may be larger than a shard's share.

Edge cases: a null or empty text has size 1 and CRC 0; null values of a dimension, and null ids, are values too; rows that
repeat are rows of their own; fewer rows than shards leave shards empty; an empty table gives an empty result; other
columns, whatever their names, are kept by `write_shards` and dropped by the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import crc32_sql, discard, documents, stored
from trialspark.operators.ordered import PART, value_places

SHARDS, BITS = 16, 5
DIMENSIONS = ("lang", "source", "size")


def cell_bounds(rows: DataFrame, dim: str, bits: int) -> list[tuple[object, int]]:
    """(least value, cell) of the cells of a dimension that have values, in order; null last."""
    n = rows.agg(F.count("*").alias("n"), F.count(dim).alias("told")).first()
    places = value_places(rows.filter(F.col(dim).isNotNull()).select(F.lit(0).alias("_one"), dim), ["_one"], dim)
    cell = F.floor(F.col("before") * (1 << bits) / F.lit(n["n"])).cast("int").alias("cell")
    bounds = sorted((r["least"], r["cell"]) for r in places.groupBy(cell).agg(F.min(dim).alias("least")).collect())  # at most 2**bits
    return bounds + ([(None, n["told"] * (1 << bits) // n["n"])] if n["told"] < n["n"] else [])


def cell_of(value: Column, bounds: list[tuple[object, int]]) -> Column:
    """The cell of the greatest bound that isn't above value."""
    missing = next((c for v, c in bounds if v is None), 0)
    told = [(v, c) for v, c in reversed(bounds) if v is not None]
    return reduce(lambda out, b: out.when(value >= F.lit(b[0]), b[1]), told, F.when(F.lit(False), missing)).otherwise(missing)


def _turns(n: int) -> tuple[list[int], list[int]]:
    """Where the curve enters each of the 2**n sub-cubes in its order, and along which axis it passes it."""
    gray = lambda x: x ^ x >> 1
    ones = lambda x: (~x & x + 1).bit_length() - 1  # trailing ones
    entry = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    axis = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    return entry, axis


def _steps(n: int) -> list[int]:
    """For state (axis * 2**n + entry) * 2**n + point the place in the level's order and the next state, as state * 2**n + place."""
    entry, axis = _turns(n)
    size, mask, out = 1 << n, (1 << n) - 1, []
    for a in range(n):
        turn = (a + 1) % n
        for e in range(size):
            for point in range(size):
                p = point ^ e
                w = (p >> turn | p << n - turn) & mask
                for k in range(1, n):  # the Gray code's inverse
                    w ^= ((p >> turn | p << n - turn) & mask) >> k
                to = e ^ ((entry[w] << turn | entry[w] >> n - turn) & mask)
                out.append((((a + axis[w] + 1) % n * size + to) << n) + w)
    return out


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place of a point of n cells of `bits` bits on the Hilbert curve; entry point and axis are carried from level to level."""
    n = len(cells)
    steps, size = F.lit(_steps(n)), 1 << n

    def step(state, level):
        bit = lambda c: F.call_function("shiftright", c, level).bitwiseAND(1)
        point = reduce(lambda a, b: a + b, (bit(c) * (1 << j) for j, c in enumerate(cells)))
        return F.struct((state["place"] * size + F.pmod(F.get(steps, state["at"] + point), F.lit(size))).alias("place"), (F.floor(F.get(steps, state["at"] + point) / size) * size).cast("int").alias("at"))

    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["place"])


def curve_ordered(rows: DataFrame, dims: tuple[str, ...], ties: list[str], bits: int = BITS) -> DataFrame:
    """rows with `_place` on the curve over dims and `_nth`, their number from 0 by (place, ties), and `_total`."""
    if not 2 <= len(dims) or len(dims) * bits > 62:
        raise ValueError("two dimensions or more, of at most 62 bits together")
    if rows.isEmpty():
        return rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("_place", "_nth", "_total")))
    cells = {f"_cell{j}": cell_of(F.col(d), cell_bounds(rows, d, bits)).cast("int") for j, d in enumerate(dims)}
    order = ["_place", *ties, "_row"]  # _row parts rows that repeat, which may come in any order
    placed = rows.withColumns(cells).withColumn("_place", hilbert_index([F.col(c) for c in cells], bits)).drop(*cells).withColumn("_row", F.monotonically_increasing_id())
    parts = stored(placed.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "curve")
    sizes = parts.groupBy(PART).agg(F.count("*").alias("_n"))  # a row a part
    before = F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(PART, before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    return parts.join(F.broadcast(starts), PART).withColumn("_nth", nth).drop(PART, "_before", "_row")


def cut(ordered: DataFrame, shards: int = SHARDS) -> DataFrame:
    """ordered rows with `shard` and `slot`, their number in it."""
    shard = F.expr(f"(_nth * {shards}) div _total")
    first = F.expr(f"(_total * shard + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_nth") - first)


def _slim(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_md5"), *more)


def shard_plan(docs: DataFrame, dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, shard and slot of docs (doc_id, text, lang, source); dims are among these."""
    slim = stored(_slim(docs), "sharding")  # texts are read once
    out = cut(curve_ordered(slim, dims, ["_md5", "doc_id"], bits), shards)
    return out.drop("_md5", "_place", "_nth", "_total")


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> None:
    """Writes docs as Parquet below path, a folder shard=k each, rows in the curve's order, so that the files' statistics
    tell which of them a filter on a dimension can skip."""
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    slim = stored(_slim(whole, "row"), "sharding")
    out = cut(curve_ordered(slim, dims, ["_md5", "doc_id"], bits), shards)
    rows = out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "shard"), "shard", F.col("slot").alias("_slot"))
    rows.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
    discard(slim)


def shard_bounds(plan: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Per shard its rows, bytes and the least and greatest value of each dimension: what a reader prunes by."""
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("greatest", F.max))]
    return plan.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql() -> str:
    entry, axis = _turns(3)
    mask, turn = 7, "(axis + 1) % 3"
    p = f"((((p >> {turn}) | (p << (3 - {turn}))) & {mask}))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS crc, md5(coalesce(text, '')) AS k FROM documents),
q AS (SELECT *, count(*) OVER () AS n, {", ".join(f"((rank() OVER (ORDER BY {c} NULLS LAST) - 1) * {1 << BITS} // count(*) OVER ())::INT AS c{j}" for j, c in enumerate(DIMENSIONS))} FROM d),
h AS (SELECT DISTINCT c0, c1, c2, {BITS} AS level, 0::BIGINT AS place, 0 AS entry, 0 AS axis FROM q UNION ALL
    SELECT c0, c1, c2, level, place * 8 + w, xor(entry, ((e << {turn}) | (e >> (3 - {turn}))) & {mask}), (axis + {axis}[w + 1] + 1) % 3 FROM (SELECT *, {entry}[w + 1] AS e FROM (
        SELECT *, xor(xor(r, r >> 1), xor(r, r >> 1) >> 2) AS w FROM (SELECT *, {p} AS r FROM (
            SELECT * REPLACE (level - 1 AS level), xor(((c0 >> (level - 1)) & 1) | (((c1 >> (level - 1)) & 1) << 1) | (((c2 >> (level - 1)) & 1) << 2), entry) AS p FROM h WHERE level > 0))))),
o AS (SELECT q.*, row_number() OVER (ORDER BY place, k, doc_id NULLS FIRST) - 1 AS i FROM q JOIN h USING (c0, c1, c2) WHERE level = 0)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (i * {SHARDS} // n)::INT AS shard, (i - (n * (i * {SHARDS} // n) + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM o
"""


OP12_SQL = _sql()

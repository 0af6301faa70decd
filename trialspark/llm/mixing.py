"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key. The range of keys is cut into equal buckets, so (source, bucket) groups are
small and even however hot a source is; documents are sorted within them. Sums per bucket, made map-side first, give
each bucket's offset within its source, and a window within the bucket gives each document's prefix sum. A source's
budget is cut at exactly its number of words: whole epochs first, then the part of one more epoch that is left, the
document at the cut being taken in part.

Edge cases: a null text has size 0 and is taken 0 times; null sources form one source, ordered last; rows that repeat
an id are documents of their own, in an order that does not matter since they have equal keys and are cut in order of
size; an empty table gives an empty result; other columns, whatever their names, are dropped by `mix_plan` and kept by
`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import documents, id_key, packed, stored, word_count

#: A source's target is at most so many times its size.
MAX_EPOCHS = 3
SEED = "mix-1"


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to a table with a row per source (weight, source_size): weights share the sum of all sizes, no
    target is above max_epochs * source_size, and what is over is shared again by weight.

    The shares' common factor is found in one pass: sources in order of cap / weight are capped for as long as the
    factor that is left for the rest reaches their ratio.
    """
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_order").rowsBetween(Window.unboundedPreceding, -1)
    cap = (max_epochs * F.col("source_size")).cast("double")
    ranked = (
        sources.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_factor", F.col("_left") / F.col("_weights"))
    )
    free = F.min(F.when(F.col("_factor") < F.col("_ratio"), F.struct("_ratio", "_order", "_factor"))).over(every)
    factor = free["_factor"]
    target = F.when(factor.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), factor * F.col("weight")))
    return ranked.withColumn("target", target).drop("_cap", "_ratio", "_left", "_weights", "_factor")


def mix_plan(docs: DataFrame, weight: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED, buckets: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs (doc_id, text, source), and columns
    `more` (expressions over docs).

    weight: a source's weight, an expression of `position` (sources by code point, null last, from 0); by default
    1, 2, 3 and again.
    """
    weight = (F.col("position") % 3 + 1) if weight is None else weight
    buckets = buckets or 4 * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    slim = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_null"),
        word_count(F.col("text")).alias("size"),
        key.alias("_key"),
        *(c.alias(n) for n, c in (more or {}).items()),
    ).withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    slim = stored(slim, "sizes")  # words are counted once for the sums and for the places
    sums = slim.groupBy("_null", "_name", "_bucket").agg(F.sum("size").alias("_sum"))
    in_source = Window.partitionBy("_null", "_name")
    order = Window.orderBy("_null", "_name")
    sources = sums.groupBy("_null", "_name").agg(F.sum("_sum").alias("source_size"))
    sources = sources.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", weight)
    sources = targets(sources.withColumn("_order", F.col("position")), max_epochs)
    offsets = sums.withColumn("_before", F.sum("_sum").over(in_source.orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    offsets = offsets.join(sources.select("_null", "_name", "source_size", "target"), ["_null", "_name"])
    within = Window.partitionBy("_null", "_name", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("_upto", F.sum("size").over(within)).join(offsets, ["_null", "_name", "_bucket"])
    start = F.col("_before") + F.col("_upto") - F.col("size")
    words = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select(
        "doc_id",
        F.when(~F.col("_null"), F.col("_name")).alias("source"),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        *(more or {}),
    )


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a number within keys, from 0, however many have the same keys: rows are numbered within the tasks that
    wrote them, after those of the tasks before."""
    parts = stored(rows.withColumn("_part", F.spark_partition_id()), "equal-rows")
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.lit(0))) - 1
    return parts.join(sizes.select(*keys, "_part", before.alias("_before")), [*keys, "_part"]).withColumn(name, F.col("_before") + nth).drop("_part", "_before")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (in place of columns of docs of these
    names); those never taken are left out. Of rows equal in id, text and source, as many are taken, and with as many
    words, as the plan takes; which of them doesn't matter."""
    told, keys = ["size", "source_size", "target", "taken"], ["_key", "_tag"]
    tag = F.coalesce(F.xxhash64("text", "source"), F.lit(0))
    rows = packed(docs, id_key("doc_id").alias("_key"), tag.alias("_tag"))
    plan = mix_plan(docs, more={"_tag": tag}, **options)
    by_taken = plan.groupBy(id_key("doc_id").alias("_key"), "_tag", "taken").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in told[:3]))
    # Equal rows are next to each other in the plan, so that they are taken whole, in part once, or not at all.
    least = Window.partitionBy(*keys).orderBy(F.col("taken").desc())
    shares = stored(by_taken.withColumn("_to", F.sum("_n").over(least)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))), "shares")
    taken = shares.filter("taken > 0")
    alone = rows.join(taken.filter("_all = 1").select(*keys, *told), keys)
    out = alone.select("row", *told)
    if not (repeated := taken.filter("_all > 1")).isEmpty():
        equal = _numbered(rows.join(repeated.select(*keys).distinct(), keys, "left_semi"), keys, "_nth")
        spans = repeated.select(F.col("_key").alias("_k"), F.col("_tag").alias("_t"), (F.col("_to") - F.col("_n")).alias("_from"), "_to", *told)
        within = (F.col("_key") == F.col("_k")) & (F.col("_tag") == F.col("_t")) & (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))
        out = out.unionByName(equal.join(spans, within).select("row", *told))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in told), *told)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).drop("source")


#: Buckets don't matter to the result: prefix sums run in order of the key within the source. Capped sources: those
#: whose ratio 3 * size / weight is at most the factor; it is the least of all factors that the rest could get.
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s),
f AS (SELECT a.ratio, (SELECT sum(source_size) FROM s) - coalesce(sum(b.cap), 0) AS part,
             (SELECT sum(w) FROM s) - coalesce(sum(b.w), 0) AS ws
      FROM (SELECT DISTINCT ratio FROM r) a LEFT JOIN r b ON b.ratio < a.ratio GROUP BY a.ratio),
g AS (SELECT part::DOUBLE / ws AS factor FROM f WHERE part::DOUBLE / ws < ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT factor FROM g) IS NULL THEN cap
             ELSE least(cap, w * (SELECT factor FROM g)) END AS target FROM r),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
       + greatest(0, least(size, words % source_size - pos)) END::BIGINT AS taken FROM p
"""

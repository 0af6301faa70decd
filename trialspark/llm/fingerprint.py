"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set of terms (its words, weighted by how often they occur). For each slot of the signature a
term k of weight S draws, by hash of (k, slot), r and c from Gamma(2, 1) and b from U(0, 1); with
t = floor(ln S / r + b) it scores ln a = ln c - r (t - b + 1). The slot keeps the least score of all terms: the score is
a function of (k, t) alone, so two documents share a slot exactly if they sampled the same (k, t), which happens with
the probability of their generalised Jaccard similarity, sum of least weights over sum of greatest.

Words are counted and slots filled within the task that holds the document, so no shuffle carries terms.

Edge cases: a null text is empty; a text without words has the fingerprint '' and is 1.0 like another such one and 0.0
like any other; rows that repeat an id each get a row (their next document is the one with the next lower id, and of
several rows with that id the one with the least hash of its text); rows that repeat an id and a text are worked on once
and put out as often; a null id counts as the least id; an empty table gives an empty result; other columns, whatever
their names, are not used.

Error: with s slots the likeness of two texts of similarity j has a deviation of sqrt(j (1 - j) / s), at most 0.11 for
24 slots and 0.05 for 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import documents, id_key, stored

SLOTS = 24
SEED = 7


def slot_score(term, weight, slot: int, seed: int = SEED) -> F.Column:
    """ln a of a term's hash (long) and its weight's logarithm in one slot."""
    first, second, third = (F.xxhash64(term, F.lit(3 * slot + k + 1000 * seed)) for k in range(3))
    unit = lambda bits: (bits + 1) / F.lit(float((1 << 32) + 1))
    high = lambda h: unit(F.shiftrightunsigned(h, 32))
    low = lambda h: unit(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    r = -F.ln(high(first) * low(first))
    log_c = F.ln(-F.ln(high(second) * low(second)))
    b = high(third)
    t = F.when(weight == 0, F.lit(0)).otherwise(F.floor(weight / r + b))
    return log_c - r * (t - b + 1)


def signatures(texts: DataFrame, keys: list[str], text: str = "text", slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """keys and `signature` (array of longs) of every row of texts that has words; keys must tell rows apart.

    Where texts is already partitioned by (some of) keys, this adds no shuffle.
    """
    words = texts.select(*keys, F.explode(F.split(F.col(text), "[\\x20\\x09-\\x0D]+")).alias("_word")).filter("_word <> ''")
    counts = words.select(*keys, F.xxhash64("_word").alias("_term")).groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_weight", F.ln("_n"))
    least = counts.groupBy(*keys).agg(*(F.min(slot_score(F.col("_term"), F.col("_weight"), k, seed)).alias(f"_s{k}") for k in range(slots)))
    return least.select(*keys, F.array(*(F.xxhash64(f"_s{k}") for k in range(slots))).alias("signature"))


def fingerprint(signature) -> F.Column:
    """A signature as a string of 8 hex digits a slot; '' where there is none."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.coalesce(F.array_join(digits, ""), F.lit("")))


def likeness(a, b, slots: int = SLOTS) -> F.Column:
    """Share of equal slots: an estimate of generalised Jaccard similarity."""
    equal = sum(((F.get(a, F.lit(k)) == F.get(b, F.lit(k))).cast("int") for k in range(1, slots)), (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("int"))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal / slots)


def following(keys: DataFrame) -> DataFrame:
    """(_key, _next): of each distinct key the next lower one, and of the lowest the highest.

    Keys are dealt by range and ordered within each part; a summary with a row per part joins the parts' ends.
    """
    dealt = keys.distinct().repartitionByRange(F.col("_key").desc()).withColumn("_part", F.spark_partition_id())
    in_part = Window.partitionBy("_part").orderBy(F.col("_key").desc())
    inner = dealt.withColumn("_next", F.lead("_key").over(in_part)).withColumn("_top", F.first("_key").over(in_part))
    checked = stored(inner, "following")  # both uses below must see the same parts
    tops = checked.filter("_key = _top").select("_part", "_top")
    order = Window.orderBy(F.col("_part"))
    links = tops.withColumn("_after", F.coalesce(F.lead("_top").over(order), F.first("_top").over(order))).select("_part", "_after")
    return checked.join(links, "_part").select("_key", F.coalesce("_next", "_after").alias("_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str, slots: int = SLOTS) -> DataFrame:
    table = documents(spark, sf_dir)
    same = ["_key", "_tag"]
    tagged = table.select(id_key("doc_id").alias("_key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tag"), F.coalesce("text", F.lit("")).alias("text"))
    # The table without its texts: how often a text of an id occurs, how long it is, whose beginning it takes.
    sizes = tagged.groupBy(*same).agg(F.count("*").alias("_n"), F.max(F.length("text")).alias("_chars"))
    sizes = stored(sizes, "sizes")
    heads = sizes.groupBy("_key").agg(F.min("_tag").alias("_head_tag"))
    links = following(sizes.select("_key")).join(heads.withColumnRenamed("_key", "_next"), "_next")
    wants = sizes.join(links, "_key").select(F.col("_key").alias("_for"), F.col("_tag").alias("_for_tag"), "_n", F.col("_next").alias("_key"), F.col("_head_tag").alias("_tag"), F.floor(F.col("_chars") / 3).cast("int").alias("_want"))
    # All branches below use the same three columns, so they share one shuffle of the texts.
    docs = tagged.dropDuplicates(same)
    cuts = docs.join(wants, same).select(F.col("_for").alias("_key"), F.col("_for_tag").alias("_tag"), "_n", F.col("_key").alias("_next"), F.col("_tag").alias("_next_tag"), F.expr("substring(text, 1, _want)").alias("_head"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    pairs = docs.join(cuts, same).withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_head"), F.lit(1), cut)))
    both = pairs.select(*same, F.explode(F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("_text")))).alias("_x"))
    drawn = signatures(both.select(*same, "_x.*"), [*same, "_which"], "_text", slots)
    drawn = drawn.groupBy(*same).agg(*(F.first(F.when(F.col("_which") == k, F.col("signature")), ignorenulls=True).alias(f"_sig{k}") for k in (0, 1)))
    facts = pairs.select(*same, "_n", "_next", "_next_tag", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    # Stored, so that signatures are drawn once for both sides of the comparison with the next document.
    full = stored(facts.join(drawn, same, "left"), "signatures")
    others = full.select(F.col("_key").alias("_next"), F.col("_tag").alias("_next_tag"), F.col("_sig0").alias("_sig2"))
    compared = full.join(others, ["_next", "_next_tag"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return compared.select(
        F.when(F.col("_key") != F.lit(-(1 << 63)), F.col("_key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_sig0")).alias("fingerprint"),
        fingerprint(F.col("_sig1")).alias("edited_fingerprint"),
        likeness(F.col("_sig0"), F.col("_sig1"), slots).alias("near_edited"),
        likeness(F.col("_sig0"), F.col("_sig2"), slots).alias("near_next"),
    )

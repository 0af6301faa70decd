"""Similarity join of documents on their sets of word n-grams (Jaccard), by rare-first prefix filtering.

Nodes are the distinct n-gram sets, so copies fall together at once. Two sets of similarity t share an n-gram among the
first n - ceil(t n) + 1 of each in any order that is the same for all. What one node alone holds joins nothing, so the
rarer an n-gram, the earlier it comes:
1. the n-grams of a part of the hash space (COUNTED of 256 equal parts) are counted over all documents; a node is done
   with if so many of them are its own that they fill its prefix;
2. of the nodes that are left, all n-grams are counted over these nodes, and all are ordered by count. A node whose own
   ones fill its prefix is done with; others post the rest of their prefix.
A pair must pass the length filter, the positional filter (what can still be shared after the common n-gram) and, before
its sets meet, the suffix filter (what equal parts of the hash space, about two n-grams in each, can share). Each pair
is verified once.

Groups of many nodes with one n-gram are not expanded into their pairs at once. In every round some nodes of each group,
those with the smallest share of n-grams of their own, are its pivots: 1, then 15 more, then 240 more and so on. Pivots are
verified against the nodes that come after them in the group's order and lie in another component so far. Groups that lie
in one component, or whose nodes have all been pivots, are done with. A pair is met in the round of the earlier of the
two unless a chain of links joins them by then, so components are those of all links.

Shuffled counts: tasks send their distinct n-grams by buckets, packed. The FREQUENT_KEPT n-grams that are most frequent
within tasks aren't gathered by n-gram: their counts come from those of the tasks, whose sum is the same for all. This
moves n-grams in the order only and never changes the result.

Edge cases: a null text or one without words has an empty set and no links; with fewer words than n, all of them are one
n-gram; rows that repeat an id are documents of their own; a null id counts as the least id; an empty table gives an
empty result; columns with other names are not used. Equality is that of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import blobs, discard, documents, id_key, mixed, numbers, packed, planes, small_batches, stored, windows, words_of
from trialspark.llm.components import components

NGRAM, PERCENT = 5, 75
#: Of 256 equal parts of the hash space, n-grams in the first so many are counted over all documents.
COUNTED = 96
#: An n-gram is frequent in a task that holds it in so many sets, of at most _FLUSH n-grams in all.
FREQUENT_LOCAL, FREQUENT_KEPT = 4, 1 << 17
#: Each round has so many times as many pivots as the rounds before.
PIVOTS = 16
#: Nodes whose list (32 bytes each) is broadcast to the texts; of more, Spark joins it.
SETS_BROADCAST = 1 << 12
_FLUSH = 1_500_000


def _sets(column: pa.Array, ngram: int):
    """(row, sorted distinct n-gram hashes) of every text of a column."""
    for row, words in words_of(column, lower=True):
        grams = windows(words.hash, ngram)
        for d in range(len(words.at) - 1):
            first, stop = words.at[d], words.at[d + 1]
            if stop - first >= ngram:
                yield row + d, np.unique(grams[first : stop - ngram + 1])
            else:
                yield row + d, windows(words.hash[first:stop], int(stop - first)) if stop > first else np.empty(0, np.uint64)


def _set_hash(grams: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return mixed(np.array([mixed(grams).sum(dtype=np.uint64) + np.uint64(len(grams))])).view(np.int64)[0]


def _counted(grams: np.ndarray) -> int:
    """How many of sorted n-grams are in the counted part."""
    return int(np.searchsorted(grams, np.uint64(COUNTED << 56))) if COUNTED < 256 else len(grams)


_DIGEST = "frequent boolean, key long, tag long, node long, n long, counted long"


def _digests(batches, ngram: int):
    """A row (false, key, tag, node, n, counted) for each text, and (true, n-gram, -, -, count, -) for those frequent in this task."""
    held, size, seen = [], 0, set()

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["frequent", "key", "tag", "node", "n", "counted"])

    def frequent():
        grams = np.concatenate(held)
        grams.sort()
        grams, counts = np.unique(grams[1:][grams[1:] == grams[:-1]], return_counts=True)  # all but the first of equals
        grams, counts = grams[counts >= FREQUENT_LOCAL - 1], counts[counts >= FREQUENT_LOCAL - 1] + 1
        none = np.zeros(len(grams), np.int64)
        return rows(np.ones(len(grams), bool), grams.view(np.int64), none, none, counts.astype(np.int64), none)

    for batch in batches:
        nodes, sizes, counted = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for row, grams in _sets(batch.column(2), ngram):
            nodes[row], sizes[row], counted[row] = _set_hash(grams), len(grams), _counted(grams)
            if int(nodes[row]) in seen:  # a copy
                continue
            seen.add(int(nodes[row]))
            held.append(grams)
            size += len(grams)
            if size >= _FLUSH:
                yield frequent()
                held, size = [], 0
        yield rows(np.zeros(batch.num_rows, bool), batch.column(0), batch.column(1), nodes, sizes, counted)
    if held:
        yield frequent()


_PACKED = "bucket int, frequent boolean, nodes binary, owners binary, grams binary"


def _sent(sets, known: np.ndarray, buckets: int):
    """The n-grams of (node, n-grams), packed by bucket: the n-gram's, or of a frequent one the node's."""
    held, nodes, size = [], [], 0

    def rows():
        node, lengths = np.array(nodes, np.int64), np.array([len(x) for x in held])
        grams, owner = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        frequent = known[at] == grams if len(known) else np.zeros(len(grams), bool)
        bucket = np.where(frequent, (node % buckets)[owner], (grams & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets)
        order = np.lexsort((grams, bucket, frequent))
        grams, owner, bucket, frequent = grams[order], owner[order], bucket[order], frequent[order]
        first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (frequent[1:] != frequent[:-1])])
        out = [], [], []
        for i, j in zip(first, np.r_[first[1:], len(grams)], strict=True):
            mine, local = np.unique(owner[i:j], return_inverse=True)
            out[0].append(node[mine].tobytes())
            out[1].append(planes(local.astype(np.uint32)))
            out[2].append(planes(np.diff(grams[i:j], prepend=np.uint64(0))))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(frequent[first]), *map(blobs, out)], ["bucket", "frequent", "nodes", "owners", "grams"])

    for node, grams in sets:
        nodes.append(node)
        held.append(grams)
        size += len(grams)
        if size >= _FLUSH:
            yield rows()
            held, nodes, size = [], [], 0
    if size:
        yield rows()


def _counted_sets(batches, ngram: int):
    """(node, its n-grams in the counted part) of the texts, each node once in a task."""
    seen = set()
    for batch in batches:
        for _, grams in _sets(batch.column(0), ngram):
            if len(grams) and (node := int(_set_hash(grams))) not in seen:
                seen.add(node)
                yield node, grams[: _counted(grams)]


def _stored_sets(batches):
    for batch in batches:
        for node, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield node, np.frombuffer(grams.as_buffer(), np.uint64)


def _shared(batches, known: np.ndarray, counts: np.ndarray):
    """(n-grams, nodes, number of the n-gram's nodes) of those that several nodes hold, in arrays."""
    held: dict[bool, list] = {False: [], True: []}
    for batch in batches:
        for frequent, nodes, owners, grams in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            held[frequent].append((np.cumsum(numbers(grams, np.uint64)), np.frombuffer(nodes, np.int64)[numbers(owners, np.uint32)]))
    for frequent, parts in held.items():
        if not parts:
            continue
        grams, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((nodes, grams))
        grams, nodes = grams[order], nodes[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])]
        grams, nodes = grams[new], nodes[new]
        if frequent:
            yield grams, nodes, counts[np.searchsorted(known, grams)]
            continue
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        sizes = np.diff(np.r_[first, len(grams)])
        rank = np.repeat(sizes, sizes)
        yield grams[rank > 1], nodes[rank > 1], rank[rank > 1]


_NUMBERS = "bucket int, nodes binary, held binary"


def _shared_numbers(batches, known: np.ndarray, counts: np.ndarray, buckets: int):
    """How many of each node's n-grams other nodes hold too, packed by the node's bucket."""
    for _, nodes, _ in _shared(batches, known, counts):
        nodes, held = np.unique(nodes, return_counts=True)
        bucket = nodes % buckets
        order = np.argsort(bucket, kind="stable")
        nodes, held, bucket = nodes[order], held[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        parts = list(zip(first, np.r_[first[1:], len(nodes)], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), blobs([planes(nodes[i:j]) for i, j in parts]), blobs([planes(held[i:j]) for i, j in parts])], ["bucket", "nodes", "held"])


def _summed(batches):
    """(node, sum of its numbers): all of a bucket are in one task."""
    parts = [(numbers(n, np.int64), numbers(h, np.int64)) for batch in batches for n, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    if parts:
        nodes, held = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(nodes, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.bincount(at, held).astype(np.int64))], ["node", "held"])


def _shared_grams(batches, known: np.ndarray, counts: np.ndarray):
    """(node, n-gram, number of the n-gram's nodes)."""
    for grams, nodes, rank in _shared(batches, known, counts):
        for i in range(0, len(grams), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (nodes, grams.view(np.int64), rank)], ["node", "gram", "rank"])


def _node_sets(batches, ngram: int):
    """(node, size, part counts, sorted n-gram hashes) of the texts, each node once in a task."""
    seen = set()
    for batch in batches:
        nodes, sizes, counts, sets = [], [], [], []
        for _, grams in _sets(batch.column(0), ngram):
            if (node := int(_set_hash(grams))) in seen:
                continue
            seen.add(node)
            nodes.append(node)
            sizes.append(len(grams))
            counts.append(_part_counts(grams).tobytes())
            sets.append(grams.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(sizes, pa.int64()), blobs(counts), blobs(sets)], ["node", "n", "counts", "grams"])


def _part_counts(grams: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of 2**depth equal parts of the hash space, about two in a part; 255 is "or more"."""
    depth = max(1, (len(grams) // 2).bit_length())
    return np.minimum(np.bincount(grams >> np.uint64(64 - depth), minlength=1 << depth), 255).astype(np.uint8)


def _can_share(a: np.ndarray, b: np.ndarray) -> float:
    """At most so many equal n-grams, by two sets' part counts: the suffix filter, with as many parts as the sets allow."""
    a, b = sorted((a.astype(np.float64), b.astype(np.float64)), key=len)
    a[a == 255], b[b == 255] = np.inf, np.inf
    b = b.reshape(len(a), -1).sum(1)  # parts of the larger set are joined to those of the smaller
    return float(np.minimum(a, b).sum())


def _may_link(batches, percent: int):
    """Pairs (a, b) of those with set sizes and part counts that pass the suffix filter."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            keep[i] = _can_share(a, b) * (100 + percent) >= percent * sizes[i]
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])


def _verified(batches, percent: int):
    """Pairs (a, b) of those with their sets whose similarity is enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            need = -(-percent * (len(a) + len(b)) // (100 + percent))
            keep[i] = len(np.intersect1d(a, b, assume_unique=True)) >= need
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])


def _passes(x: str, y: str, percent: int):
    """Length and positional filters of two packed (size, position) columns."""
    size = lambda c: F.shiftright(F.col(c), 32)
    rest = lambda c: size(c) - F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    long_enough = F.least(size(x), size(y)) * 100 >= F.greatest(size(x), size(y)) * percent
    return long_enough & (F.least(rest(x), rest(y)) * (100 + percent) >= (size(x) + size(y)) * percent)


def _candidates(keyed: DataFrame, rows: DataFrame, frequent, ngram: int, percent: int) -> DataFrame:
    """The nodes whose own n-grams in the counted part don't fill their prefix."""
    buckets = _buckets(keyed)
    sent = keyed.select("text").mapInArrow(lambda b: _sent(_counted_sets(b, ngram), frequent.value[0], buckets), _PACKED)
    told = sent.repartition("bucket").mapInArrow(lambda b: _shared_numbers(b, *frequent.value, buckets), _NUMBERS)
    held = told.repartition("bucket").mapInArrow(_summed, "node long, held long")
    sizes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("counted").alias("counted"))
    told = sizes.join(held, "node", "left")
    return stored(told.filter(F.col("counted") - F.coalesce("held", F.lit(0)) < _prefix(percent)).select("node"), "candidates")


def _buckets(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _prefix(percent: int) -> F.Column:
    return F.col("n") - F.ceil(F.col("n") * percent / 100) + 1


def _postings(sets: DataFrame, frequent, percent: int) -> DataFrame:
    """(gram, node, place, own) of every prefix n-gram that several of the sets' nodes hold: place packs the node's size
    and the n-gram's position in its order, own is the share of the node's n-grams that no other node holds."""
    buckets = _buckets(sets)
    sent = sets.select("node", "grams").mapInArrow(lambda b: _sent(_stored_sets(b), frequent.value[0], buckets), _PACKED)
    held = sent.repartition("bucket").mapInArrow(lambda b: _shared_grams(b, *frequent.value), "node long, gram long, rank long")
    lists = held.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    mine = lists.join(sets.select("node", "n"), "node").withColumn("own", F.col("n") - F.size("grams"))
    prefix = mine.withColumn("take", (_prefix(percent) - F.col("own")).cast("int")).filter("take > 0")
    each = prefix.select("node", "n", "own", F.posexplode(F.slice("grams", F.lit(1), F.col("take"))).alias("at", "gram"))
    place = F.col("n") * F.lit(1 << 32) + F.col("own") + F.col("at")
    return stored(each.select("gram.gram", "node", place.alias("place"), (F.col("own") / F.col("n")).alias("own")), "postings")


def _sets_of(nodes: DataFrame, keyed: DataFrame, rows: DataFrame, ngram: int) -> DataFrame:
    """(node, n, counts, grams) of each of nodes, made from the text of the row with the least (key, tag); a row that is
    repeated wholly may make its set more than once, which adds nothing to links."""
    holders = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "tag")).alias("row"))
    listed = holders.select("row.*")
    if nodes.count() <= SETS_BROADCAST:
        listed = F.broadcast(listed)
    texts = keyed.join(listed, ["key", "tag"], "left_semi").select("text")
    sets = texts.mapInArrow(lambda b: _node_sets(b, ngram), "node long, n long, counts binary, grams binary")
    return stored(sets, "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each verified once, that are similar."""
    side = lambda key, **columns: sets.select(F.col("node").alias(key), *(F.col(c).alias(k) for k, c in columns.items()))
    sketched = pairs.join(side("a", m="n", x="counts"), "a").join(side("b", n="n", y="counts"), "b").select("a", "b", "m", "n", "x", "y")
    close = stored(sketched.mapInArrow(lambda b: _may_link(b, percent), "a long, b long"), "close")
    joined = close.join(side("a", x="grams"), "a").join(side("b", y="grams"), "b")
    out = stored(joined.select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, percent), "a long, b long"), "links")
    discard(close)
    return out


def _linked(posted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every node with links."""
    spark = posted.sparkSession
    found = stored(spark.createDataFrame([], "node long, component long"), "components")
    tried, before, pivots = None, 0, 1
    while True:
        named = posted.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = named.groupBy("gram").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("k")).filter(F.expr("c <> d") & (F.col("k") > before)).select("gram")
        left = stored(named.join(open_, "gram", "left_semi"), "left")
        if not left.limit(1).count():
            discard(left)
            return found
        nth = F.row_number().over(Window.partitionBy("gram").orderBy("own", "node"))
        chosen = left.withColumn("nth", nth).filter((F.col("nth") <= pivots)).filter(F.col("nth") > before)
        chosen = chosen.select("gram", F.col("node").alias("p"), F.col("place").alias("p_at"), F.col("own").alias("p_own"), F.col("component").alias("other"))
        later = (F.col("own") > F.col("p_own")) | ((F.col("own") == F.col("p_own")) & (F.col("node") > F.col("p")))
        met = left.join(chosen, "gram").filter(later & (F.col("component") != F.col("other"))).filter(_passes("place", "p_at", percent))
        pairs = met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        links = _links(pairs, sets, percent)
        tried = pairs if tried is None else tried.unionByName(pairs)
        names = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        between = links.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
        merged = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "full").select("node", F.coalesce("component", "node").alias("old"))
        renamed = stored(nodes.join(merged, "old", "left").select("node", F.coalesce("new", "old").alias("component")), "components")
        for table in (found, left, links):
            discard(table)
        found, before, pivots = renamed, pivots, PIVOTS * pivots


def similar_groups(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(key, tag, node, n_shingles, component, head) of every row of docs (doc_id, text): component is the least key that
    links reach, head the tag of the least (key, tag); tag is a hash of the text."""
    small_batches(docs.sparkSession)
    keyed = docs.select(id_key("doc_id").alias("key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag"), F.col("text").cast("binary").alias("text"))
    told = stored(keyed.mapInArrow(lambda b: _digests(b, ngram), _DIGEST), "digests", "frequent")
    rows = told.filter("NOT frequent").drop("frequent")
    top = told.filter("frequent").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT_KEPT)
    known = top.toArrow()
    order = np.argsort(grams := known["key"].to_numpy().view(np.uint64))
    frequent = docs.sparkSession.sparkContext.broadcast((grams[order], known["n"].to_numpy()[order]))
    left = _candidates(keyed, rows, frequent, ngram, percent)
    sets = _sets_of(left, keyed, rows, ngram)
    posted = _postings(sets, frequent, percent)
    found = _linked(posted, sets, percent)
    discard(posted)
    discard(sets)

    least = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("key", "tag")).alias("least"))
    joined = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = joined.groupBy("component").agg(F.min("least").alias("id"))
    ids = joined.join(best, "component").select("node", "id")
    out = rows.withColumn("some", F.when(F.col("n") > 0, F.col("node"))).join(ids.withColumnRenamed("node", "some"), "some", "left")
    head = [F.coalesce(f"id.{c}", c).alias(n) for c, n in (("key", "component"), ("tag", "head"))]
    return out.select("key", "tag", "node", F.col("n").alias("n_shingles"), *head)


def one_of_each_group(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each group the one with the least (id, hash of the text);
    texts without words all stay."""
    groups = stored(similar_groups(docs, ngram, percent), "groups")
    stays = (F.col("key") == F.col("component")) & (F.col("tag") == F.col("head"))
    texts = groups.filter("n_shingles > 0").groupBy("key", "tag").agg(F.count("*").alias("n"), F.min(stays).alias("stays"))
    told = texts.select(F.col("key").alias("_key"), F.col("tag").alias("_tag"), "n", "stays")
    told = stored(told.filter("n > 1 OR NOT stays"), "leaves")
    keyed = packed(docs, id_key("doc_id").alias("_key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tag"))
    out = keyed.join(told.select("_key", "_tag"), ["_key", "_tag"], "left_anti").select("row")
    again = told.filter("stays").select("_key", "_tag")  # rows that are repeated wholly: one of them
    if again.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("_key", "_tag").orderBy("_tag"))
        out = out.unionByName(keyed.join(again, ["_key", "_tag"], "left_semi").withColumn("_nth", nth).filter("_nth = 1").select("row"))
    return out.select("row.*")


def op6_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    return similar_groups(documents(spark, sf_dir)).select(real("key").alias("doc_id"), "n_shingles", real("component").alias("component_id"))


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(list_slice(w, i, i + {NGRAM - 1}), ' ')) END) AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= {PERCENT} * (na + nb - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, c::BIGINT AS component_id FROM s JOIN m ON s.doc_id = m.a
"""

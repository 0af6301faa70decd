"""Substring dedup by relative Lempel-Ziv parsing: each document is factored against an index of all documents' blocks.

A window of W words is repeated if its words also start at another place. The reference is indexed by blocks that the
text itself defines: of the k-word grams of a window the one with the least hash (the leftmost of equals) is its anchor;
windows in a row with one anchor make a block, the span of words that they cover, about one per nine words. Equal windows
have equal anchors, so a block whose anchor occurs nowhere else holds no repeated window.

1. Index: a row (anchor, block hash, document, place) of each block whose anchor occurs again. Tasks settle anchors that
   repeat within them and send each only once for the count over all tasks, so a hot anchor is a row a task there.
2. Whole blocks: a block whose content occurs again has a reference, another place of that content.
3. Boundaries: a block that occurs once, whose anchor occurs again, lies across a factor's boundary. Its windows are
   looked up one by one among those of the anchor's other contents, which tells how far the factors beside it reach.
4. Factors: the document's referenced blocks and windows, in order, are taken greedily: a factor goes on as long as the
   next one begins where the last ended or before and its reference is the same document, as far away. A factor is
   (place, words, reference document, reference place); all are W words or longer and all their words are removed.

Equality is that of 64-bit hashes of word sequences; rows are told apart by their id and a 64-bit hash of their text. No group is gathered: counts are partial aggregates, and rows of one
key only stream through joins that Spark can split; what is collected are the distinct places of one text.

Edge cases: a null or empty text has no words; texts of fewer than W words lose none; rows that repeat an id are
documents of their own, so a row that is repeated wholly repeats all its windows; a null id counts as the least id;
an empty table gives an empty result; columns with other names are kept by `remove_repeats` and not used otherwise.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import NOT_SPACE, Words, _prefix, blobs, discard, documents, id_key, lists, numbers, packed, planes, small_batches, spans, stored, text_chunks, windows, words_of

WINDOW = 35
#: A place is packed as the first word's position (31 bits) and the number of windows - 1 (5 bits).
POSITION, RUN = 31, 5
#: Blocks that a task holds before it sends them.
_FLUSH = 500_000
#: What is sent: blocks whose anchor repeats in the task, blocks whose anchor doesn't, and one anchor for each that does.
_KNOWN, _ALONE, _TOLD = 0, 1, 2


def _sliding_argmin(x: np.ndarray, m: int) -> np.ndarray:
    """Index of the least (leftmost of equals) of every m numbers in a row."""
    at = np.arange(len(x))
    size = 1
    while size < m:
        step = min(size, m - size)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        size += step
    return at


def _gram(window: int) -> int:
    return max(1, (window + 1) // 2, window + 1 - (1 << RUN))


def _start(places):
    return (places >> RUN) & ((1 << POSITION) - 1)


def _run(places):
    return places & ((1 << RUN) - 1)


def _blocks(batches, window: int):
    """(anchors, blocks, keys, tags, places) of batches of (key, tag, text)."""
    gram = _gram(window)
    for batch in batches:
        keys, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for row, words in words_of(batch.column(2)):
            h = words.hash
            if len(h) < window:
                continue
            lengths = np.diff(words.at)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            inside = np.flatnonzero(np.arange(len(h) - window + 1) + window <= words.at[1:][doc[: len(h) - window + 1]])
            if not len(inside):
                continue
            grams = windows(h, gram)
            at = _sliding_argmin(grams, window - gram + 1)[inside]
            new = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1] + 1) | (at[1:] != at[:-1])])
            first, last = inside[new], inside[np.r_[new[1:] - 1, len(inside) - 1]]
            d = doc[first]
            place = ((first - words.at[d]) << RUN) | (last - first)
            yield grams[at[new]], spans(_prefix(h), first, last + window).view(np.int64), keys[row + d], tags[row + d], place


_SENT = "bucket int, kind int, anchors binary, blocks binary, keys binary, tags binary, places binary"


def _indexed(batches, window: int, buckets: int):
    """The blocks of the texts, packed by bucket: an anchor's bucket, or for known ones any."""
    held, size = [], 0

    def rows():
        anchor, block, key, tag, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, block, key, tag, place = anchor[order], block[order], key[order], tag[order], place[order]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes = np.diff(np.r_[first, len(anchor)])
        kind = np.repeat(np.where(sizes > 1, _KNOWN, _ALONE), sizes)
        bucket = np.where(kind == _KNOWN, (tag ^ place) % buckets, (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets)
        told = first[sizes > 1]
        columns = [np.r_[x, x[told]] for x in (anchor, block, key, tag, place)]
        kind = np.r_[kind, np.full(len(told), _TOLD)]
        bucket = np.r_[bucket, (anchor[told] & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets]
        order = np.lexsort((columns[0], kind, bucket))
        kind, bucket = kind[order], bucket[order]
        columns = [x[order] for x in columns]
        at = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1])])
        out = [], [], [], [], []
        for i, j in zip(at, np.r_[at[1:], len(kind)], strict=True):
            out[0].append(planes(np.diff(columns[0][i:j], prepend=np.uint64(0))))
            for k in (1, 2, 3, 4):
                out[k].append(planes(columns[k][i:j]) if kind[i] != _TOLD else b"")
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(kind[at].astype(np.int32)), *map(blobs, out)], ["bucket", "kind", "anchors", "blocks", "keys", "tags", "places"])

    for part in _blocks(batches, window):
        held.append(part)
        size += len(part[0])
        if size >= _FLUSH:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


_INDEX = "anchor long, block long, key long, tag long, place long"


def _repeated_anchors(batches):
    """(anchor, block, key, tag, place) of the blocks whose anchor occurs again, in the task that sent it or in others."""
    alone, told = [], []

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["anchor", "block", "key", "tag", "place"])

    for batch in batches:
        for kind, anchors, *others in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
            anchors = np.cumsum(numbers(anchors, np.uint64))
            if kind == _TOLD:
                told.append(anchors)
                continue
            part = (anchors, *(numbers(x, np.int64) for x in others))
            if kind == _KNOWN:
                yield rows(*part)
            else:
                alone.append(part)
    if alone:
        columns = [np.concatenate(x) for x in zip(*alone, strict=True)]
        anchors, counts = np.unique(np.concatenate([columns[0], *told]), return_counts=True)
        keep = counts[np.searchsorted(anchors, columns[0])] > 1
        yield rows(*(c[keep] for c in columns))


def _boundary_windows(batches, window: int):
    """Rows (window, key, tag, place, single) of batches of (key, tag, text, [place], [whether its block is single])."""
    for batch in batches:
        for row, data, offsets in text_chunks(batch.column(2), 1):
            h = windows(Words(data, offsets, NOT_SPACE, False).hash, window).view(np.int64)
            places = batch.column(3)[row].values.to_numpy()
            single = batch.column(4)[row].values.to_numpy(zero_copy_only=False)
            runs = _run(places) + 1
            nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            at = np.repeat(_start(places), runs) + nth
            keys = np.full(len(at), batch.column(0)[row].as_py())
            tags = np.full(len(at), batch.column(1)[row].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], keys, tags, at << RUN, np.repeat(single, runs))], ["window", "key", "tag", "place", "single"])


def _greedy(places: np.ndarray, ref_keys: np.ndarray, ref_places: np.ndarray, window: int):
    """(start, words, reference key, reference start) of a text's factors, from its referenced blocks and windows."""
    start, run, ref = _start(places), _run(places), _start(ref_places)
    order = np.lexsort((-run, start))
    out: list[list[int]] = []
    for i in order:
        a, b, key, r = int(start[i]), int(start[i] + run[i]) + window, int(ref_keys[i]), int(ref[i])
        if out and key == out[-1][2] and r - a == out[-1][3] - out[-1][0] and a <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], b - out[-1][0])
        else:
            out.append([a, b - a, key, r])
    return np.array(out, np.int64).reshape(-1, 4)


_FACTORS = "_key long, _tag long, starts array<long>, words array<long>, refs array<long>, ref_starts array<long>"


def _factors_of(batches, window: int):
    """A text's factors from batches of (key, tag, [(place, reference key, reference tag, reference place)])."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for row in batch.column(2):
            places, keys, tags, refs = (row.values.field(k).to_numpy() for k in range(4))
            texts, text = np.unique(np.stack([keys, tags]), axis=1, return_inverse=True)  # rows of one id are told apart
            found = _greedy(places, text.ravel(), refs, window)
            found[:, 2] = texts[0, found[:, 2]]
            for k in range(4):
                out[k].append(found[:, k])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(lists(x, pa.int64()) for x in out)], ["_key", "_tag", "starts", "words", "refs", "ref_starts"])


def _without(batches):
    """n_words, n_removed and the kept words, of batches of (text, [start], [words], other columns)."""
    for batch in batches:
        kept, total, removed = [], [], []
        for text, starts, lengths in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = (text or b"").split()
            total.append(len(words))
            if starts.is_valid:
                start = starts.values.to_numpy()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + lengths.values.to_numpy(), -1)
                words = list(compress(words, np.cumsum(cover[:-1]) == 0))
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[3:], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), blobs(kept)],
            [*batch.schema.names[3:], "_n_words", "_n_removed", "_kept"],
        )


def _keyed(docs: DataFrame, *others: str) -> DataFrame:
    tag = F.coalesce(F.xxhash64("text"), F.lit(0))
    return docs.select(id_key("doc_id").alias("_key"), tag.alias("_tag"), F.col("text").cast("binary").alias("_text"), *others)


def factor_lists(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_key, _tag, starts, words, refs, ref_starts) of every text with factors; _tag is a hash of the text."""
    if not 2 <= window:
        raise ValueError("window is at least 2 words")
    spark = docs.sparkSession
    small_batches(spark)
    texts = _keyed(docs)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(lambda b: _indexed(b, window, buckets), _SENT)
    index = stored(sent.repartition("bucket").mapInArrow(_repeated_anchors, _INDEX), "index")
    here = F.struct("key", "tag", "place")
    contents = stored(index.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(here).alias("low"), F.max(here).alias("high")), "contents")
    other = F.when(here == F.col("low"), F.col("high")).otherwise(F.col("low"))
    whole = index.join(contents.filter("n > 1"), ["anchor", "block"]).select("key", "tag", "place", other.alias("ref"))
    # A content that occurs once is compared with all others of its anchor, each from one document.
    open_ = contents.join(contents.filter("n = 1").select("anchor").distinct(), "anchor", "left_semi")
    asked = open_.select("low.*", (F.col("n") == 1).alias("single")).groupBy(F.col("key").alias("_key"), F.col("tag").alias("_tag"))
    asks = asked.agg(F.collect_list("place").alias("places"), F.collect_list("single").alias("single"))
    ask = texts.join(asks, ["_key", "_tag"]).select("_key", "_tag", "_text", "places", "single")
    edges = stored(ask.mapInArrow(lambda b: _boundary_windows(b, window), "window long, key long, tag long, place long, single boolean"), "windows")
    seen = edges.groupBy("window").agg(F.count("*").alias("n"), F.max("single").alias("any")).filter("n > 1 AND any").select("window")
    matched = stored(edges.join(seen, "window"), "matched")  # few of all windows
    places = matched.groupBy("window").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    found = matched.filter("single").join(places, "window").select("key", "tag", "place", other.alias("ref"))
    # A row that is repeated wholly refers to one of the two ends in each of its copies, so its list is short.
    told = whole.unionByName(found).groupBy(F.col("key").alias("_key"), F.col("tag").alias("_tag"))
    told = told.agg(F.collect_set(F.struct("place", F.col("ref.key").alias("k"), F.col("ref.tag").alias("t"), F.col("ref.place").alias("p"))).alias("found"))
    out = stored(told.mapInArrow(lambda b: _factors_of(b, window), _FACTORS), "factors")
    for table in (index, contents, edges, matched):
        discard(table)
    return out


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n_words, ref_doc_id, ref_start): every factor of every row of docs (doc_id, text), in words from 0."""
    real = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    each = F.explode(F.arrays_zip("starts", "words", "refs", "ref_starts")).alias("f")
    found = _keyed(docs).select("_key", "_tag").join(factor_lists(docs, window), ["_key", "_tag"]).select("_key", each).select("_key", "f.*")
    return found.select(real("_key").alias("doc_id"), F.col("starts").alias("start"), F.col("words").alias("n_words"), real("refs").alias("ref_doc_id"), F.col("ref_starts").alias("ref_start"))


def factored(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and _n_words, _n_removed, _kept (the words that stay, joined by one space, UTF-8 bytes)."""
    texts = _keyed(docs, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)))
    found = factor_lists(docs, window).select("_key", "_tag", "starts", "words")
    joined = texts.join(found, ["_key", "_tag"], "left").select("_text", "starts", "words", *(f"_c{i}" for i in range(len(keep))))
    schema = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = joined.mapInArrow(_without, f"{schema}, _n_words long, _n_removed long, _kept binary")
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(keep)})


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words gone from `text` (and n_chars, if there is one, set anew); texts that lose none stay as they are."""
    out = factored(packed(docs, "doc_id", "text"), window, ("row",))
    changed = F.col("_n_removed") > 0
    text = F.when(changed, F.col("_kept").cast("string")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factored(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS k FROM x),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM y),
g AS (SELECT r, list(p) AS ps FROM c GROUP BY r),
o AS (SELECT d.doc_id, len(w) AS n, len(coalesce(ps, [])) AS m,
             CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i))) END AS kept
      FROM d LEFT JOIN g ON d.r = g.r)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM o
"""

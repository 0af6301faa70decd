"""Periodic runs of words by scale-tiled distribution, and texts with their runs collapsed.

A run is a stretch of words with smallest period q (words q apart are equal), at least MIN_EXPONENT periods and MIN_LENGTH
words long, that no neighbouring word extends. Periods are taken by octave, [2**k, 2**(k+1)).

1. Tiles: for an octave, boundaries lie 2**k words apart, and the tile of boundary b reaches from b - 2 * 2**k to
   b + 4 * 2**k. A run of the octave has at least two boundaries in a row whose next 2**k words recur one period later, so
   it shows in every tile that it crosses, and tiles in a row share more than a period of it.
2. Tiles are solved independently by Z-values at the boundary: for each period of the octave, how many words from b on,
   and how many before b, equal those a period later. The first 2**k words are compared for all periods at once; only
   where they agree are both Z-values found, by bisection over prefix hashes. A fragment of fewer than MIN_EXPONENT
   periods is kept only if it reaches its tile's edge; one with a smaller period is left to that period's octave.
3. Fragments of neighbouring tiles are combined within the task, then shuffled by document and period; in order of their start, those that share a period's length of words
   are stitched. What is then long enough is a run.

Texts of up to `long` words are tiled where they are read. A longer text leaves its task as slices of word hashes, each
with the octaves that it serves: short periods have short slices, and a slice overlaps the next by a whole tile; slices are
dealt over all tasks. Equality is that of 64-bit hashes of words and of sequences of words.

Edge cases: a null or empty text has no words and no runs, and collapses to nothing; rows that repeat an id are documents
of their own (rows equal in id and text have equal results); a null id counts as the least id; an empty table gives an
empty result; texts are of any length; columns named like helper columns are kept, since rows are packed.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import WORD, _Powers, blobs, documents, id_key, lists, mixed, packed, small_batches, stored, words_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of a text from which on its tiles are dealt over tasks, and of the shortest slices then.
LONG = 1 << 17
#: A slice is so many times as long as the greatest 2**k of its octaves.
_SLICE = 16


def _primes(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


def fragments(h: np.ndarray, low: int, high: int, exponent: int = MIN_EXPONENT, open_left: bool = False, open_right: bool = False) -> np.ndarray:
    """Rows (period, start, end) of the tiles of octaves low..high-1 over words' hashes; open sides are no ends of the text."""
    n = len(h)
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])

    def same(a, b, length):  # whether `length` words from a on equal those from b on; a <= b
        return (sums[a + length] - sums[a]) * up[b - a] == sums[b + length] - sums[b]

    def reach(test, least, most):  # the greatest m in least..most with test(m), which holds at least and up to some m
        least, most = least.copy(), most.copy()
        while (wide := most > least).any():
            middle = (least + most + 1) // 2
            ok = test(middle) & wide
            least = np.where(ok, middle, least)
            most = np.where(wide & ~ok, middle - 1, most)
        return least

    out = []
    for k in range(low, high):
        half = 1 << k
        if n < 2 * half + 1:
            break
        rolling = (sums[half:] - sums[:-half]) * down[: n - half + 1]
        later = rolling[half:]
        hit = np.flatnonzero(later == np.repeat(rolling[::half], half)[: len(later)])
        if not len(hit):
            continue
        b, q = hit // half * half, half + hit % half
        left, right = np.maximum(b - 2 * half, 0), np.minimum(b + 4 * half, n)
        fits = b + q + half <= right
        b, q, left, right = b[fits], q[fits], left[fits], right[fits]
        ahead = reach(lambda m: same(b, b + q, m), np.full(len(b), half), right - q - b)
        behind = reach(lambda m: same(b - m, b + q - m, m), np.zeros(len(b), np.int64), b - left)
        start, end = b - behind, b + q + ahead
        at_edge = ((start == left) & ((left > 0) | open_left)) | ((end == right) & ((right < n) | open_right))
        keep = (end - start >= exponent * q) | (at_edge & (end - start >= 2 * q))
        found = np.unique(np.stack([q[keep], start[keep], end[keep]], 1), axis=0)
        out.append(_combined(found[_primitive(found, same)]))
    found = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    q, start, end = found.T
    return found[(end - start >= exponent * q) | (open_left & (start == 0)) | (open_right & (end == n))]


def _combined(found: np.ndarray) -> np.ndarray:
    """Rows (period, start, end) in order, those of one period that share a period's length stitched within the task."""
    if not len(found):
        return found
    q, start, end = found.T
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (start[1:] > end[:-1] - q[1:])])
    return np.stack([q[first], start[first], end[np.r_[first[1:] - 1, len(found) - 1]]], 1)


def _primitive(found: np.ndarray, same) -> np.ndarray:
    """Which rows (period, start, end) of two periods or more have no smaller period: that would divide the period."""
    keep = np.ones(len(found), bool)

    def drop(rows, period):
        q, start, end = found[rows].T
        keep[rows[same(start, start + period, end - start - period)]] = False

    for p in range(1, 9):
        rows = np.flatnonzero(keep & (found[:, 0] % p == 0) & (found[:, 0] > p))
        drop(rows, np.full(len(rows), p))
    for q in np.unique(found[keep, 0]):
        for f in _primes(int(q)):
            rows = np.flatnonzero(keep & (found[:, 0] == q))
            drop(rows, np.full(len(rows), q // f))
    return keep


def _octaves(n: int, exponent: int) -> int:
    """Number of octaves whose periods fit exponent times into n words."""
    return max(0, (n // exponent).bit_length())


def _slices(h: np.ndarray, long: int, exponent: int):
    """(offset, low, high, end) of the slices of a long text: octaves low..high-1 over words offset..end."""
    low, most, size = 0, _octaves(len(h), exponent), long
    while low < most:
        high = most if size >= len(h) else min(most, max(low + 1, (size // _SLICE).bit_length()))
        step = max(1, size - 6 * (1 << (high - 1)))
        for offset in range(0, len(h), step):
            end = min(len(h), offset + size)
            yield offset, low, high, end
            if end == len(h):
                break
        low, size = high, size * _SLICE


_FOUND = "_n_words long, _text binary, _out binary, _periods array<long>, _starts array<long>, _ends array<long>, _offset long, _low int, _high int, _end long, _hashes binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _tiled(batches, long: int, exponent: int, finish):
    """The texts of batches (text, key, tag, other columns), with their fragments or, if they have none, what is left of
    them; and rows of slices of long texts."""
    for batch in batches:
        texts = batch.column(0)
        others = batch.columns[1:]
        n, text, out, found, cut = [], [], [], ([], [], []), []
        for row, words in words_of(texts):
            counts = np.diff(words.at)
            first = words.at[:-1] + np.arange(len(counts))
            # Between texts stand hashes that occur nowhere else, so that no stretch crosses them; long texts are left out.
            hashes = np.insert(words.hash, words.at[1:], mixed(np.arange(len(counts), dtype=np.uint64) + np.uint64(1 << 40)))
            for d in np.flatnonzero(counts > long):
                mine = words.hash[words.at[d] : words.at[d + 1]]
                cut += [(row + int(d), *s, mine[s[0] : s[3]].tobytes()) for s in _slices(mine, long, exponent)]
                hashes[first[d] : first[d] + counts[d]] = mixed(np.arange(counts[d], dtype=np.uint64) + np.uint64(d + 1 << 41))
            hits = fragments(hashes, 0, _octaves(int(counts[counts <= long].max(initial=0)), exponent), exponent)
            doc = np.searchsorted(first, hits[:, 1], "right") - 1
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(len(counts) + 1))
            hits = hits[order] - np.stack([np.zeros(len(doc), np.int64), first[doc[order]], first[doc[order]]], 1)
            for d in range(len(counts)):
                whole = texts[row + d].as_py() or b""
                open_ = at[d] < at[d + 1] or counts[d] > long
                n.append(int(counts[d]))
                text.append(whole if open_ else None)
                out.append(None if open_ else finish(whole.split()))
                for i in range(3):
                    found[i].append(hits[at[d] : at[d + 1], i])
        nothing = pa.nulls(len(n), pa.binary())
        none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), blobs(text), blobs(out), *(lists(x, pa.int64()) for x in found), *none, nothing], [*batch.schema.names[1:], *_NAMES])
        for row, offset, low, high, end, hashes in cut:
            mine = [c.slice(row, 1) for c in others]
            nulls = [pa.nulls(1, t) for t in (pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3)]
            place = [pa.array([offset], pa.int64()), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([end], pa.int64())]
            yield pa.RecordBatch.from_arrays([*mine, pa.array([n[row]], pa.int64()), *nulls, *place, blobs([hashes])], [*batch.schema.names[1:], *_NAMES])


def _solved(batches, exponent: int):
    """(_key, _tag, period, start, end) of slices (key, tag, n_words, offset, low, high, end, hashes)."""
    for batch in batches:
        for key, tag, n, offset, low, high, end, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hits = fragments(np.frombuffer(hashes, np.uint64), low, high, exponent, offset > 0, end < n)
            columns = [np.full(len(hits), key), np.full(len(hits), tag), hits[:, 0], hits[:, 1] + offset, hits[:, 2] + offset]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_key", "_tag", "period", "start", "end"])


def _collapsed(batches, finish):
    """What is left of texts: batches (text, [start], [length], [period], other columns)."""
    for batch in batches:
        out = []
        for text, *runs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            words = text.split()
            cover = np.zeros(len(words) + 1, np.int64)
            start, length, period = (np.array(x or [], np.int64) for x in runs)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            out.append(finish(list(compress(words, np.cumsum(cover[:-1]) == 0))))
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], blobs(out)], [*batch.schema.names[4:], "_out"])


def _joined(words: list[bytes]) -> bytes:
    return b" ".join(words)


def _digest(words: list[bytes]) -> bytes:
    from hashlib import sha256

    return sha256(b" ".join(words)).digest()


def stitched(found: DataFrame, keys: list[str], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """Runs (keys, period, start, length) of fragments (keys, period, start, end)."""
    w = Window.partitionBy(*keys, "period").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before - F.col("period")).cast("int"), F.lit(1))
    islands = found.select(*keys, "period", "start", "end", new.alias("_new")).withColumn("_island", F.sum("_new").over(w))
    runs = islands.groupBy(*keys, "period", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.select(*keys, "period", "start", (F.col("end") - F.col("start")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(least), exponent * F.col("period")))


def with_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT, digest: bool = False, long: int = LONG) -> DataFrame:
    """The columns `keep` of docs (doc_id, text), _n_words, _runs (structs start, length, period, in this order) and _out:
    the words that no run drops, joined by one space, as UTF-8 bytes (digest: their SHA-256). A run drops its words
    after the first period."""
    if exponent < 3:
        raise ValueError("exponent is at least 3")
    small_batches(docs.sparkSession)
    finish = _digest if digest else _joined
    kept = [f"_c{i}" for i in range(len(keep))]
    tag = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.select(F.col("text").cast("binary").alias("_text"), id_key("doc_id").alias("_key"), tag.alias("_tag"), *(F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)))
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True))
    first = stored(texts.mapInArrow(lambda b: _tiled(b, long, exponent, finish), f"_key long, _tag long, {schema}, {_FOUND}"), "tiles")
    rows, slices = first.filter("_hashes IS NULL"), first.filter("_hashes IS NOT NULL")
    near = rows.filter("size(_periods) > 0").select("_key", "_tag", F.explode(F.arrays_zip("_periods", "_starts", "_ends")).alias("f"))
    near = near.select("_key", "_tag", F.col("f._periods").alias("period"), F.col("f._starts").alias("start"), F.col("f._ends").alias("end"))
    dealt = slices.select("_key", "_tag", "_n_words", "_offset", "_low", "_high", "_end", "_hashes").repartition("_key", "_tag", "_offset", "_low")
    far = dealt.mapInArrow(lambda b: _solved(b, exponent), "_key long, _tag long, period long, start long, end long")
    runs = stitched(near.unionByName(far), ["_key", "_tag"], least, exponent)
    runs = runs.groupBy("_key", "_tag").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("_runs"))
    told = rows.filter("_text IS NOT NULL").join(runs, ["_key", "_tag"], "left")
    told = told.select("_text", *(F.col("_runs")[c].alias(f"_r_{c}") for c in ("start", "length", "period")), *kept, "_n_words", "_runs")
    of_runs = "_runs array<struct<start:bigint,length:bigint,period:bigint>>"
    told = told.mapInArrow(lambda b: _collapsed(b, finish), f"{schema}, _n_words long, {of_runs}, _out binary")
    plain = rows.filter("_text IS NULL").select(*kept, "_n_words", F.lit(None).cast(of_runs.split(" ", 1)[1]).alias("_runs"), "_out")
    out = plain.unionByName(told).withColumn("_runs", F.coalesce("_runs", F.array().cast(of_runs.split(" ", 1)[1])))
    return out.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def collapse_runs(docs: DataFrame, **options) -> DataFrame:
    """docs with the words that runs drop gone from `text`; texts without a run stay as they are."""
    out = with_runs(packed(docs, "doc_id", "text"), ("row",), **options)
    text = F.when(F.size("_runs") > 0, F.col("_out").cast("string")).otherwise(F.col("row.text"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with periodic tails set into some: let h be the id's CRC-32, g = h div 10; where h ends in 0, each
    of the n words from place a = g mod n on becomes the word (i - a) mod p after a, p = 1 + (n - a) div (3 + g mod 8).
    Those texts' words are joined by one space. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("_words")
    split = docs.withColumn("_words", words).withColumn("_a", F.when(n > 0, g % n).cast("int"))
    split = split.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    copies = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(period, copies)), 1, n - F.col("_a"))
    text = F.when(F.col("_p").isNotNull(), F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text"))
    return split.withColumn("text", text).drop("_words", "_a", "_p")


def _longest(field: str) -> Column:
    sign = 1 if field == "length" else -1
    return (F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))[field] * sign).alias(field)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_runs(looped(documents(spark, sf_dir).select("doc_id", "text")), digest=True)
    out = out.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), *map(_longest, ("start", "length", "period")), "_runs", "_out")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    listed = F.array_join(F.transform("_runs", line), "")
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return out.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.lower(F.hex("_out")).alias("collapsed_sha256"))

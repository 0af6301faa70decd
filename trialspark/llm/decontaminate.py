"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Test items are cut to pieces of at most PIECE words, which are the index's documents. Training texts are cut to passages
of 2 * PIECE words, half over each other, so that every piece's words lie whole in some passage. A piece's impacts are
divided by its score for itself, so one threshold (the share of that score which a passage reaches) holds for all.

Retrieval skips as block-max WAND does, for all passages of a batch at once: pieces are kept in blocks with each term's
greatest impact in the block. A passage's bound for a block is the sum of its terms' block maxima (rarer terms' from
their postings, common terms' by a product with the table of their maxima); only blocks whose bound reaches the threshold are scored, and all pieces at or above it are
retrieved. The bound is never less than the score, so none is lost.

A retrieved item counts as leaked if enough of its question's and of its answer's n-grams stand in the document (the
answer is what follows the first question mark; an item without one is all question, so on a table of plain passages
without question marks this is the overlap with the whole item).

The index is broadcast in parts of at most INDEX_WORDS words each; more items make more parts, each queried by all
passages. Document frequencies are those of all items whatever the parts.

Items of fewer than LEAST_WORDS words are not in the index: they are looked for by their exact sequence of words, with
score and overlaps of 1.

Items are told apart by row, not by item_id, which is only put out; a null item_id is put out as null. Edge cases: null
and wordless texts and items find nothing; rows that repeat an id are reported once per document id and item id, with the
greatest of each figure; a document without leaks has no row; an empty table on either side gives an
empty result; columns with other names are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import ALNUM, documents, id_key, lists, packed, small_batches, stored, windows, words_of

PIECE, BLOCK = 64, 8
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, NGRAM = 0.5, 0.6, 5
#: Items of fewer words are looked for by their exact sequence of words.
LEAST_WORDS = 5
INDEX_WORDS = 1 << 20
#: Passages whose bounds are worked out at once.
TILE = 1024
#: Terms in more than this share of the pieces are common.
COMMON = 0.05


def _pieces(batches):
    """Rows (item, piece, words) of batches of (item, text)."""
    for batch in batches:
        items, numbers, parts = [], [], []
        for row, words in words_of(batch.column(1), ALNUM, True):
            for d in range(len(words.at) - 1):
                h = words.hash[words.at[d] : words.at[d + 1]].view(np.int64)
                for n, i in enumerate(range(0, len(h), PIECE)):
                    items.append(batch.column(0)[row + d].as_py())
                    numbers.append(n)
                    parts.append(h[i : i + PIECE])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(numbers, pa.int32()), lists(parts, pa.int64())], ["item", "piece", "words"])


def _grams(h: np.ndarray, ngram: int) -> np.ndarray:
    return np.unique(windows(h, min(ngram, len(h)))) if len(h) else np.empty(0, np.uint64)


def _parts_of_items(batches, ngram: int):
    """(item, question n-grams, answer n-grams, their n) of batches of (item, question, answer); few words are one n-gram."""
    for batch in batches:
        grams, sizes = [[], []], [[], []]
        for k in (0, 1):
            for _, words in words_of(batch.column(k + 1), ALNUM, True):
                for a, b in zip(words.at[:-1], words.at[1:], strict=True):
                    sizes[k].append(min(ngram, int(b - a)))
                    grams[k].append(_grams(words.hash[a:b], ngram).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(lists(x, pa.int64()) for x in grams), *(pa.array(x, pa.int32()) for x in sizes)], ["item", "question", "answer", "q", "a"])


def _sequences(batches):
    """(item_id, n, hash of the word sequence) of batches of (item_id, text)."""
    for batch in batches:
        sizes, hashes = [], []
        for _, words in words_of(batch.column(1), ALNUM, True):
            for a, b in zip(words.at[:-1], words.at[1:], strict=True):
                sizes.append(int(b - a))
                hashes.append(windows(words.hash[a:b], int(b - a)).view(np.int64)[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], ["item_id", "n", "sequence"])


class Short:
    """Short items by their number of words: sorted hashes of the word sequences, and the ids of each."""

    def __init__(self, rows: list[dict]):
        ids: dict[int, dict[int, set]] = {}
        for r in rows:
            ids.setdefault(r["n"], {}).setdefault(r["sequence"], set()).add(r["item_id"])
        self.held = {n: (np.array(sorted(x), np.int64), [list(x[h]) for h in sorted(x)]) for n, x in ids.items()}

    def find(self, words):
        """(document, item id) of the texts of `words`, each once."""
        found = set()
        for n, (known, ids) in self.held.items():
            h = windows(words.hash, n).view(np.int64)
            if not len(h):
                continue
            doc = np.searchsorted(words.at, np.arange(len(h)), "right") - 1
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = (known[at] == h) & (np.arange(len(h)) + n <= words.at[doc + 1])
            pairs = np.unique(np.stack([doc[hit], at[hit]], 1), axis=0)
            found.update((int(d), i) for d, k in pairs for i in ids[k])
        return found


class Index:
    """Postings of some pieces, as arrays sorted by term and piece; impacts are shares of a piece's own score."""

    def __init__(self, items, words: list[np.ndarray], df: dict[int, int], total: int, mean: float):
        self.items = np.asarray(items)
        rows = []
        for i, h in enumerate(words):
            terms, tf = np.unique(h.view(np.uint64), return_counts=True)
            n = np.array([df[int(t)] for t in terms.view(np.int64)])
            idf = np.log1p((total - n + 0.5) / (n + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            rows.append((terms, np.full(len(terms), i), impact / impact.sum(), n))
        term, piece, impact, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((piece, term))
        term, self.piece, self.impact, n = term[order], piece[order], impact[order], n[order]
        self.terms, self.first = np.unique(term, return_index=True)
        self.stop = np.r_[self.first[1:], len(term)]
        self.common = n[self.first] > max(BLOCK, COMMON * total)
        which = np.repeat(np.arange(len(self.terms)), self.stop - self.first)
        self.blocks = int(piece.max()) // BLOCK + 1
        keys, at = np.unique(which * self.blocks + self.piece // BLOCK, return_index=True)
        self.block, self.block_most = keys % self.blocks, np.maximum.reduceat(self.impact, at)
        self.block_first = np.searchsorted(keys // self.blocks, np.arange(len(self.terms) + 1))
        # The common terms' block maxima as a table: few terms, in nearly all blocks.
        self.row = np.cumsum(self.common) - 1
        self.table = np.zeros((int(self.common.sum()), self.blocks), np.float32)
        owner = keys // self.blocks
        held = self.common[owner]
        self.table[self.row[owner[held]], self.block[held]] = self.block_most[held]
        self.each = np.zeros((len(self.table), self.blocks, BLOCK), np.float32)
        held = self.common[which]
        self.each[self.row[which[held]], self.piece[held] // BLOCK, self.piece[held] % BLOCK] = self.impact[held]

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float):
        """(passage, piece, score) of all at or above the threshold; passage and term: distinct pairs, sorted."""
        n = int(passage.max()) + 1
        common = self.common[term]
        has = np.zeros((n, len(self.table)), np.float32)
        has[passage[common], self.row[term[common]]] = 1
        rest = has @ self.table + np.float32(1e-4)  # a bound stays one when it is rounded
        p, t = passage[~common], term[~common]
        sizes = self.block_first[t + 1] - self.block_first[t]
        at = np.repeat(self.block_first[t] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rest.ravel()[:] += np.bincount(np.repeat(p, sizes) * self.blocks + self.block[at], self.block_most[at], rest.size)
        asked = np.flatnonzero(rest.ravel() >= threshold)
        if not len(asked):
            return
        of, block = asked // self.blocks, asked % self.blocks
        scores = np.zeros((len(asked), BLOCK))
        for k in np.flatnonzero(has[of].any(0)):
            scores += has[of, k][:, None] * self.each[k, block]
        wanted = np.isin(p, of)
        p, t = p[wanted], t[wanted]
        sizes = self.stop[t] - self.first[t]
        at = np.repeat(self.first[t] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        keys = np.repeat(p, sizes) * self.blocks + self.piece[at] // BLOCK
        where = np.minimum(np.searchsorted(asked, keys), len(asked) - 1)
        hit = asked[where] == keys
        scores += np.bincount(where[hit] * BLOCK + self.piece[at[hit]] % BLOCK, self.impact[at[hit]], scores.size).reshape(scores.shape)
        for i, j in zip(*np.nonzero(scores >= threshold - 1e-6), strict=True):
            yield int(of[i]), int(block[i]) * BLOCK + int(j), float(scores[i, j])


def _retrieved(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float):
    """Index.retrieve for TILE passages at a time, so that a long text's bounds take no more room than a short one's."""
    cuts = np.searchsorted(passage, np.arange(0, int(passage[-1]) + TILE, TILE))
    for k, (i, j) in enumerate(zip(cuts, np.r_[cuts[1:], len(passage)], strict=True)):
        if i < j:
            for p, piece, score in index.retrieve(passage[i:j] - k * TILE, term[i:j], threshold):
                yield p + k * TILE, piece, score


_FOUND = "key long, tag long, item long, score double, question_overlap double, answer_overlap double"


def _leaks(batches, index: Index | None, parts: dict, short: Short, threshold: float, overlap: float, ngram: int):
    """Rows (key, tag, item, score, overlaps) of batches of (key, tag, text)."""
    for batch in batches:
        out = []
        for row, words in words_of(batch.column(2), ALNUM, True):
            if not len(words.hash):
                continue
            out += [(batch.column(0)[row + d].as_py(), batch.column(1)[row + d].as_py(), item, 1.0, 1.0, 1.0) for d, item in short.find(words)]
            if index is None:
                continue
            lengths = np.diff(words.at)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            # Passages of a document: one begins at every PIECE words; the last may be short.
            per_doc = np.maximum(1, -(-lengths // PIECE))
            base = np.r_[0, np.cumsum(per_doc)]
            begun = base[doc] + (np.arange(len(doc)) - words.at[doc]) // PIECE
            at = np.searchsorted(index.terms, words.hash)
            at[at == len(index.terms)] = 0
            known = np.flatnonzero(index.terms[at] == words.hash)
            if not len(known):
                continue
            begun, term = begun[known], at[known]
            second = begun > base[doc[known]]
            size = len(index.terms)
            pairs = np.unique(np.r_[begun * size + term, (begun[second] - 1) * size + term[second]])
            best: dict[tuple[int, int], float] = {}
            for p, piece, score in _retrieved(index, pairs // size, pairs % size, threshold):
                d = int(np.searchsorted(base, p, "right")) - 1
                key = (d, int(index.items[piece]))
                best[key] = max(score, best.get(key, 0.0))
            for d in {d for d, _ in best}:
                h = words.hash[words.at[d] : words.at[d + 1]]
                have: dict[int, np.ndarray] = {}
                for item, score in sorted((i, s) for (e, i), s in best.items() if e == d):
                    shares = []
                    item_id, halves = parts[item]
                    for grams, size_of in halves:
                        if not len(grams):
                            shares.append(1.0)
                            continue
                        if size_of not in have:
                            have[size_of] = np.unique(windows(h, size_of))
                        shares.append(float(np.isin(grams, have[size_of], assume_unique=True).mean()))
                    if min(shares) >= overlap:
                        out.append((batch.column(0)[row + d].as_py(), batch.column(1)[row + d].as_py(), item_id, score, *shares))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], ["key", "tag", "item", "score", "question_overlap", "answer_overlap"])


def _tag() -> F.Column:
    """A hash of the text, which tells rows of one id apart."""
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _leaking_rows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, ngram: int = NGRAM, index_words: int = INDEX_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, tag, item, score, question_overlap, answer_overlap) of every row (doc_id, text) that holds an item (item_id, text); tag is a hash of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(id_key("doc_id").alias("key"), _tag().alias("tag"), F.col("text").cast("binary").alias("text"))
    split = F.regexp_extract("text", r"(?s)^([^?]*\?)(.*)$", 1), F.regexp_extract("text", r"(?s)^([^?]*\?)(.*)$", 2)
    n_words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), "text", n_words.alias("n")).filter("n > 0")
    numbered = stored(numbered.withColumn("item", F.monotonically_increasing_id()), "items")  # numbers that stay the same
    halves = numbered.filter(F.col("n") >= least_words).select("item", "item_id", "text", F.when(F.trim(split[1]) == "", "").otherwise(split[1]).alias("_a"), split[0].alias("_q"))
    halves = halves.select("item", "item_id", F.when(F.col("_a") == "", F.col("text")).otherwise(F.col("_q")).alias("question"), F.col("_a").alias("answer"), "text")
    pieces = halves.select("item", "text").mapInArrow(_pieces, "item long, piece int, words array<long>")
    told = pieces.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    few = numbered.filter(F.col("n") < least_words)
    total = (told["words"] or 0) + (few.agg(F.sum("n")).first()[0] or 0)
    frequency = pieces.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    count = -(-total // index_words)
    out = None
    for k in range(count):
        mine = F.pmod(F.xxhash64("item"), F.lit(count)) == k
        held = pieces.filter(mine).orderBy("item", "piece").toArrow()
        sequences = few.filter(mine).select("item_id", "text").mapInArrow(_sequences, "item_id long, n int, sequence long").distinct().toArrow().to_pylist()
        if not held.num_rows and not sequences:
            continue
        index, short = None, Short(sequences)
        if held.num_rows:
            used = pieces.filter(mine).select(F.explode("words").alias("term")).distinct()
            df = frequency.join(used, "term").toArrow()
            index = Index(held["item"].to_numpy(), [x.values.to_numpy() for x in held["words"]], dict(zip(df["term"].to_pylist(), df["df"].to_pylist(), strict=True)), told["n"], told["words"] / told["n"])
        grams = halves.filter(mine).select("item", "question", "answer").mapInArrow(lambda b: _parts_of_items(b, ngram), "item long, question array<long>, answer array<long>, q int, a int")
        ids = {r["item"]: r["item_id"] for r in halves.filter(mine).select("item", "item_id").toArrow().to_pylist()}
        parts = {r["item"]: (ids[r["item"]], [(np.array(r[c], np.int64).view(np.uint64), r[n]) for c, n in (("question", "q"), ("answer", "a"))]) for r in grams.toArrow().to_pylist()}
        shared = spark.sparkContext.broadcast((index, parts, short))
        found = keyed.mapInArrow(lambda b, s=shared: _leaks(b, *s.value, threshold, overlap, ngram), _FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _FOUND) if out is None else out


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap) of every document (doc_id, text) that holds an item (item_id, text)."""
    out = _leaking_rows(docs, items, **options)
    return out.groupBy("key", "item").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, whatever its length."""
    found = _leaking_rows(docs, items, **options).select(F.col("key").alias("_key"), F.col("tag").alias("_tag")).distinct()
    return packed(docs, id_key("doc_id").alias("_key"), _tag().alias("_tag")).join(found, ["_key", "_tag"], "left_anti").select("row.*")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    doc_id = F.when(F.col("key") != F.lit(-(1 << 63)), F.col("key")).alias("doc_id")
    return found.select(doc_id, F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")

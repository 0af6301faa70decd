"""Toxicity of texts after noisy-channel deobfuscation.

1. A character language model (trigrams of letters) is counted over the words of all documents.
2. Words that look disguised (signs or digits among letters, a letter three times in a row, separators within a word,
   three or more letters and signs spaced out) become a lattice: each sign may stand for the letters it resembles, a run
   for one or two of its letter, a sign within a word for nothing; a separator may also part words, and punctuation end
   one. The Viterbi path, least cost under the channel and the language model, is the word restored.
3. Features of the restored text are its words and their beginnings (PREFIXES letters). A feature's toxicity is the lower
   bound of its share of toxic texts in a bounded sample of labelled ones (about SAMPLE of each label, by hash of the id,
   weighted back to all); features of LEAST_TEXTS toxic texts or more, surely above LEAST, are all kept.
4. A text's score is the noisy-or of its words' toxicities and of the rate among texts without such a word.

Edge cases: null and empty texts score that base rate; without labels of both kinds all score 0; a null id is not learned
from; a document labelled more than once counts each label; rows that repeat an id are scored each; an empty table gives
an empty result; columns with other names are not used.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import ALNUM, NOT_SPACE, Words, _prefix, documents, mixed, small_batches, spans, stored, text_chunks

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SAMPLE, LEAST, LEAST_TEXTS, PREFIXES, SEED = 20_000, 0.55, 5, (4, 5, 6), "toxicity-1"

#: Letters that a sign resembles.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "&": "e", "*": "aeiou", "#": "h", "%": "x",
}
#: Signs that are no punctuation at a word's end.
_NO_END = "0123456789@$"
_COST, _STAYS, _DROPS, _DROPS_SIGN, _ABSORBED = 1.0, 5.0, 1.0, 9.0, 0.3
#: Symbols of the language model: 0 a word's edge, 1 to 26 letters, 27 any other letter or digit.
SYMBOLS = 28
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = _SYMBOL[128:] = 27
_LETTER = (_SYMBOL > 0) & (_SYMBOL < 27)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in RESEMBLES]] = True
_PARTS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_PARTS[[ord(c) for c in "._-"]] = True
_GAPS[[ord(c) for c in " ._-*"]] = True

_SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W\d_]|[0-9@$!|+(<&*#%])[ .\-_*]){2,}(?:[^\W\d_]|[0-9@$!|+(<&*#%])(?![^\W_])")
_DISGUISED = re.compile(
    r"[^\W\d_][0-9@$!|+(<&*#%]|[0-9@$!|+(<][^\W\d_]|([^\W\d_])\1\1"
    r"|[^\W\d_][._\-]+(?:[^\W\d_]|[0-9@$!|+(<&*#%])|[0-9@$!|+(<&*#%][._\-]+[^\W\d_]"
)


def _trigrams(batches):
    """One row of all trigram counts of a task's texts, as an array."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, data, _ in text_chunks(batch.column(0)):
            s = np.r_[0, 0, _SYMBOL[data], 0]
            code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            counts += np.bincount(code[(s[1:-1] > 0) | (s[2:] > 0)], minlength=SYMBOLS**3)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], ["counts"])


class Restorer:
    """Restores disguised words under a character language model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.01
        # A word begins after an edge: what stands before the edge does not matter.
        tri[:, 0, :] = tri[:, 0, :].sum(0)
        self.cost = -np.log(tri / tri.sum(2, keepdims=True))
        self.word = lru_cache(1 << 16)(self._word)

    def __reduce__(self):
        return (_restorer, (self.cost,))

    def _word(self, word: str) -> str:
        """The least costly reading of a word's lattice."""
        cost = self.cost
        states = {(0, 0): (0.0, "")}
        solid = "".join(c for c in word if c.isalpha() or c in RESEMBLES)
        n, i = len(solid), -1
        last = max((k for k, c in enumerate(solid) if c.isalpha()), default=-1)
        for c in word:
            letter = c.isalpha()
            parts = not letter and c not in RESEMBLES
            i += not parts
            run = not parts and ((i >= 2 and solid[i - 2 : i + 1] == c * 3) or (0 < i < n - 1 and solid[i - 1 : i + 2] == c * 3))
            # What parts two words is an edge to the language model, and so is a sign of punctuation at the end.
            ends = 0.0 if parts and 0 <= i < n - 1 else _COST if i > last and not parts and c not in _NO_END else None
            if letter:
                readings = [(c, 0.0)]
            elif c in RESEMBLES:
                readings = [(x, _COST) for x in RESEMBLES[c]] + [(c, _STAYS)]
            else:
                readings = [(c, _STAYS)]
            new: dict = {}
            for (a, b), (total, text) in states.items():
                options = []
                for x, channel in readings:
                    s = ord(x) - 96 if "a" <= x <= "z" else 27
                    options.append(((b, s), total + channel + cost[a, b, s], text + x))
                if ends is not None:
                    options.append(((0, 0), total + (ends + cost[a, b, 0] if b else 0.0), text + c))
                if not letter:
                    options.append(((a, b), total + (_DROPS_SIGN if c in RESEMBLES else _DROPS), text))
                elif run and text.endswith(c):
                    options.append(((a, b), total + _ABSORBED, text))
                for state, t, x in options:
                    if state not in new or (t, x) < new[state]:
                        new[state] = (t, x)
            states = new
        return min((t + (cost[a, b, 0] if b else 0.0), x) for (a, b), (t, x) in states.items())[1]

    def token(self, word: str) -> str:
        """A word between spaces, restored if it looks disguised."""
        return self.word(word) if _DISGUISED.search(word) else word

    def spaced(self, text: str) -> str:
        """A text with its spaced-out words restored."""
        return _SPACED.sub(lambda m: self._joined(m[0]), text)

    def _joined(self, run: str) -> str:
        """A run of letters and signs, each apart from the next by one character, as the language model reads it."""
        if not any(c.isalpha() for c in run[::2]):
            return run
        return self.word("".join(" " if k % 2 and c == "*" else c for k, c in enumerate(run)))

    def text(self, text: str) -> str:
        """A lower-cased text with its disguised words restored."""
        return self.spaced(re.sub(r"\S+", lambda m: self.token(m[0]), text))


def _restorer(cost: np.ndarray) -> Restorer:
    out = Restorer(np.zeros(SYMBOLS**3))
    out.cost = cost
    return out


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of signs that may stand for letters, of separators within words and of letters three times in a row; places of spaced-out letters and signs."""
    if len(data) < 7:
        data = np.r_[data, np.full(7 - len(data), 32, np.uint8)]
    letter = _LETTER[data] | (data >= 128)
    disguised = np.zeros(len(data), bool)
    disguised[:-1] = (_SIGN[data[:-1]] & letter[1:]) | (letter[:-1] & _SIGN[data[1:]])
    disguised[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    sign, parts = _SIGN[data], _PARTS[data]
    solid = letter | sign
    within = parts[1:-1] & (solid | parts)[:-2] & (solid | parts)[2:]
    disguised[:-2] |= within & (letter[:-2] | letter[2:])
    # Three characters with one between each two, the first and the last not part of a word.
    wordly = letter | ((data >= 48) & (data <= 57))
    begins, ends = np.ones(len(data), bool), np.ones(len(data), bool)
    begins[1:], ends[:-1] = ~wordly[:-1], ~wordly[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = ends[inner - 1] = True
    gap = _GAPS[data]
    some = letter[:-4] | letter[2:-2] | letter[4:]
    spaced = begins[:-4] & solid[:-4] & gap[1:-3] & solid[2:-2] & gap[3:-1] & solid[4:] & ends[4:] & some
    return np.flatnonzero(disguised), np.flatnonzero(spaced)


def _restored(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their disguised words restored: only words at marked places are looked at."""
    disguised, spaced = _marks(data, offsets)
    if not len(disguised) and not len(spaced):
        return data, offsets
    raw = data.tobytes()
    edge = ~NOT_SPACE[data]
    parting = edge.copy()
    parting[offsets[offsets < len(data)]] = True
    stops = np.flatnonzero(parting)
    pieces, at, sizes = [], 0, np.diff(offsets)
    k = np.searchsorted(stops, disguised, "right")
    for i in np.unique(k):
        begin, end = int(stops[i - 1]), int(stops[i]) if i < len(stops) else len(data)
        if begin < len(data) and edge[begin]:
            begin += 1
        word = raw[begin:end].decode("utf-8", "replace")
        new = restorer.token(word)
        if new != word:
            new = new.encode()
            pieces += [raw[at:begin], new]
            sizes[np.searchsorted(offsets, begin, "right") - 1] += len(new) - (end - begin)
            at = end
    pieces.append(raw[at:])
    out, offsets_out = b"".join(pieces), np.r_[0, np.cumsum(sizes)]
    if len(spaced):
        parts = [out[a:b] for a, b in zip(offsets_out[:-1], offsets_out[1:], strict=True)]
        for d in np.unique(np.searchsorted(offsets, spaced, "right") - 1):
            parts[d] = restorer.spaced(parts[d].decode("utf-8", "replace")).encode()
        out, offsets_out = b"".join(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
    return np.frombuffer(out, np.uint8), offsets_out


def _features(column: pa.Array, restorer: Restorer):
    """(row, distinct features with -1 for none, a row for each distinct word: the word and its beginnings) of every text."""
    for row, data, offsets in text_chunks(column):
        data, offsets = _restored(data, offsets, restorer)
        words = Words(data, offsets, ALNUM, False)
        from_bytes = _prefix(_byte_values(words.data))
        columns = [words.hash]
        for k in PREFIXES:
            stop = np.minimum(words.start + k, words.end)
            columns.append(mixed(spans(from_bytes, words.start, stop) + np.uint64(k)))
            columns[-1][words.end - words.start < k] = 0
        table = np.stack(columns, 1).view(np.int64)
        for d in range(len(offsets) - 1):
            yield row + d, table[words.at[d] : words.at[d + 1]]


def _byte_values(data: np.ndarray) -> np.ndarray:
    return mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[data]


def _labelled(batches, restorer: Restorer):
    """(feature, toxic texts, clean texts) counted within each batch of (toxic, text); feature 0 counts the texts."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        held = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for row, table in _features(batch.column(1), restorer):
            held[int(toxic[row] == 1)].append(np.unique(np.r_[0, table.ravel()]))
        for kind in (0, 1):
            features, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(n if kind else none), pa.array(none if kind else n)], ["feature", "toxic", "clean"])


class Model:
    """Toxicities of features, sorted by feature, the base rate, and the restorer."""

    def __init__(self, restorer: Restorer, features: np.ndarray, rates: np.ndarray, base: float):
        self.restorer, self.features, self.rates, self.base = restorer, features, rates, base

    def score(self, table: np.ndarray) -> float:
        if not len(self.features) or not len(table):
            return self.base
        at = np.minimum(np.searchsorted(self.features, table), len(self.features) - 1)
        rates = np.where(self.features[at] == table, self.rates[at], 0.0).max(1)
        hit = np.flatnonzero(rates > 0)
        if not len(hit):
            return self.base
        _, first = np.unique(table[hit, 0], return_index=True)
        return float(1 - (1 - self.base) * np.prod(1 - rates[hit[first]]))


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of docs (doc_id, text; labels: doc_id, toxic), its language model counted over corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    lower = F.lower("text").cast("binary").alias("text")
    tasks = corpus.select(lower).mapInArrow(_trigrams, "counts array<long>")
    told = tasks.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    if told.num_rows:
        counts[told["k"].to_numpy()] = told["n"].to_numpy()
    restorer = Restorer(counts)
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").filter(~held_out())
    usable = usable.distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(restorer, np.empty(0, np.int64), np.empty(0), 0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    chosen = usable.filter(draw < F.when(F.col("toxic") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0])))
    # About 2 * sample ids whatever the input, so their list goes to the texts.
    rows = docs.select("doc_id", lower).join(F.broadcast(stored(chosen, "sample")), "doc_id").select("toxic", "text")
    parts = rows.mapInArrow(lambda b: _labelled(b, restorer), "feature long, toxic long, clean long")
    totals = stored(parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    drawn = totals.filter("feature = 0").first()
    if not drawn or not drawn["toxic"] or not drawn["clean"]:
        return Model(restorer, np.empty(0, np.int64), np.empty(0), 0.0)
    up, down = sizes[1] / drawn["toxic"], sizes[0] / drawn["clean"]
    n = F.col("toxic") + F.col("clean")
    share = (F.col("toxic") * up) / (F.col("toxic") * up + F.col("clean") * down)
    z2 = 1.96**2
    bound = (share + z2 / (2 * n) - 1.96 * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    best = totals.filter((F.col("feature") != 0) & (F.col("toxic") >= LEAST_TEXTS)).select("feature", "toxic", bound.alias("rate")).filter(F.col("rate") >= LEAST)
    best = best.toArrow()  # all of them: the sample bounds their number
    order = np.argsort(best["feature"].to_numpy())
    model = Model(restorer, best["feature"].to_numpy()[order], best["rate"].to_numpy()[order], 0.0)
    shared = spark.sparkContext.broadcast(model)
    plain = rows.mapInArrow(lambda b: _unmarked(b, shared.value), "toxic int").groupBy("toxic").count().collect()
    rest = {r["toxic"]: r["count"] for r in plain}
    unmarked = rest.get(1, 0) * up + rest.get(0, 0) * down
    model.base = min(0.6, rest.get(1, 0) * up / unmarked) if unmarked else 0.0
    return model


def _unmarked(batches, model: Model):
    """The labels of texts without any kept feature."""
    for batch in batches:
        keep = [model.score(table) == 0.0 for _, table in _features(batch.column(1), model.restorer)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()).filter(pa.array(keep, pa.bool_()))], ["toxic"])


def _scored(batches, model: Model):
    for batch in batches:
        scores = [model.score(table) for _, table in _features(batch.column(0), model.restorer)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "_score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and _score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.lower("text").cast("binary").alias("text"), "doc_id")
    return rows.mapInArrow(lambda b: _scored(b, shared.value), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"), docs)
    scored = score(docs, model).withColumn("score", F.round("_score", 6))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

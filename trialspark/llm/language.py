"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

A text is the frequencies of its byte trigrams (lower-cased; all but letters is a space), hashed to BINS. Machines are
trained one per pair: of families, and of languages within a family, each pair in a task of its own, on a bounded sample
of labelled documents: about SAMPLE in all, as many of each language, chosen by hash of the id. A text's family is the
one that wins most of its pairs (ties: the greater sum of margins), its language likewise. The score is the product of
both steps' certainty, a logistic function of the least margin that the winner has over another.

Edge cases: a null text, or one without letters, is `und` with score 0; so are all texts where no labelled document may
be learned from; with one learned language every other text has it, with score 1; a null id is held out; rows that
repeat an id are predicted each; an empty table gives an empty result; other columns are kept by `by_language`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, packed, small_batches, stored, text_chunks

BINS, SAMPLE, SEED = 1 << 12, 2000, "language-1"
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
}

_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)


def _counts(column: pa.Array, bins: int):
    """(row, trigram counts by bin) of every text of a column; counts are those of trigrams with a letter."""
    for row, data, offsets in text_chunks(column):
        x = _PLAIN[data]
        if len(x) < 3:
            for d in range(len(offsets) - 1):
                yield row + d, np.zeros(bins)
            continue
        code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bin_of = (code >> np.uint32(32 - bins.bit_length() + 1)).astype(np.int32)
        letter = _LETTER[data]
        some = letter[:-2] | letter[1:-1] | letter[2:]
        bin_of[~some] = bins
        for d in range(len(offsets) - 1):
            yield row + d, np.bincount(bin_of[offsets[d] : max(offsets[d], offsets[d + 1] - 2)], minlength=bins + 1)[:bins]


def _features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies."""
    return np.sqrt(counts / max(1, counts.sum()))


def _sample_rows(batches, bins: int):
    for batch in batches:
        x = [_features(c).astype(np.float32).tobytes() for _, c in _counts(batch.column(1), bins)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])


def _train(pair: pd.DataFrame, steps: int = 300, penalty: float = 1e-4) -> pd.DataFrame:
    """A linear support vector machine (squared hinge, accelerated gradient) of one pair; side is 1 or -1."""
    pair = pair.sort_values(["x"])
    x = np.stack([np.frombuffer(v, np.float32) for v in pair["x"]])
    y = pair["side"].to_numpy(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    center = x.mean(0)
    x -= center
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    v, v_bias, rate = w, bias, 1.0 / (2 * float((x * x).sum(1).max() + 1) + penalty)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + v_bias)) * y * weight
        new, new_bias = v + rate * (2 * (slack @ x) - penalty * v), v_bias + rate * 2 * slack.sum()
        pull = k / (k + 3)
        v, v_bias = new + pull * (new - w), new_bias + pull * (new_bias - w.dtype.type(bias))
        w, bias = new, float(new_bias)
    return pd.DataFrame({"high": [pair["high"].iloc[0]], "low": [pair["low"].iloc[0]], "level": [pair["level"].iloc[0]], "w": [w.astype(np.float64).tolist()], "bias": [bias - float(center @ w)]})


class Model:
    """Machines of pairs at both levels, and how they vote."""

    def __init__(self, families: dict[str, list[str]], machines: dict):
        self.families, self.machines = families, machines
        self.keys = list(machines)
        self.weights = np.stack([machines[k][0] for k in self.keys], 1) if machines else np.zeros((1, 0))
        self.bias = np.array([machines[k][1] for k in self.keys])

    def _winner(self, level: str, names: list[str], margins: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes = {a: [0, 0.0, np.inf] for a in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                m = margins[(level, a, b)]
                for name, mine in ((a, m), (b, -m)):
                    votes[name] = [votes[name][0] + (mine > 0), votes[name][1] + mine, min(votes[name][2], mine)]
        best = max(names, key=lambda n: (votes[n][0], votes[n][1], n))
        return best, float(1 / (1 + np.exp(-4 * votes[best][2])))

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        margins = dict(zip(self.keys, _features(counts) @ self.weights + self.bias, strict=True)) if self.keys else {}
        family, sure = self._winner("family", sorted(self.families), margins)
        lang, surer = self._winner(family, sorted(self.families[family]), margins)
        return lang, sure * surer


def train(docs: DataFrame, sample: int = SAMPLE, bins: int = BINS) -> Model:
    """A model learned from docs (doc_id, text, lang): all rows may be learned from but those with a null text or lang."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    families: dict[str, list[str]] = {}
    for lang in sizes:
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    each = max(1, sample // max(1, len(sizes)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(share)
    chosen = known.filter(draw < share).select("lang", F.lower("text").cast("binary").alias("text"))
    rows = stored(chosen.mapInArrow(lambda b: _sample_rows(b, bins), "lang string, x binary"), "sample")
    pairs = [("family", a, b) for i, a in enumerate(sorted(families)) for b in sorted(families)[i + 1 :]]
    pairs += [(f, a, b) for f, langs in families.items() for i, a in enumerate(sorted(langs)) for b in sorted(langs)[i + 1 :]]
    if not pairs:
        return Model(families, {})
    family_of = {lang: f for f, langs in families.items() for lang in langs}
    sides = [(level, a, b, lang, 1 if name == a else -1) for level, a, b in pairs for lang in sizes for name in [family_of[lang] if level == "family" else lang] if name in (a, b) and (level == "family" or family_of[lang] == level)]
    table = spark.createDataFrame(sides, "level string, high string, low string, lang string, side int")
    trained = rows.join(F.broadcast(table), "lang").groupBy("level", "high", "low").applyInPandas(lambda pair: _train(pair), "high string, low string, level string, w array<double>, bias double").toArrow().to_pylist()
    machines = {(r["level"], r["high"], r["low"]): (np.array(r["w"]), r["bias"]) for r in trained}
    machines |= {p: (np.zeros(bins), 0.0) for p in pairs if p not in machines}  # no sampled row: every vote is a tie
    return Model(families, machines)


def _predicted(batches, model: Model, bins: int):
    for batch in batches:
        names, scores = [], []
        has = batch.column(1).to_pylist()
        for row, counts in _counts(batch.column(0), bins):
            lang, score = model.predict(counts) if has[row] and model.families else (UNKNOWN, 0.0)
            names.append(lang)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[2:], "_lang", "_score"])


def by_language(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), bins: int = BINS) -> DataFrame:
    """The columns `keep`, _lang and _score of every row of docs (text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.lower("text").cast("binary").alias("_text"), has.alias("_has"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)))
    schema = "".join(f"_c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = rows.mapInArrow(lambda b: _predicted(b, shared.value, bins), f"{schema}_lang string, _score double")
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(keep)})


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose text has a language, by a model of its own labelled rows; a null
    lang becomes the language found. Where no row may be learned from, all texts with letters stay as they are."""
    model = train(docs.filter(~held_out()))
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = by_language(packed(docs, "text"), model, ("row",)).filter(F.col("_lang") != UNKNOWN)
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "_lang")).alias("row")).select("row.*")


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = by_language(docs, train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.round("_score", 6).alias("score"))

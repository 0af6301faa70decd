"""Token counts by section: a text is encoded once as a whole, and its tokens are attributed by their places.

Tokens of a byte-level vocabulary tile the text, so the running sum of their lengths is their byte offsets. Sorted token
spans and sorted section spans are joined by interval within the task that holds the document. A token that lies in
several sections is allocated by a rule:
- "most": to the section that holds most of its bytes, of equals the first (the default);
- "start" or "end": to the section of its first or last byte;
- "split": to each section by its share of the token's bytes.
Under every rule a document's counts sum to its number of tokens.

The vocabulary is a file of ranks whose path is a parameter; it is read once and broadcast (about 1 MB).

Edge cases: a null or empty text is one empty section without tokens; a text that ends with the separator ends with an
empty section; rows that repeat an id are counted each; a text of any length is encoded whole; an empty table gives an
empty result; columns with other names are not used.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut to pieces before they are encoded.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("most", "start", "end", "split")


class Encoder:
    """Encodes bytes of UTF-8 to token lengths; built anew in each worker from the broadcast ranks."""

    def __init__(self, ranks: bytes):
        self.ranks = ranks
        self._encoding = None

    def __getstate__(self):
        return {"ranks": self.ranks, "_encoding": None}

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of each token of a text."""
        if self._encoding is None:
            import tiktoken

            pairs = [line.split() for line in self.ranks.splitlines() if line]
            ranks = {base64.b64decode(a): int(b) for a, b in pairs}
            self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self._sizes[rank] = len(token)
        return self._sizes[np.asarray(self._encoding.encode_ordinary(text), np.int64)]


def allocated(lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, by token lengths and section starts (the first is 0, ascending)."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    n = len(starts)
    whole = first == last
    counts = np.bincount(first[whole], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for k in np.flatnonzero(~whole):
        sections = np.arange(first[k], last[k] + 1)
        cuts = np.clip(np.r_[starts[sections], ends[k]], begins[k], ends[k])
        shares = np.diff(cuts)
        crossing[sections[shares > 0]] += 1
        if rule == "split":
            counts[sections] += shares / lengths[k]
        else:
            counts[{"most": sections[int(shares.argmax())], "start": first[k], "end": last[k]}[rule]] += 1
    return counts, crossing


_SCHEMA = "section int, char_start long, char_end long, n_tokens double, n_crossing long"


def _attributed(batches, encoder: Encoder, rule: str, separator: int):
    for batch in batches:
        ids, parts = [], [[] for _ in range(5)]
        for row, text in enumerate(batch.column(0)):
            text = text.as_py() or ""
            data = np.frombuffer(text.encode(), np.uint8)
            starts = np.r_[0, np.flatnonzero(data == separator) + 1]
            counts, crossing = allocated(encoder.lengths(text), starts, rule) if len(data) else (np.zeros(1), np.zeros(1, np.int64))
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            edges = chars[np.r_[starts, len(data)]]
            ids.append(np.full(len(starts), row))
            for part, values in zip(parts, (np.arange(len(starts), dtype=np.int32), edges[:-1], edges[1:], counts, crossing), strict=True):
                part.append(values)
        if ids:
            columns = [c.take(pa.array(np.concatenate(ids))) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(p)) for p in parts)], [*batch.schema.names[1:], *(f.split()[0] for f in _SCHEMA.split(", "))])


def load_encoder(path: str = TOKENIZER) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def count_by_section(docs: DataFrame, rule: str = "most", separator: str = "\n", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each section (part between separators, which end the part before them) of every row of docs (doc_id, text)."""
    if rule not in RULES or len(separator.encode()) != 1:
        raise ValueError(f"rule is one of {RULES}, separator one ASCII character")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_encoder(tokenizer))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}"
    return docs.select("text", "doc_id").mapInArrow(lambda b: _attributed(b, shared.value, rule, ord(separator)), schema)


def count_by_field(rows: DataFrame, fields: list[str], rule: str = "most", tokenizer: str = TOKENIZER) -> DataFrame:
    """rows with n_tokens_<field> for each of fields: the fields are joined by line ends (line ends within them become
    spaces), encoded once, and a line end counts to the field before it."""
    text = F.concat_ws("\n", *(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\n", " ") for c in fields))
    keyed = rows.withColumn("doc_id", F.struct(*rows.columns)).select("doc_id", text.alias("text"))
    found = count_by_section(keyed, rule, tokenizer=tokenizer)
    sums = found.groupBy("doc_id").agg(*(F.sum(F.when(F.col("section") == k, F.col("n_tokens"))).alias(f"n_tokens_{c}") for k, c in enumerate(fields)))
    return sums.select("doc_id.*", *(f"n_tokens_{c}" for c in fields))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_by_section(documents(spark, sf_dir))
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))

"""Helpers that the operators share: byte-level tokenizing, rolling hashes, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of most operators, as a regular expression of words.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
CHUNK = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that belong to words."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of [^\x20\x09-\x0D] and, of lower-cased text, of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            powers = []
            for base in (_MULTIPLIER, _INVERSE):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                powers.append(np.cumprod(x, dtype=np.uint64))
            if n > 4 * CHUNK:  # not kept: a rare long text
                return powers[0], powers[1]
            cls.up, cls.down = powers
        return cls.up, cls.down


def _prefix(values: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k numbers in a row: the hash of h[i:i+k] at i."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    sums = _prefix(h)
    _, down = _Powers.get(len(sums))
    return mixed((sums[k:] - sums[:-k]) * down[: len(h) - k + 1] + np.uint64(k))


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans start..end (end excluded) of the numbers that prefix sums were made of."""
    _, down = _Powers.get(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: byte spans in `data`, hashes, and where each text's words begin."""

    __slots__ = ("data", "start", "end", "hash", "at")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        inside = table[data]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < n]
        new[first] = inside[first]
        final = offsets[1:][offsets[1:] > 0] - 1
        last[final] = inside[final]
        self.start, self.end = np.flatnonzero(new), np.flatnonzero(last) + 1
        sums = _prefix(_BYTES[data])
        self.hash = spans(sums, self.start, self.end)
        self.at = np.searchsorted(self.start, offsets)


def text_chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string or binary column as (first row, bytes, offsets); a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + chunk, "right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def words_of(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """The words of a string column, some rows at a time, as (first row, words)."""
    for row, data, offsets in text_chunks(column, chunk):
        yield row, Words(data, offsets, table, lower)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: planes of zeros take no room once compressed."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def numbers(data: bytes, kind) -> np.ndarray:
    """The numbers that `planes` made bytes of."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares; where spark.checkpoint.dir is unset, below the warehouse."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        top = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that `stored` made and that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_key(column) -> F.Column:
    """doc_id as a join key that is never null: a null id counts as the least long."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-(1 << 63)))


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns `used` and all columns as one struct `row`, so that helper columns can't clash with others of docs."""
    return docs.select(*used, F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 1 << 23) -> None:
    """Fewer rows and bytes in a batch to Python than Spark's default, since a row holds a whole text; a session's own choice stays."""
    for name, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes; null for null."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"

"""Binary files of fixed-length records read by ranges: one file is many tasks, and a range opens only what it covers.

Both formats are Spark data sources: partitions are planned from file sizes (or array headers) alone, and each task reads
its own bytes. Files may lie on any file system that Arrow opens (local, HDFS, S3, GCS); a folder is read whole, with its
folders, but for names that begin with a dot or an underscore.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a task, and of a batch that it hands to Spark.
SPLIT, BATCH = 1 << 27, 1 << 22


@dataclass
class Piece(InputPartition):
    """Records first to last (excluded) of a file; `group` is the number of the asked range."""

    path: str
    first: int
    last: int
    group: int = 0


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder, by name."""
    system, at = opened(path)
    told = system.get_file_info(at)
    if told.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [told] if told.is_file else [f for f in system.get_file_info(files.FileSelector(at, recursive=True)) if f.is_file]
    hidden = lambda f: any(x[:1] in "._" for x in f.path.removeprefix(at).split("/") if x)
    head = path.removesuffix(at) if path.endswith(at) else ""
    return sorted((head + f.path, f.size) for f in found if f.path.endswith(suffix) and (told.is_file or not hidden(f)))


def cut(path: str, n: int, per: int, first: int, last: int | None, group: int = 0) -> list[Piece]:
    """Pieces of at most `per` of a file's n records, on multiples of it, as far as they lie in first..last."""
    last = n if last is None else min(n, last)
    return [Piece(path, max(first, i), min(last, i + per), group) for i in range(first // per * per, last, per) if max(first, i) < min(last, i + per)]


class _RecordingReader(DataSourceReader):
    first, last = 0, None

    def __init__(self, options):
        self.path, self.n = options["path"], int(options["channels"])
        self.split, self.block = int(options.get("split", SPLIT)), int(options.get("block", 1 << 16))
        self.ranges = json.loads(options.get("ranges", "[[0, null]]"))
        self.chosen = json.loads(options["chosen"]) if "chosen" in options else None
        if self.n < 1 or self.split < 1 or self.block < 1:
            raise ValueError("channels, split and block are at least 1")
        if self.chosen is not None and not all(0 <= c < self.n for c in self.chosen):
            raise ValueError(f"channels are numbered from 0 to {self.n - 1}")

    def partitions(self):
        width, out = 2 * self.n, []
        for path, size in listed(self.path):
            for group, (first, last) in enumerate(self.ranges):
                ends = [x for x in (last, self.last) if x is not None]
                out += cut(path, size // width, max(1, self.split // width), max(0, first, self.first), min(ends) if ends else None, group)
        return out or [Piece("", 0, 0)]

    def read(self, piece) -> Iterator[pa.RecordBatch]:
        if piece.first >= piece.last:
            return
        width = 2 * self.n
        system, at = opened(piece.path)
        with system.open_input_file(at) as f:
            per = max(1, min(self.block, BATCH // width))
            for i in range(piece.first, piece.last, per):
                data = f.read_at(width * (min(piece.last, i + per) - i), i * width)
                part = np.frombuffer(data, "<i2").reshape(-1, self.n)
                part = part if self.chosen is None else np.ascontiguousarray(part[:, self.chosen])
                offsets = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32) if part.shape[1] else np.zeros(len(part) + 1, np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
                columns = [pa.array([piece.path] * len(part)), pa.array([piece.group] * len(part), pa.int32()), pa.array(np.arange(i, i + len(part))), values]
                yield pa.RecordBatch.from_arrays(columns, ["file", "range", "sample_idx", "values"])


class _FilteredRecordingReader(_RecordingReader):
    """Narrows the ranges by filters on sample_idx; Spark refuses such a reader where it may not push filters down."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("sample_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            else:
                yield f


class RecordingSource(DataSource):
    """int16 recordings, channels interleaved. Options: path, channels (how many a sample has), chosen (a JSON list of
    those wanted), ranges (a JSON list of [first, last] samples, last excluded or null), split (bytes of a task), block
    (most samples of a batch), filters (true: takes filters on sample_idx). A sample that a file holds only in part is left out."""

    @classmethod
    def name(cls):
        return "trial_recording"

    def schema(self):
        return "file string, range int, sample_idx long, values array<short>"

    def reader(self, schema):
        return (_FilteredRecordingReader if self.options.get("filters") == "true" else _RecordingReader)(self.options)


def array_header(path: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns are stored first, type and place of the data of a numpy file."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        told = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        shape, columns_first, kind = told
        if kind.hasobject or kind.names or kind.kind not in "biuf":
            raise ValueError(f"{path} isn't an array of numbers")
        return shape, columns_first, kind, f.tell()


class _ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path, _ in listed(self.path, ".npy"):
            shape, _, kind, _ = array_header(path)
            out += cut(path, prod(shape), max(1, self.split // kind.itemsize), 0, None)
        return out or [Piece("", 0, 0)]

    def read(self, piece) -> Iterator[pa.RecordBatch]:
        if piece.first >= piece.last:
            return
        shape, columns_first, kind, start = array_header(piece.path)
        system, at = opened(piece.path)
        with system.open_input_file(at) as f:
            per = BATCH // 64
            for i in range(piece.first, piece.last, per):
                n = min(piece.last, i + per) - i
                data = np.frombuffer(f.read_at(n * kind.itemsize, start + i * kind.itemsize), kind)
                stored = np.arange(i, i + n)
                index = np.stack(np.unravel_index(stored, shape, "F" if columns_first else "C"), 1) if shape else np.empty((n, 0), np.int64)
                rows = np.ravel_multi_index(index.T, shape) if shape else stored
                places = pa.ListArray.from_arrays(pa.array(np.arange(0, index.size + 1, max(1, len(shape)), dtype=np.int32) if shape else np.zeros(n + 1, np.int32)), pa.array(index.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([piece.path] * n), pa.array(stored), pa.array(rows, pa.int64()), places, pa.array(data.astype(float))], ["file", "stored", "idx", "at", "value"])


class ArraySource(DataSource):
    """Numpy arrays of numbers, of any shape: a row per element with its place in the file, its number in row-major order,
    its index (an array, one entry a dimension) and its value. Options: path, split (bytes of a task)."""

    @classmethod
    def name(cls):
        return "trial_arrays"

    def schema(self):
        return "file string, stored long, idx long, at array<long>, value double"

    def reader(self, schema):
        return _ArrayReader(self.options)

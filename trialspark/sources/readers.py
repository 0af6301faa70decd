"""Readers: each is one job over all files below a path, on any store that Spark reads."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.sources.ranges import SPLIT, ArraySource, RecordingSource

EXPERIMENTS = "animal_id string, probe_id string, session_id string, protocol string, experiment_group string, probe_type string, git_commit string, discard int"
METRICS = "cluster_id int, firing_rate double, isi_viol double, isolation_distance double, amplitude_cutoff double, max_drift double"
TRACK = "probe_id string, shank_id int, pos double, region_id int, region string"
REGION_MAP = "subregion string, parent_region string"


def recording(spark: SparkSession, path: str, n_channels: int, block_rows: int = 1 << 16, first: int = 0, last: int | None = None, channels: list[int] | None = None, split: int = SPLIT) -> DataFrame:
    """Samples of int16 recordings, channels interleaved: file, sample_idx and values (an array by channel).

    A file is cut to tasks of `split` bytes. Only splits that hold samples first to last (excluded; null: the end) are
    opened, and of each sample only `channels` are kept, in their order; filters on sample_idx narrow the range where
    spark.sql.python.filterPushdown.enabled is set.
    """
    return recording_ranges(spark, path, n_channels, [(first, last)], block_rows, channels, split).drop("range")


def recording_ranges(spark: SparkSession, path: str, n_channels: int, ranges: list[tuple[int, int | None]], block_rows: int = 1 << 16, channels: list[int] | None = None, split: int = SPLIT) -> DataFrame:
    """Samples of several ranges of each recording, with `range`, the number of the range that a sample lies in."""
    if n_channels < 1:
        raise ValueError("n_channels is at least 1")
    spark.dataSource.register(RecordingSource)
    options = {"channels": n_channels, "block": block_rows, "split": split, "ranges": json.dumps(ranges), "filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({} if channels is None else {"chosen": json.dumps(channels)})
    return spark.read.format(RecordingSource.name()).options(**options).load(path)


def recording_batches(spark: SparkSession, path: str, n_channels: int, rate: float, duration: float, first: float = 60.0, every: float = 300.0, length: float = 10.0, channels: list[int] | None = None, split: int = SPLIT) -> DataFrame:
    """Only the batches of recordings of a duration (s) that `signals.batch_starts` tells: file, range (the batch),
    sample_idx and values. What lies between batches isn't read."""
    n = int((duration - length - first) // every) + 1 if duration - length >= first else 0
    ranges = [(int(round((first + k * every) * rate)), int(round((first + k * every + length) * rate))) for k in range(n)]
    return recording_ranges(spark, path, n_channels, ranges, channels=channels, split=split)


def probe_slice(spark: SparkSession, path: str, n_channels: int, rate: float, t0: float, t1: float, channels: list[int] | None = None, split: int = SPLIT) -> DataFrame:
    """Samples of [t0, t1) s of probe recordings; only the splits that hold them are opened."""
    return recording(spark, path, n_channels, first=int(round(t0 * rate)), last=int(round(t1 * rate)), channels=channels, split=split)


def volts(value: Column, offset: Column | float = 0.0, scale: Column | float = 1.0) -> Column:
    """-10 to 10 V from int16, less an offset and times a scale."""
    return (-10 + 20 * (value + 32768) / 65536 - offset) * scale


def config_blocks(spark: SparkSession, path: str, separator: str = "\n\n\n\n") -> DataFrame:
    """Key = value files as file, block (from 0) and a map; blocks are parted by blank lines."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parts = text.select("file", F.posexplode(F.split(F.replace("value", F.lit("\r"), F.lit("")), separator)).alias("block", "body"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.contains("="))
    return parts.filter(F.size(lines) > 0).select("file", "block", F.map_from_entries(F.array_distinct(F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]), F.trim(F.split(x, "=", 2)[1]))))).alias("config"))


def probe_metadata(spark: SparkSession, path: str) -> DataFrame:
    return config_blocks(spark, path, "\\x00").drop("block")


def channel_map(meta: DataFrame, entry: str = "~imroTbl", flat: bool = False) -> DataFrame:
    """(file, channel, bank, electrode, shank) from a string of tuples (channel bank ...); flat: 384 * bank + channel."""
    tuples = meta.select("file", F.explode(F.regexp_extract_all(F.col("config")[entry], F.lit(r"\(([0-9 ]+)\)"), F.lit(1))).alias("t"))
    part = lambda k: F.get(F.split("t", " "), F.lit(k)).cast("int")
    if flat:
        return tuples.select("file", part(0).alias("channel"), part(1).alias("bank"), (part(1) * 384 + part(0)).alias("electrode"), F.lit(0).alias("shank"))
    return tuples.select("file", part(0).alias("channel"), part(2).alias("bank"), part(4).alias("electrode"), part(1).alias("shank"))


def arrays(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Numpy files as file, idx (row-major), at (the index, an entry a dimension) and value; a file is cut to tasks of
    `split` bytes."""
    spark.dataSource.register(ArraySource)
    return spark.read.format(ArraySource.name()).option("split", split).load(path).drop("stored")


def template_waveforms(values: DataFrame) -> DataFrame:
    """(file, template_id, channel_idx, waveform) of arrays of template x sample x channel."""
    place = lambda k: F.col("at")[k]
    each = values.select("file", place(0).alias("template_id"), place(2).alias("channel_idx"), place(1).alias("_k"), "value")
    waveform = F.transform(F.sort_array(F.collect_list(F.struct("_k", "value"))), lambda x: x["value"])
    return each.groupBy("file", "template_id", "channel_idx").agg(waveform.alias("waveform"))


def table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header; NaN is null."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, nanValue="NaN", nullValue="NaN")


def first_with_rows(*tables: DataFrame) -> DataFrame:
    """The first of tables of one schema that has rows (a copy on the fast drive before the slow one's), else the last."""
    for t in tables[:-1]:
        if t.limit(1).count():
            return t
    return tables[-1]


def camera_table(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Motion energy, pupil or saccade CSVs below the first of paths that exists and has rows; empty where none does."""
    found = []
    for p in paths:
        try:
            found.append(table(spark, p, schema))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return first_with_rows(*found) if found else spark.createDataFrame([], schema)


def single_values(spark: SparkSession, path: str) -> DataFrame:
    """Files of one number a line: file, value."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").try_cast("double").alias("value")).filter("value IS NOT NULL")


def sequence_of_stimuli(sequences: DataFrame) -> DataFrame:
    """(session, trial_id, stim) from a sequence array per session; trials count from 1."""
    return sequences.select("session_id", F.posexplode("sequence").alias("_i", "stim")).withColumn("trial_id", F.col("_i") + 1).drop("_i")


def time_range(samples: DataFrame, rate: float, t0: float, t1: float) -> DataFrame:
    """Samples of [t0, t1) s; the predicate reaches the scan of a Parquet copy sorted by sample_idx."""
    return samples.filter((F.col("sample_idx") >= int(round(t0 * rate))) & (F.col("sample_idx") < int(round(t1 * rate))))

"""Filters over stretches, and readers that split files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import anatomy, signals
from trialspark.sources import ranges, readers


def plain_filter(x, b, a):
    y = np.zeros(len(x), np.longdouble)
    for n in range(len(x)):
        y[n] = sum(b[i] * x[n - i] for i in range(len(b)) if n >= i) - sum(a[i] * y[n - i] for i in range(1, len(a)) if n >= i)
    return y


@pytest.mark.parametrize("span", [None, 7.0, 64.0, 250.0, 1e6])
def test_a_filter_over_stretches_is_that_of_the_whole_trace(spark, span):
    b, a = np.ones(1, np.longdouble), np.ones(1, np.longdouble)
    for nb, na in signals.butterworth_sections(3, 50.0, 10_000.0):
        b, a = np.polymul(b, nb), np.polymul(a, na)
    rng, rows, told = np.random.default_rng(2), [], {}
    for k, n in (("a", 700), (None, 130), ("b", 1)):
        x = rng.normal(size=n)
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
        whole = plain_filter(plain_filter(x, b, a)[::-1], b, a)[::-1]
        told |= {(k, i): v for i, v in enumerate(whole)}
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    out = {(r.k, r.i): r.filtered for r in signals.low_pass(df, ["k"], "i", "v", 10_000.0, span=span).collect()}
    assert out.keys() == told.keys() and max(abs(out[k] - told[k]) for k in told) < 1e-9


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    top = tmp_path_factory.mktemp("recording")
    raw = np.random.default_rng(1).integers(-(1 << 15), 1 << 15, (5000, 7)).astype("<i2")
    (top / "a.bin").write_bytes(raw.tobytes() + b"\x01")  # a torn sample at the end
    (top / "sub").mkdir()
    (top / "sub/b.bin").write_bytes(raw[:3].tobytes())
    (top / "_hidden.bin").write_bytes(b"xx")
    return top, raw


@pytest.mark.parametrize("split", [14, 1000, 20_000, 1 << 27])
def test_one_file_read_by_several_tasks_is_the_whole_file(spark, recording, split):
    top, raw = recording
    df = readers.recording(spark, str(top / "a.bin"), 7, 100, split=max(split, 1000))
    rows = df.orderBy("sample_idx").collect()
    assert [r.sample_idx for r in rows] == list(range(5000)) and np.array_equal(np.array([r["values"] for r in rows]), raw)
    assert df.rdd.getNumPartitions() == -(-5000 // max(1, max(split, 1000) // 14))
    both = readers.recording(spark, f"file://{top}", 7, split=20_000).groupBy("file").count().collect()
    assert sorted((r.file.rsplit("/", 1)[1], r["count"]) for r in both) == [("a.bin", 5000), ("b.bin", 3)]


def test_a_range_opens_its_splits_only_and_channels_are_chosen(spark, recording):
    top, raw = recording
    df = readers.probe_slice(spark, str(top / "a.bin"), 7, 1000.0, 1.2, 2.0, [6, 0], split=7000)
    assert df.rdd.getNumPartitions() == 2  # of ten
    rows = df.orderBy("sample_idx").collect()
    assert [r.sample_idx for r in rows] == list(range(1200, 2000))
    assert np.array_equal(np.array([r["values"] for r in rows]), raw[1200:2000][:, [6, 0]])
    assert readers.recording(spark, str(top / "a.bin"), 7, first=4990, last=9999).count() == 10
    assert readers.recording(spark, str(top / "a.bin"), 7, first=6000).count() == 0
    with pytest.raises(FileNotFoundError):
        ranges.listed(str(top / "none"))
    with pytest.raises(ValueError):
        ranges._RecordingReader({"path": str(top), "channels": "7", "chosen": json.dumps([7])})


def test_filters_on_the_sample_narrow_the_splits(spark, recording):
    top, _ = recording
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = readers.time_range(readers.recording(spark, str(top / "a.bin"), 7, split=7000), 1000.0, 1.2, 2.0)
        assert df.count() == 800 and df.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_batches_are_cut_at_the_source(spark, recording):
    top, raw = recording
    df = readers.recording_batches(spark, str(top / "a.bin"), 7, 1000.0, 5.0, first=0.5, every=1.5, length=0.25, channels=[2])
    got = {}
    for r in df.orderBy("sample_idx").collect():
        got.setdefault(r.range, []).append((r.sample_idx, r["values"][0]))
    starts = spark.range(1).select(signals.batch_starts(F.lit(5.0), 0.5, 1.5, 0.25).alias("s")).first().s
    assert starts == [0.5, 2.0, 3.5]
    assert got == {k: [(i, raw[i, 2]) for i in range(int(s * 1000), int(s * 1000) + 250)] for k, s in enumerate(starts)}
    power = signals.recording_band_power(df, 1000.0, 100.0, 300.0, channels=[2]).orderBy("range").collect()
    told = signals.band_power(df.withColumn("v", F.col("values")[0]), ["file", "range"], "sample_idx", "v", 1000.0, 100.0, 300.0).orderBy("range").collect()
    assert [r.channel for r in power] == [2, 2, 2] and [r.power for r in power] == pytest.approx([r.power for r in told])


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_arrays_keep_their_shape(spark, tmp_path, order, split):
    data = np.asarray(np.random.default_rng(3).normal(size=(5, 11, 4)).astype("f4"), order=order)
    np.save(tmp_path / "templates.npy", data)
    df = readers.arrays(spark, str(tmp_path), split)
    back = np.full(data.shape, np.nan)
    for r in df.collect():
        back[tuple(r["at"])] = r.value
        assert r.idx == np.ravel_multi_index(r["at"], data.shape)
    assert np.array_equal(back, data.astype(float))
    facts = {r.template_id: (r.best_channel, r.peak_to_peak) for r in anatomy.template_facts(readers.template_waveforms(df)).collect()}
    p2p = np.ptp(data.astype(float), axis=1)
    assert facts == {k: (int(p2p[k].argmax()), float(p2p[k].max())) for k in range(5)}


def test_arrays_of_one_number_of_none_and_of_objects(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array(3.5))
    np.save(tmp_path / "b.npy", np.empty((0, 2)))
    assert [(r["at"], r.value) for r in readers.arrays(spark, str(tmp_path)).collect()] == [([], 3.5)]
    np.save(tmp_path / "c.npy", np.array(["text"]))
    with pytest.raises(ValueError):
        ranges.array_header(str(tmp_path / "c.npy"))

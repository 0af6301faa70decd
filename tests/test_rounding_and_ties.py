"""Values that are halves in the last place, equals, and sums on a threshold, as SQL takes them."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from trialspark.operators import intervals, stats
from trialspark.plans import event_queries, operator_queries

START = datetime.datetime(2024, 1, 1)


def write_events(d, rows, file="events.parquet", first=0):
    """rows: (hours since the start, user, type, value), in order of event_id."""
    ts = [START + datetime.timedelta(hours=h) for h, *_ in rows]
    columns = {"event_id": range(first, first + len(rows)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [r[1] for r in rows], "event_type": [r[2] for r in rows], "value": [r[3] for r in rows]}
    pq.write_table(pa.table({k: v if isinstance(v, pa.Array) else pa.array(list(v)) for k, v in columns.items()}), f"{d}/{file}")


def test_differences_that_are_halves_are_rounded_as_in_sql(spark, tmp_path):
    rows = []
    for u in range(300):
        low = (u * 7919 % 1000) / 100
        rows += [(0, u, "view", low), (1, u, "signup", round(low + (-1) ** u * ((u * 104_729 % 1_000_000) / 10_000 + 0.00005), 5))]
    write_events(tmp_path, rows)
    mine = sorted(tuple(r) for r in event_queries.QUERIES["f10_heatmap"](spark, str(tmp_path)).select("user_id", "baseline", "response", "delta", "place").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert mine == sorted(con.execute(f"SELECT user_id, baseline, response, delta, place FROM ({event_queries.ORACLES['f10_heatmap']})").fetchall())


def test_of_targets_at_one_place_the_first_in_order_is_nearest(spark):
    points = spark.createDataFrame([(1, 4.0), (2, 5.0), (3, 6.0), (4, 7.5)], "id int, x double")
    targets = spark.createDataFrame([(n, place) for place, names in ((5.0, (3, 2, 9)), (8.0, (7, 4, 8))) for n in names], "name int, y double").repartition(3)
    assert {r.id: r.near_name for r in intervals.nearest(points, targets, [], "x", "y").collect()} == {1: 2, 2: 2, 3: 2, 4: 4}


#: Their mean is 45; added one by one they come to a little more than eleven times that, in two parts to just that.
ON_THRESHOLD = [71.31, 20.41, 65.83, 4.79, 21.48, 40.02, 88.26, 20.92, 75.52, 24.04, 62.42]


def test_a_mean_on_the_threshold_adds_values_in_order(spark, tmp_path):
    rows = [(i, 1, "click", v) for i, v in enumerate(ON_THRESHOLD)]
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    whole.mkdir()
    (parts / "events.parquet").mkdir(parents=True)
    write_events(whole, rows)
    for k in range(0, 11, 6):
        write_events(parts, rows[k : k + 6], f"events.parquet/{k}.parquet", k)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{whole}/events.parquet'")
    told = con.execute(f"SELECT user_id, category, fit FROM ({operator_queries.ORACLES['l1_category']})").fetchall()
    for d in (whole, parts):
        assert [tuple(r) for r in operator_queries.QUERIES["l1_category"](spark, str(d)).collect()] == told == [(1, "V_only", True)]


def test_means_in_order(spark):
    df = spark.createDataFrame([(k, i, v) for k, vs in ((1, ON_THRESHOLD), (2, [None, 3.0, None, 4.0]), (3, [None])) for i, v in enumerate(vs)], "k int, i int, v double").repartition(5)
    total = 0.0
    for v in ON_THRESHOLD:
        total += v
    assert {r.k: r.m for r in stats.mean_in_order(df, ["k"], "i", "v", "m").collect()} == {1: total / 11, 2: 3.5, 3: None}

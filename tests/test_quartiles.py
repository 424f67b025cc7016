"""Quartiles and Tukey fences have the last bit that SQL's quantile_cont gives: values may lie on a fence."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strideframe import functions
from strideframe.operators import chunks, signals
from strideframe.plans.oracles import ORACLES
from strideframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def groups(spark):
    """Few values of four decimals, equal ones, negative ones, nulls, and a group of nulls."""
    rnd = random.Random(5)
    rows = [(0, 0, None), (0, 1, None)]
    for g in range(1, 400):
        kinds = rnd.choice([3, 20, 101])
        sign = rnd.choice([1, 1, -1])
        for i in range(rnd.randrange(1, 22)):
            rows.append((g, i, None if rnd.random() < 0.1 else sign * (rnd.choice([0.0, 0.3]) + rnd.randrange(kinds) / 10000)))
    return rows, spark.createDataFrame(rows, "clip_id long, frame int, y double").repartition(3).cache()


def sql(rows, query):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (clip_id BIGINT, frame INT, y DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return sorted(con.execute(query).fetchall(), key=repr)


def test_quartiles_to_the_last_bit(groups):
    rows, df = groups
    want = sql(rows, "SELECT clip_id, quantile_cont(y, 0.25), quantile_cont(y, 0.75) FROM t GROUP BY clip_id")
    got = signals.quartiles(df, ["y"], ["clip_id"]).select("clip_id", "y_low", "y_high").distinct().collect()
    assert sorted(map(tuple, got), key=repr) == want
    one = lambda p, name: chunks.percentile(chunks.chunked(df, 5), name, F.col("y"), p, ("clip_id",), between=functions.quartile)
    got = one(0.25, "low").join(one(0.75, "high"), "clip_id").collect()
    assert sorted(map(tuple, got), key=repr) == [r for r in want if r[1] is not None]


def test_values_on_a_fence(groups):
    rows, df = groups
    fence = "y BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)"
    want = sql(rows, f"SELECT clip_id, frame, coalesce(y IS NOT NULL AND (n < 5 OR b - a < 1e-6 OR {fence}), false) FROM t JOIN (SELECT clip_id, count(y) AS n, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM t GROUP BY clip_id) USING (clip_id)")
    got = signals.iqr_outlier_flag(df, "y", ["clip_id"]).select("clip_id", "frame", "y_in").collect()
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("name", ["hip_droop", "hip_droop_in_chunks", "hip_baseline"])
def test_clip_with_a_frame_on_the_fence(spark, tmp_path, name):
    """The first frames of a clip have a height that is the lower fence to the last digit."""
    heights = [68, 69, 40, 67, 89, 31, 60, 77]
    ids = [h + 101 * (i if (h + 101 * i) % 37 else i + 100) for i, h in enumerate((heights * 6)[:44])]
    events = [(e, i, 7, "view", 10.0 * i + 1) for i, e in enumerate(ids)]
    df = spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(ORACLES[name])
    want = [dict(zip((c[0] for c in cursor.description), r, strict=True)) for r in cursor.fetchall()]
    assert [r.asDict() for r in got.collect()] == want

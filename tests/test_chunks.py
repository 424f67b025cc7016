"""Chunked signal operators give what the windows over whole clips give, whatever the size of a chunk."""

import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import boxes, chunks, contacts, hip, signals

SCHEMA = "clip_id long, foot string, frame int, x double, y double, on boolean"


@pytest.fixture(scope="module")
def frames(spark):
    """Clips with missing frames, gaps, runs of flags, one frame only, and no value at all."""
    rnd = random.Random(3)
    rows = []
    for clip, n, gap in ((1, 60, 0.3), (2, 1, 0.0), (3, 2, 0.0), (4, 25, 1.0), (5, 40, 0.9), (6, 33, 0.0)):
        for foot in ("left", "right"):
            on = False
            for f in range(n):
                if clip == 6 and 8 <= f < 20 or clip == 1 and rnd.random() < 0.1:
                    continue
                on = on if rnd.random() < 0.7 else not on
                x, y = (None if rnd.random() < gap else rnd.random() for _ in range(2))
                rows.append((clip, foot, f + 3, x, y, on))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.select("clip_id", "foot", "frame", *sorted(set(df.columns) - {"clip_id", "foot", "frame", "_chunk"})).collect()))


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_equal_to_windows(frames, size):
    cut = chunks.chunked(frames, size)
    filled, wanted = chunks.interpolate_gaps(cut, ["x", "y"]), signals.interpolate_gaps(frames, ["x", "y"])
    assert rows(filled) == rows(wanted)
    for window in (1, 2, 5, 6):
        assert rows(chunks.moving_average(cut, ["y"], window)) == rows(signals.moving_average(frames, ["y"], window))
    assert rows(chunks.velocity(cut, "y", 0.5)) == rows(signals.velocity(frames, "y", 0.5))
    for least in (2, 3, 9):
        assert rows(chunks.drop_short_runs(cut, "on", least)) == rows(signals.drop_short_runs(frames, "on", least))
    assert rows(chunks.rising_edges(cut, "on")) == rows(signals.rising_edges(frames, "on"))


@pytest.mark.parametrize("size", [2, 10])
def test_one_after_the_other(frames, size):
    cut = chunks.velocity(chunks.moving_average(chunks.interpolate_gaps(chunks.chunked(frames, size), ["x", "y"]), ["x", "y"]), "y", 0.04)
    whole = signals.velocity(signals.moving_average(signals.interpolate_gaps(frames, ["x", "y"]), ["x", "y"]), "y", 0.04)
    assert rows(cut) == rows(whole)


def test_boxes_and_counts(frames):
    own = frames.where("foot = 'left'").withColumn("box", F.when(F.col("frame") % 7 == 4, F.struct(*[F.col("frame").alias(c) for c in ("x1", "y1", "x2", "y2")])))
    got = chunks.carry_forward_box(chunks.chunked(own, 5))
    assert rows(got) == rows(boxes.carry_forward_box(own))
    seen = chunks.numbered(chunks.chunked(frames, 5), "seen", F.col("on"))
    counts = {}
    for r in sorted(seen.collect(), key=lambda r: r["frame"]):
        key = (r["clip_id"], r["foot"])
        counts[key] = counts.get(key, 0) + r["on"]
        assert r["seen"] == counts[key]


@pytest.mark.parametrize("bins,rounds", [(2, 1), (3, 2), (2048, 2)])
def test_percentiles_without_a_groups_values(frames, bins, rounds):
    more = frames.withColumn("t", F.when(F.col("frame") % 3 == 0, 7.25).otherwise(F.floor(F.col("y") * 4)))
    for col, p in (("y", 0.3), ("y", 0.8), ("t", 0.5), ("y", 1.0), ("t", 0.0))[: 5 if rounds == 1 else 3]:
        got = chunks.percentile(more, "q", F.col(col), p, bins=bins, rounds=rounds)
        want = more.groupBy("clip_id", "foot").agg(F.percentile(col, p).alias("q")).where("q IS NOT NULL")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture(scope="module")
def keep(spark, tmp_path_factory):
    """Stores what lies between steps; its plan ends there, as plans that read their input often would grow fast."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("kept")))
    return lambda df: df.checkpoint()


def test_contacts_of_long_clips(frames, keep):
    got = chunks.find_contacts(frames.drop("on"), 30.0, keep, min_len=1, size=9).cache()
    want = contacts.find_contacts(frames.drop("on"), 30.0, min_len=1)
    same = ["clip_id", "foot", "frame", "x", "y", "v", "contact", "step", "t_s", "x_raw", "y_raw"]
    key = lambda r: (r["clip_id"], r["foot"], r["frame"])
    assert sorted(got.select(same).collect(), key=key) == sorted(want.select(same).collect(), key=key)
    assert got.where("step").count() > 0


def test_one_clip_becomes_many_tasks(spark):
    """No window over a whole clip is left: rows are dealt by clip and chunk, and only borders by clip."""
    long = spark.range(4000).select(F.lit(1).cast("long").alias("clip_id"), F.lit("left").alias("foot"), F.col("id").cast("int").alias("frame"), F.rand(1).alias("y"))
    out = chunks.interpolate_gaps(chunks.chunked(long, 100), ["y"])
    spread = out.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert spread == int(spark.conf.get("spark.sql.shuffle.partitions")) or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "_chunk" not in line.split("windowspecdefinition(")[1]:
            raise AssertionError(line)
    assert out.count() == 4000


@pytest.fixture(scope="module")
def run_ups(spark):
    """Clips with frames that have no pose, few valid ones, equal droops, outliers, and none at all."""
    rnd = random.Random(8)
    rows = []
    for clip, n in ((1, 90), (2, 2), (3, 41), (4, 12), (5, 70), (6, 1)):
        for f in range(n):
            hip_y = None if rnd.random() < 0.2 or clip == 4 and f > 3 else (rnd.randrange(3) / 4 if clip == 5 else rnd.random() * (9 if rnd.random() < 0.05 else 1))
            rows.append((clip, f, hip_y, rnd.choice([0.0, None]) if rnd.random() < 0.1 else (0.5 if clip == 5 else 0.4 + rnd.random() / 5)))
    return spark.createDataFrame(rows, "clip_id long, frame int, hip_y double, body_h double").repartition(3).cache()


@pytest.mark.parametrize("size,bounded", [(1, False), (7, True), (1000, True)])
def test_droop_of_long_clips(spark, run_ups, keep, size, bounded):
    bounds = spark.createDataFrame([(1, 4, 80), (3, None, 30), (5, 2, None), (9, 1, 2)], "clip_id long, first_step int, last_step int") if bounded else None
    clips = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, 6, 7)], "clip_id long") if bounded else None
    frames, out = chunks.hip_droop(run_ups, keep, bounds, clips, size)
    frames = keep(frames)
    want = {r["clip_id"]: r for r in hip.hip_droop(run_ups, bounds, clips).collect()}
    worst = {}
    for r in frames.where("worst").collect():
        worst.setdefault(r["clip_id"], []).append(r["frame"])
    got = {r["clip_id"]: r for r in out.collect()}
    assert got.keys() == want.keys() and frames.count() == run_ups.count()
    for clip, r in want.items():
        assert sorted(worst.get(clip, [])) == r["worst_frames"]
        for c in ("n_valid", "start_idx", "end_idx"):
            assert got[clip][c] == r[c]
        for c in ("hip_droop_pct", "hip_droop_trend_pct"):
            assert got[clip][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9))
    assert any(r["hip_droop_pct"] is None for r in want.values()) and len(worst[5]) >= 1


def test_droop_of_no_frames(run_ups, keep):
    frames, out = chunks.hip_droop(run_ups.limit(0), keep, size=5)
    assert frames.count() == 0 and out.count() == 0


@pytest.mark.parametrize("bins,rounds", [(2, 1), (2048, 2)])
def test_values_of_a_rank(frames, bins, rounds):
    got = {tuple(r)[:2]: r["v"] for r in chunks.ranked_value(chunks.chunked(frames, 5), "v", F.col("y"), F.col("_n") - 2, bins=bins, rounds=rounds).collect()}
    values = {}
    for r in frames.where("y IS NOT NULL").collect():
        values.setdefault((r["clip_id"], r["foot"]), []).append(r["y"])
    assert got == {k: sorted(v)[-2] for k, v in values.items() if len(v) > 1}

"""Hand-made rows for the corner cases of the motion operators, and a numpy restatement of the signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import stem, suffix
from strideframe.operators import bend, boxes, contacts, hip, labels, landmarks, sampling, signals
from strideframe.sources import clip_catalog, normalize_clips

DETS = "clip_id long, frame int, pass string, det_idx int, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def det(frame, kind, idx, x1, y1, x2, y2, cls=0):
    return (1, frame, kind, idx, cls, 0.9, float(x1), float(y1), float(x2), float(y2))


def test_largest_box_ties_clamping_and_fallback(spark):
    rows = [
        det(0, "original", 0, 0, 0, 10, 10), det(0, "original", 1, 50, 50, 60, 60),  # tie: the first
        det(1, "original", 0, 5, 5, 5, 50),  # no area
        det(1, "boosted", 0, 1, 1, 9, 9),
        det(2, "original", 0, -900, 0, -500, 90), det(2, "original", 1, 0, 0, 10, 10),  # the largest lies outside
        det(3, "original", 0, 0, 0, 50, 50, cls=2),
        det(4, "original", 0, -5.5, -5, 20.9, 300),
    ]
    got = {r["frame"]: r["box"] for r in boxes.detect_with_fallback(spark.createDataFrame(rows, DETS), 100, 100).collect()}
    assert tuple(got[0]) == (0, 0, 10, 10)
    assert tuple(got[1]) == (1, 1, 9, 9)
    assert got[2] is None and got[3] is None
    assert tuple(got[4]) == (0, 0, 20, 100)


def test_carry_forward_and_roi(spark):
    frames = spark.createDataFrame([(1, 0, None), (1, 1, (10, 10, 20, 30)), (1, 2, None)], f"clip_id long, frame int, box {boxes.BOX}")
    got = [r["box"] for r in boxes.carry_forward_box(frames).orderBy("frame").collect()]
    assert got[0] is None and tuple(got[1]) == tuple(got[2]) == (10, 10, 20, 30)
    roi = [r["roi"] for r in boxes.expand_roi(frames, 100, 100).orderBy("frame").collect()]
    assert roi[0] is None and tuple(roi[1]) == (8, 7, 21, 33)


def numpy_signal(y, window=5):
    y, at = np.array(y, float), np.arange(len(y))
    ok = ~np.isnan(y)
    if ok.any():
        y = np.interp(at, at[ok], y[ok])
    padded = np.pad(y, (window // 2, window - 1 - window // 2), mode="edge")
    return y, np.convolve(padded, np.ones(window) / window, "valid")


@pytest.mark.parametrize("n", [1, 2, 4, 30])
def test_signals_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    clips = {c: np.where(rng.random(n) < 0.3, np.nan, rng.random(n)) for c in range(4)}
    clips[4] = np.full(n, np.nan)
    rows = [(c, "left", i, None if np.isnan(v) else float(v)) for c, y in clips.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "clip_id long, foot string, frame int, y double")
    filled = signals.interpolate_gaps(df, ["y"])
    smooth = signals.velocity(signals.moving_average(filled, ["y"]), "y", 0.5)
    got = smooth.orderBy("clip_id", "frame").collect()
    for c, y in clips.items():
        own = [r for r in got if r["clip_id"] == c]
        if np.isnan(y).all():
            assert all(r["y"] is None for r in own)
            continue
        _, mean = numpy_signal(y)
        np.testing.assert_allclose([r["y"] for r in own], mean)
        if n == 1:
            assert own[0]["v"] is None
        else:
            step = np.diff(mean) / 0.5
            np.testing.assert_allclose([r["v"] for r in own], np.concatenate((step[:1], step)), atol=1e-12)


def test_runs_and_edges(spark):
    flags = [1, 1, 0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, "left", i, bool(f)) for i, f in enumerate(flags)], "clip_id long, foot string, frame int, c boolean")
    out = signals.rising_edges(signals.drop_short_runs(df, "c"), "c").orderBy("frame").collect()
    assert [r["c"] for r in out] == [False] * 3 + [True] * 3 + [False] * 2
    assert [r["frame"] for r in out if r["step"]] == [3]
    first = spark.createDataFrame([(1, "left", i, True) for i in range(4)], "clip_id long, foot string, frame int, c boolean")
    assert not any(r["step"] for r in signals.rising_edges(first, "c").collect())


def test_summary_without_steps_and_missing_feet(spark):
    feet = [(1, "left", i, 0.5, 0.5 + 0.01 * i) for i in range(4)] + [(1, "right", i, None, None) for i in range(4)] + [(2, "left", 0, None, None)]
    frames = contacts.find_contacts(spark.createDataFrame(feet, "clip_id long, foot string, frame int, x double, y double"), 30.0)
    got = {(r["clip_id"], r["foot"]): r for r in contacts.contact_summary(frames).collect()}
    assert set(got) == {(1, "left"), (1, "right")}
    assert got[1, "right"]["steps"] == 0 and got[1, "right"]["frequency"] == 0 and got[1, "right"]["mean_interval_s"] is None


def test_range_is_clamped_before_it_is_ordered(spark):
    ranges = spark.createDataFrame([(1, 50, 60), (2, 9, 3), (3, None, 3)], "clip_id long, start_frame int, end_frame int")
    clips = spark.createDataFrame([(i, 20) for i in (1, 2, 3)], "clip_id long, total_frames int")
    got = {r["clip_id"]: tuple(r)[1:] for r in contacts.normalize_range(ranges, clips).collect()}
    assert got == {1: (19, 50, 32), 2: (3, 9, 7)}


def hip_rows(values, clip=1):
    return [(clip, i, None if v is None else float(v), 0.5) for i, v in enumerate(values)]


def test_hip_droop_states(spark):
    rows = hip_rows([0.5, 0.5, 0.5, 0.6]) + hip_rows([0.5, 0.5, None], 2) + hip_rows([None], 3)
    got = {r["clip_id"]: r for r in hip.hip_droop(spark.createDataFrame(rows, "clip_id long, frame int, hip_y double, body_h double")).collect()}
    assert got[1]["hip_droop_pct"] == pytest.approx(20.0) and got[1]["worst_frames"] == [3]
    assert got[2]["hip_droop_pct"] is None and got[2]["n_valid"] == 2
    assert got[3]["n_valid"] == 0 and got[3]["worst_frames"] == [] and got[3]["end_idx"] == 1


@pytest.mark.parametrize("n,worst", [(20, 1), (60, 2), (100, 2)])
def test_worst_count_is_half_even(spark, n, worst):
    rows = hip_rows([0.5 + i / 1000 for i in range(n)])
    got = hip.hip_droop(spark.createDataFrame(rows, "clip_id long, frame int, hip_y double, body_h double")).first()
    assert len(got["worst_frames"]) == worst


def test_baseline_fence_needs_five(spark):
    values = [0.5, 0.5001, 0.5002, 0.5003, 0.9] + [0.5] * 20
    rows = spark.createDataFrame(hip_rows(values), "clip_id long, frame int, hip_y double, body_h double")
    assert hip.hip_baseline(rows).first()["base_hip"] == pytest.approx(np.mean(values[:4]), abs=1e-9)
    few = spark.createDataFrame(hip_rows(values[:20]), "clip_id long, frame int, hip_y double, body_h double")
    assert hip.hip_baseline(few).first()["base_hip"] == pytest.approx(np.mean(values[:4]))


def test_step_marks(spark):
    marks = [(1, 0, "s", 10), (1, 1, "s", 30), (1, 2, "s", 20), (1, 3, "s", 20), (1, 4, "e", 50), (1, 5, "s", 99), (2, 0, "s", 1), (2, 1, "abort", 2), (3, 0, "e", 7)]
    got = {r["clip_id"]: r for r in labels.step_marks_reduce(spark.createDataFrame(marks, "clip_id long, seq int, action string, frame int")).collect()}
    assert set(got) == {1, 3}
    assert got[1]["steps"] == [10, 20, 30] and (got[1]["first_step"], got[1]["last_step"]) == (10, 20)
    assert got[3]["steps"] == [] and got[3]["last_step"] == 7 and got[3]["first_step"] is None


def test_range_marks(spark):
    marks = [(1, 0, "confirm", 0), (1, 1, "start", 9), (1, 2, "end", 5), (1, 3, "confirm", 0), (1, 4, "start", 100), (2, 0, "start", 1), (2, 1, "cancel", 0), (2, 2, "end", 3), (2, 3, "confirm", 0)]
    got = {r["clip_id"]: tuple(r)[1:] for r in labels.range_marks_reduce(spark.createDataFrame(marks, "clip_id long, seq int, action string, frame int")).collect()}
    assert got == {1: (5, 9), 2: (None, None)}


def test_stride_and_highlight(spark):
    steps = spark.createDataFrame([(1, [0, 30, 90]), (2, [5]), (3, [0, 10])], "clip_id long, steps array<int>")
    clips = spark.createDataFrame([(1, 30.0, 91), (2, 75.0, 7), (3, 0.0, 5)], "clip_id long, fps double, total_frames int")
    got = {r["clip_id"]: r for r in labels.stride_metrics(steps, clips).collect()}
    assert got[1]["mean_interval_s"] == pytest.approx(1.5) and got[1]["cadence"] == pytest.approx(40)
    assert got[2]["stride_rate"] is None and got[3]["stride_rate"] is None
    near = {}
    for r in labels.step_highlight(steps, clips).collect():
        near.setdefault(r["clip_id"], []).append(r["frame"])
    assert sorted(near[1]) == [0, 1, 29, 30, 31, 89, 90] and sorted(near[2]) == [3, 4, 5, 6] and sorted(near[3]) == [0, 1]


def test_bend(spark):
    marks = [(1, 1, 0, 0, 0), (1, 1, 1, 0, 40), (1, 2, 0, 100, 60), (1, 2, 1, 100, 0), (1, 3, 0, 100, 50), (2, 1, 0, 0, 0)]
    df = spark.createDataFrame(marks, "clip_id long, step int, click int, x int, y int")
    got = bend.pole_bend(df).collect()
    assert [r["clip_id"] for r in got] == [1]
    assert got[0]["l_full"] == 100 and got[0]["l_bent"] == 50 and got[0]["bend_pct"] == 50
    level = [(1, 1, 0, 0, 0), (1, 1, 1, 0, 40), (1, 2, 0, 0, 5), (1, 2, 1, 60, 5), (1, 3, 0, 0, 0)]
    tip = bend.project_tip(spark.createDataFrame(level, "clip_id long, step int, click int, x int, y int")).first()
    assert (tip["top"]["x"], tip["tip_x"]) == (60, -40.0)
    close = [(1, 1, 0, 0, 0), (1, 1, 1, 0, 40), (1, 2, 0, 7, 5), (1, 2, 1, 7, 5), (1, 3, 0, 0, 0)]
    assert bend.pole_bend(spark.createDataFrame(close, "clip_id long, step int, click int, x int, y int")).first()["bend_pct"] is None


def test_sampling(spark):
    clips = spark.createDataFrame([(1, "a/b c.x.MP4", 25.0, 30), (2, "a/.mp4", 25.0, 9), (3, "q.txt", 1.0, 1), (4, "z.avi", None, 3), (5, None, 1.0, 1)], "clip_id long, path string, fps double, total_frames int")
    videos = normalize_clips(clip_catalog(clips))
    assert sorted(r["clip_id"] for r in videos.collect()) == [1, 4]
    plan = sampling.frame_sample_plan(videos, fps=2.0)
    assert sorted((r["clip_id"], r["frame"]) for r in plan.collect()) == [(1, 0), (1, 12), (1, 24), (4, 0)]
    assert sampling.frame_sample_plan(videos, start=5.0).count() == 0
    named = sampling.sample_output_path(plan.where("clip_id = 1 AND frame = 12"), "out", root="a").first()
    assert named["output"] == "out/b c.x/b_c.x_f000012.jpg"
    with pytest.raises(Exception, match="outside root"):
        sampling.sample_output_path(plan, "out", root="b").collect()
    assert spark.range(1).select(stem(F.lit("x/.hid")), suffix(F.lit("x/a.B"))).first()[:] == (".hid", ".b")


def test_landmark_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, -0.0005, 1.0, 0.5), (1, 0, 1, 0.5, None, 0.6)], "clip_id long, frame int, lm_id int, x double, y double, visibility double")
    got = landmarks.norm_to_px(df, 1000, 100).orderBy("lm_id").collect()
    assert (got[0]["px"], got[0]["py"]) == (0, 100) and got[1]["px"] is None
    assert landmarks.gate_visibility(df).orderBy("lm_id").first()["x"] is None


def test_contacts_count_frames_without_landmarks(spark):
    from strideframe.plans import jobs

    dets = spark.createDataFrame([det(i, "original", 0, 0, 0, 100, 100) for i in range(12) if i != 6], DETS)
    points = [(1, i, lm, 0.5, 0.1 * i, 0.9) for i in range(12) if i not in (4, 5, 6, 11) for lm in (landmarks.L_FOOT, landmarks.R_FOOT)]
    points = spark.createDataFrame(points, "clip_id long, frame int, lm_id int, x double, y double, visibility double")
    ranges = spark.createDataFrame([(1, 1, 11, 11)], "clip_id long, start_frame int, end_frame int, n_frames int")
    frames, summary = jobs.ground_contacts(dets, points, ranges, 100, 100, 10.0)
    left = frames.where("foot = 'left'").orderBy("frame").collect()
    assert [r["frame"] for r in left] == list(range(1, 12)) and [r["y_raw"] is None for r in left] == [i in (4, 5, 6, 11) for i in range(1, 12)]
    np.testing.assert_allclose([r["v"] for r in left[3:7]], 1.0)
    got = {r["foot"]: r for r in summary.collect()}
    assert [(got[f]["n_frames"], round(got[f]["total_s"], 9)) for f in ("left", "right")] == [(11, 1.0)] * 2


def test_jobs_deal_detections_and_landmarks_once(spark, tmp_path):
    """With co-partitioned joins, the whole job exchanges each large table once, and nothing else but clips and ranges."""
    from strideframe.plans import jobs, queries
    from strideframe.sources import list_files, write_by_clip

    data, held = "/root/testdata/sf0.001", {}
    for name in ("mixed_clips", "mixed_detections", "landmarks"):
        df = queries.derived(spark, data, name)
        write_by_clip(df, f"{tmp_path}/{name}", 2)
        held[name] = spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")
        assert held[name].count() == df.count()
    files = list_files(spark, str(tmp_path)).where("path LIKE '%.parquet'")
    assert files.count() >= 3 and files.where("length <= 0").count() == 0
    session = spark.newSession()
    jobs.co_partitioned(session)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    clips, detections, points = (session.read.parquet(f"{tmp_path}/{n}") for n in held)
    ranges = clips.selectExpr("clip_id", "0 AS start_frame", "total_frames - 1 AS end_frame", "total_frames AS n_frames").where("n_frames > 0")
    frames, _ = jobs.ground_contacts(detections, points, ranges, "width", "height", "fps", clips)
    plan = frames._jdf.queryExecution().executedPlan().toString()
    large = [x for x in plan.split("\n") if "REPARTITION_BY_COL" in x]
    assert len(large) == 2 and plan.count("Exchange hashpartitioning") <= 7


def test_sizes_and_rates_of_each_clip(spark):
    """One clip is wider and faster than the other; both in one table."""
    from strideframe.plans import jobs

    dets = spark.createDataFrame([(c, *det(i, "original", 0, 0, 0, 400, 400)[1:]) for c in (1, 2) for i in range(4)], DETS)
    clips = spark.createDataFrame([(1, 10.0, 100, 100), (2, 20.0, 400, 200), (3, 0.0, 9, 9)], "clip_id long, fps double, width int, height int")
    got = boxes.detect_with_fallback(dets.join(clips, "clip_id"), "width", "height").where("frame = 0")
    assert {r["clip_id"]: tuple(r["box"]) for r in got.collect()} == {1: (0, 0, 100, 100), 2: (0, 0, 400, 200)}
    points = [(c, i, lm, 0.5, 0.1 * i, 0.9) for c in (1, 2) for i in range(4) for lm in (landmarks.L_FOOT, landmarks.R_FOOT)]
    points = spark.createDataFrame(points, "clip_id long, frame int, lm_id int, x double, y double, visibility double")
    ranges = spark.createDataFrame([(1, 0, 3, 4), (2, 0, 3, 9)], "clip_id long, start_frame int, end_frame int, n_frames int")
    frames, summary = jobs.ground_contacts(dets, points, ranges, "width", "height", "fps", clips)
    last = {r["clip_id"]: (round(r["t_s"], 6), round(r["v"], 3)) for r in frames.where("foot = 'left' AND frame = 2").collect()}
    assert last == {1: (0.2, 0.6), 2: (0.1, 1.2)}  # means of five, ends repeated: 0.12, then 0.18
    assert {(r["clip_id"], r["n_frames"]) for r in summary.collect()} == {(1, 4), (2, 9)}
    with pytest.raises(ValueError, match="width"):
        jobs.ground_contacts(dets, points, ranges, "width", 100, 10.0)


def test_states_without_frames_marks_or_last_step(spark):
    clips = spark.createDataFrame([(1, 30.0, 9), (2, 30.0, 0)], "clip_id long, fps double, total_frames int")
    series = spark.createDataFrame(hip_rows([0.5, 0.5, 0.5, 0.6]), "clip_id long, frame int, hip_y double, body_h double")
    got = {r["clip_id"]: r for r in hip.hip_droop(series, clips=clips).collect()}
    assert (got[2]["n_valid"], got[2]["worst_frames"], got[2]["start_idx"], got[2]["end_idx"]) == (0, [], 0, 0)
    marks = [(1, 0, "s", 2), (1, 1, "e", 3), (1, 2, "abort", 3), (2, 0, "s", 1), (2, 1, "abort", 2), (2, 2, "e", 3)]
    steps = labels.step_marks_reduce(spark.createDataFrame(marks, "clip_id long, seq int, action string, frame int"))
    assert [r["clip_id"] for r in steps.collect()] == [1]
    points = hip.analysis_window(series.withColumns({"x": F.lit(0.5), "y": F.col("hip_y")}), steps)
    worst = spark.createDataFrame([(1, 2)], "clip_id long, frame int")
    assert [(r["frame"], r["worst"]) for r in hip.hip_trail(points, worst, 100, 100).collect()] == [(2, True)]
    assert hip.hip_trail(hip.analysis_window(series.withColumns({"x": F.lit(0.5), "y": F.col("hip_y")})), worst, 100, 100).count() == 0


def test_boxes_take_one_exchange_and_no_sort(spark):
    rows = [det(f, kind, i, x, 0, x + 10 + i % 2, 10) for f in range(5) for kind in ("original", "boosted") for i, x in enumerate((0, 3, -40))]
    dets = spark.createDataFrame(rows, DETS)
    for found in (boxes.largest_person_box(dets, 100, 100), boxes.detect_with_fallback(dets, 100, 100)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and plan.count("Exchange") == 1
    dealt = boxes.detect_with_fallback(dets.repartition("clip_id"), 100, 100, dealt=True)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r["box"]) for r in dealt.collect()} == {(3, 0, 14, 10)}


def test_only_frames_in_range_are_exchanged(spark):
    from strideframe.plans import jobs

    rows = spark.createDataFrame([(c, f) for c in range(6) for f in range(50)], "clip_id long, frame int")
    ranges = spark.createDataFrame([(1, 10, 12), (2, None, 3), (3, 48, None), (9, 0, 9)], "clip_id long, a int, b int")
    want = [(1, 10), (1, 11), (1, 12), (2, 0), (2, 1), (2, 2), (2, 3), (3, 48), (3, 49)]
    for most in (0, jobs.RANGES_SENT):
        known = jobs.sent(ranges) if most else ranges
        got = jobs.pruned(rows, known, "a", "b")
        assert sorted(map(tuple, got.collect())) == want
    plan = got.repartition("clip_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # the join lies below
    left = jobs.pruned(rows, ranges, None, "b", "left")
    assert left.count() == 13 + 4 + 4 * 50  # clips 1 and 2 up to their last frame, the others whole


def test_jobs_compile_and_are_right_over_bucketed_tables(spark, tmp_path):
    """The whole approach within the limits of generated code; bucketed detections and landmarks aren't exchanged."""
    from strideframe.plans import jobs, queries
    from strideframe.sources import write_bucketed

    data = "/root/testdata/sf0.001"
    names = {n: queries.derived(spark, data, n) for n in ("mixed_detections", "landmarks", "step_marks", "mixed_clips")}
    changed = {"spark.sql.codegen.fallback": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    want = sorted(map(tuple, jobs.approach(*names.values(), "width", "height").collect()))
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        tables = [write_bucketed(names[n], f"bucketed_{n}", f"{tmp_path}/{n}", 4) for n in ("mixed_detections", "landmarks")]
        out = jobs.approach(*tables, names["step_marks"], names["mixed_clips"], "width", "height", dealt=True)
        assert sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [len(x) - len(x.lstrip(" :+-*()0123456789|")) for x in plan]
        for i, line in enumerate(plan):
            if "Bucketed: true" in line:
                above, top = [], depth[i]
                for j in range(i - 1, -1, -1):
                    if depth[j] < top:
                        above, top = [plan[j], *above], depth[j]
                # one exchange may stand above them all: the frames' metrics of a clip, already summed
                first = next((k for k, x in enumerate(reversed(above)) if "Exchange" in x), len(above))
                assert any("Window" in x for x in list(reversed(above))[:first])
        assert sum("Bucketed: true" in x for x in plan) >= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for n in ("mixed_detections", "landmarks"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{n}")

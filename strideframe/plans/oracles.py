"""DuckDB SQL that gives each registered query's rows on its own."""

from __future__ import annotations

from ..sources.fixtures import duck_cte

W, H = 1920, 1080


def _with(final: str, *parts: str, base: tuple[str, ...] = ()) -> str:
    ctes = [duck_cte(*base)] if base else []
    return "WITH " + ",\n".join([*ctes, *parts]) + "\n" + final


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


# clips ---------------------------------------------------------------------------------------
_VIDEOS = "videos AS (SELECT * FROM clips WHERE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.mp4', '.mov', '.mkv', '.avi', '.m4v'))"
_NORMAL = "SELECT * REPLACE (CASE WHEN fps > 0 THEN fps ELSE 30.0::DOUBLE END AS fps, coalesce(total_frames, 0) AS total_frames) FROM"
_PLAN = [
    _VIDEOS,
    f"normal AS ({_NORMAL} videos)",
    "bounds AS (SELECT *, greatest(0, trunc(0.5::DOUBLE * fps)::INT) AS a, least(total_frames, trunc(60.0::DOUBLE * fps)::INT) AS b, greatest(1, round_even(fps / 2.0::DOUBLE, 0)::INT) AS stride FROM normal)",
    "plan AS (SELECT clip_id, path, stride, unnest(range(a, b, stride))::INT AS frame FROM bounds WHERE b > a)",
]
_STEM = "regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', ''), '[^A-Za-z0-9_.-]+', '_', 'g')"

# boxes ---------------------------------------------------------------------------------------
_AREA = "greatest(0.0::DOUBLE, x2 - x1) * greatest(0.0::DOUBLE, y2 - y1)"


def _clamp(x1: str, y1: str, x2: str, y2: str) -> str:
    c = lambda v, top: f"trunc(least(greatest({v}, 0), {top}))::INT"
    return f"{c(x1, W - 1)} AS x1, {c(y1, H - 1)} AS y1, {c(x2, W)} AS x2, {c(y2, H)} AS y2"


def _best(name: str, keys: str) -> str:
    return f"""{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_AREA} DESC, det_idx) AS rk FROM detections WHERE cls = 0 AND {_AREA} > 0),
{name}_clamped AS (SELECT {keys}, {_clamp('x1', 'y1', 'x2', 'y2')} FROM {name}_rank WHERE rk = 1),
{name} AS (SELECT * FROM {name}_clamped WHERE x2 > x1 AND y2 > y1)"""


_FOUND = [
    _best("best", "clip_id, frame, pass"),
    "found AS (SELECT f.clip_id, f.frame, " + ", ".join(f"CASE WHEN a.x1 IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM (SELECT DISTINCT clip_id, frame FROM detections) f LEFT JOIN best a ON a.clip_id = f.clip_id AND a.frame = f.frame AND a.pass = 'original' LEFT JOIN best b ON b.clip_id = f.clip_id AND b.frame = f.frame AND b.pass = 'boosted')",
]
_ROI = [
    *_FOUND,
    f"""grown AS (SELECT clip_id, frame, greatest(0, trunc(x1 + (x2 - x1) / 2 - trunc((x2 - x1) * 1.3::DOUBLE) / 2)::INT) AS x1, greatest(0, trunc(y1 + (y2 - y1) / 2 - trunc((y2 - y1) * 1.3::DOUBLE) / 2)::INT) AS y1,
least({W}, trunc(x1 + (x2 - x1) / 2 + trunc((x2 - x1) * 1.3::DOUBLE) / 2)::INT) AS x2, least({H}, trunc(y1 + (y2 - y1) / 2 + trunc((y2 - y1) * 1.3::DOUBLE) / 2)::INT) AS y2 FROM found WHERE x1 IS NOT NULL)""",
    "roi AS (SELECT f.clip_id, f.frame, g.x1, g.y1, g.x2, g.y2 FROM found f LEFT JOIN (SELECT * FROM grown WHERE x2 > x1 AND y2 > y1) g USING (clip_id, frame))",
]

# landmarks -----------------------------------------------------------------------------------
_PLACED = f"placed AS (SELECT l.clip_id, l.frame, l.lm_id, l.visibility, (r.x1 + l.x * (r.x2 - r.x1)) / {W}.0::DOUBLE AS x, (r.y1 + l.y * (r.y2 - r.y1)) / {H}.0::DOUBLE AS y FROM landmarks l JOIN rois r USING (clip_id, frame) WHERE r.has)"
_PX = f"px AS (SELECT clip_id, frame, lm_id, visibility, trunc(x * {W})::INT AS px, trunc(y * {H})::INT AS py FROM landmarks)"
_IN = f"px >= 0 AND px < {W} AND py >= 0 AND py < {H}"
_CLAMPED = f"clamped AS (SELECT clip_id, frame, lm_id, CASE WHEN visibility > 0.5 THEN trunc(least(greatest(x, 0), 1) * {W})::INT END AS cx, CASE WHEN visibility > 0.5 THEN trunc(least(greatest(y, 0), 1) * {H})::INT END AS cy FROM landmarks)"
_LMS = ("landmarks", "rois")
_LEGS = " UNION ALL ".join(f"SELECT a.clip_id, a.frame, '{n}' AS edge, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2 FROM clamped a JOIN clamped b USING (clip_id, frame) WHERE a.lm_id = {i} AND b.lm_id = {j} AND a.cx IS NOT NULL AND b.cx IS NOT NULL" for n, i, j in (("l_hip-r_hip", 23, 24), ("l_hip-l_knee", 23, 25), ("l_knee-l_ankle", 25, 27), ("r_hip-r_knee", 24, 26), ("r_knee-r_ankle", 26, 28)))

# gait ----------------------------------------------------------------------------------------
_K, _O = "PARTITION BY clip_id, foot", "PARTITION BY clip_id, foot ORDER BY frame"


def _fill(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}0 IS NULL THEN {c}1 WHEN {c}1 IS NULL THEN {c}0 ELSE ({c}1 - {c}0) / (q{c} - p{c}) * (p - p{c}) + {c}0 END AS {c}"


def _mean(c: str) -> str:
    lo, hi = f"first_value({c}) OVER f", f"last_value({c}) OVER f"
    return f"(coalesce(lag({c}, 2) OVER w, {lo}) + coalesce(lag({c}, 1) OVER w, {lo}) + {c} + coalesce(lead({c}, 1) OVER w, {hi}) + coalesce(lead({c}, 2) OVER w, {hi})) / 5.0::DOUBLE AS {c}"


_RATE = "(SELECT fps FROM mixed_clips m WHERE m.clip_id = {}.clip_id)"


def _gait(fps: str = "30.0::DOUBLE", smooth_fps: str = "30.0::DOUBLE") -> list[str]:
    """From ``gait`` to steps; a rate that isn't positive gives no speed and no time."""
    return [
        f"gait_p AS (SELECT *, row_number() OVER ({_O}) AS p FROM gait)",
        "sides AS (SELECT *, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER a AS {c}0, last_value(CASE WHEN {c} IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p{c}, first_value({c} IGNORE NULLS) OVER b AS {c}1, first_value(CASE WHEN {c} IS NOT NULL THEN p END IGNORE NULLS) OVER b AS q{c}" for c in "xy") + f" FROM gait_p WINDOW a AS ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({_O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
        f"filled AS (SELECT clip_id, foot, frame, {_fill('x')}, {_fill('y')} FROM sides)",
        f"smooth AS (SELECT clip_id, foot, frame, {_mean('x')}, {_mean('y')} FROM filled WINDOW w AS ({_O}), f AS ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        f"moving AS (SELECT *, coalesce(y - lag(y) OVER w, lead(y) OVER w - y) / (1.0::DOUBLE / {smooth_fps}) AS v FROM smooth WINDOW w AS ({_O}))",
        "thr AS (SELECT clip_id, foot, quantile_cont(y, 0.8) AS y_thr, quantile_cont(abs(v), 0.3) AS v_thr FROM moving GROUP BY clip_id, foot)",
        "flagged AS (SELECT clip_id, foot, frame, x, y, coalesce(y >= y_thr AND abs(v) <= v_thr, false) AS c FROM moving JOIN thr USING (clip_id, foot))",
        f"islands AS (SELECT *, row_number() OVER ({_O}) - row_number() OVER (PARTITION BY clip_id, foot, c ORDER BY frame) AS g FROM flagged)",
        "clean AS (SELECT clip_id, foot, frame, x, y, c AND count(*) OVER (PARTITION BY clip_id, foot, c, g) >= 3 AS contact FROM islands)",
        f"stepped AS (SELECT *, coalesce(contact AND NOT lag(contact) OVER ({_O}), false) AS step, frame / {fps} AS t_s FROM clean)",
    ]


_GAIT = _gait()

# hip -----------------------------------------------------------------------------------------


def _hip(source: str, bounded: str = "") -> list[str]:
    """``bounded``: SELECT of (clip_id, first_step, last_step)."""
    bounds = bounded or "SELECT NULL::BIGINT AS clip_id, NULL::INT AS first_step, NULL::INT AS last_step WHERE false"
    return [
        f"bounds AS ({bounds})",
        f"sized AS (SELECT h.*, count(*) OVER (PARTITION BY h.clip_id)::INT AS n, first_step, last_step FROM {source} h LEFT JOIN bounds b ON b.clip_id = h.clip_id)",
        "windowed AS (SELECT clip_id, frame, hip_y, body_h, greatest(0, least(coalesce(first_step, 0), n - 1)) AS start_idx, least(coalesce(last_step + 1, n), n) AS end_idx FROM sized)",
        "inside AS (SELECT * FROM windowed WHERE frame >= start_idx AND frame < end_idx)",
        "valid AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS rank, count(*) OVER (PARTITION BY clip_id) AS n_valid FROM inside WHERE hip_y IS NOT NULL AND body_h > 1e-4)",
        "early AS (SELECT *, least(n_valid, greatest(3, trunc(0.2::DOUBLE * n_valid)::BIGINT)) AS k FROM valid)",
        "quart AS (SELECT clip_id, count(*) AS m, quantile_cont(hip_y, 0.25) AS h1, quantile_cont(hip_y, 0.75) AS h3, quantile_cont(body_h, 0.25) AS b1, quantile_cont(body_h, 0.75) AS b3 FROM early WHERE rank < k GROUP BY clip_id)",
        """good AS (SELECT e.clip_id, avg(hip_y) AS hip, avg(body_h) AS height FROM early e JOIN quart q USING (clip_id) WHERE rank < k
AND (m < 5 OR h3 - h1 < 1e-6 OR hip_y BETWEEN h1 - 1.5::DOUBLE * (h3 - h1) AND h3 + 1.5::DOUBLE * (h3 - h1))
AND (m < 5 OR b3 - b1 < 1e-6 OR body_h BETWEEN b1 - 1.5::DOUBLE * (b3 - b1) AND b3 + 1.5::DOUBLE * (b3 - b1)) GROUP BY e.clip_id)""",
        "plain AS (SELECT clip_id, avg(hip_y) AS hip, avg(body_h) AS height FROM early WHERE rank < k GROUP BY clip_id)",
        "based AS (SELECT e.*, coalesce(g.hip, p.hip) AS base_hip, coalesce(g.height, p.height) AS base_height FROM early e JOIN plain p USING (clip_id) LEFT JOIN good g USING (clip_id))",
        "drooped AS (SELECT *, CASE WHEN n_valid >= 3 THEN (hip_y - base_hip) / base_height * 100.0::DOUBLE END AS droop FROM based)",
        "late AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY droop DESC, frame DESC) AS place, count(*) OVER (PARTITION BY clip_id) AS n_late FROM drooped WHERE n_valid >= 3 AND rank >= n_valid // 2)",
        "worst AS (SELECT * FROM late WHERE place <= least(n_late, greatest(1, round_even(0.05::DOUBLE * n_late, 0)::BIGINT)))",
    ]


_METRICS = """hip_out AS (SELECT c.clip_id, w.pct AS hip_droop_pct, l.mean - e.mean AS hip_droop_trend_pct, coalesce(v.n, 0)::INT AS n_valid, coalesce(w.frames, '') AS worst_frames, c.start_idx, c.end_idx
FROM (SELECT clip_id, max(start_idx) AS start_idx, max(end_idx) AS end_idx FROM windowed GROUP BY clip_id) c
LEFT JOIN (SELECT clip_id, count(*) AS n FROM valid GROUP BY clip_id) v USING (clip_id)
LEFT JOIN (SELECT clip_id, avg(droop) AS mean FROM late GROUP BY clip_id) l USING (clip_id)
LEFT JOIN (SELECT clip_id, avg(droop) AS mean FROM drooped WHERE rank < k GROUP BY clip_id) e USING (clip_id)
LEFT JOIN (SELECT clip_id, avg(droop) AS pct, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS frames FROM worst GROUP BY clip_id) w USING (clip_id))"""


def _made_up(source: str) -> str:
    return f"SELECT DISTINCT clip_id, (clip_id % 7 * 3)::INT AS first_step, CASE WHEN clip_id % 5 <> 0 THEN (clip_id % 11 * 9 + 30)::INT END AS last_step FROM {source}"


# labels --------------------------------------------------------------------------------------
_STEPS = [
    "ends AS (SELECT clip_id, min(seq) FILTER (action = 'e') AS fin, min(seq) FILTER (action = 'abort') AS aborted FROM step_marks GROUP BY clip_id)",
    "kept AS (SELECT m.* FROM step_marks m JOIN ends e USING (clip_id) WHERE (aborted IS NULL OR coalesce(aborted > fin, false)) AND (fin IS NULL OR seq <= fin))",
    """steps AS (SELECT clip_id, coalesce(list_sort(list(DISTINCT frame) FILTER (action = 's')), []) AS steps, min(frame) FILTER (action = 's') AS first_step,
coalesce(arg_max(frame, seq) FILTER (action = 's'), max(frame) FILTER (action = 'e')) AS last_step FROM kept GROUP BY clip_id)""",
]
_EACH = "each_step AS (SELECT clip_id, unnest(steps) AS step FROM steps)"
_STRIDE = [
    _EACH,
    "timed AS (SELECT e.clip_id, e.step, CASE WHEN fps > 0 THEN e.step / fps END AS t FROM each_step e JOIN user_clips USING (clip_id))",
    "gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY clip_id ORDER BY step) AS gap FROM timed)",
    "mean_gap AS (SELECT clip_id, count(*) AS n_steps, avg(gap) FILTER (gap > 0) AS mean_interval_s FROM gaps GROUP BY clip_id)",
    "stride AS (SELECT s.clip_id, coalesce(n_steps, 0) AS n_steps, mean_interval_s, 1.0::DOUBLE / mean_interval_s AS stride_rate, 60.0::DOUBLE * (1.0::DOUBLE / mean_interval_s) AS cadence FROM steps s JOIN user_clips USING (clip_id) LEFT JOIN mean_gap USING (clip_id))",
]
_NEAR = "near AS (SELECT DISTINCT clip_id, unnest(range(greatest(0, step - half), least(total_frames - 1, step + half) + 1))::INT AS frame FROM (SELECT e.clip_id, step, total_frames, CASE WHEN fps > 0 THEN greatest(1, round_even(fps / 30.0::DOUBLE, 0)::INT) ELSE 1 END AS half FROM each_step e JOIN user_clips USING (clip_id)) b WHERE greatest(0, step - half) <= least(total_frames - 1, step + half))"
_RANGES = [
    "states AS (SELECT *, last_value(CASE WHEN action = 'start' THEN frame END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN action = 'end' THEN frame END IGNORE NULLS) OVER w AS e FROM range_marks WINDOW w AS (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "closing AS (SELECT clip_id, min(seq) AS seq FROM states WHERE action = 'cancel' OR (action = 'confirm' AND s IS NOT NULL AND e IS NOT NULL) GROUP BY clip_id)",
    "ranges AS (SELECT c.clip_id, least(s, e) AS start_frame, greatest(s, e) AS end_frame FROM (SELECT DISTINCT clip_id FROM range_marks) c LEFT JOIN (SELECT clip_id, s, e FROM states JOIN closing USING (clip_id, seq) WHERE action = 'confirm') d USING (clip_id))",
]

# bend ----------------------------------------------------------------------------------------
_DIST = lambda a, b, c, d: f"sqrt((({a}) - ({c}))::DOUBLE * (({a}) - ({c}))::DOUBLE + (({b}) - ({d}))::DOUBLE * (({b}) - ({d}))::DOUBLE)"
_BEND = [
    "pts AS (SELECT clip_id, " + ", ".join(f"max({c}) FILTER (step = {s} AND click = {k}) AS {c}{s}{k}" for s, n in ((1, 2), (2, 2), (3, 1)) for k in range(n) for c in "xy") + " FROM bend_marks GROUP BY clip_id)",
    "held AS (SELECT *, " + ", ".join(f"CASE WHEN y20 < y21 THEN {c}20 ELSE {c}21 END AS top_{c}, CASE WHEN y20 < y21 THEN {c}21 ELSE {c}20 END AS hand_{c}" for c in "xy") + " FROM pts)",
    f"lens AS (SELECT *, {_DIST('x10', 'y10', 'x11', 'y11')} AS l_hand_tip, {_DIST('top_x', 'top_y', 'hand_x', 'hand_y')} AS l_top_hand FROM held)",
    "tip AS (SELECT *, l_hand_tip + l_top_hand AS l_full, " + ", ".join(f"CASE WHEN l_top_hand >= 1e-6 THEN top_{c} + (hand_{c} - top_{c})::DOUBLE / l_top_hand * (l_hand_tip + l_top_hand) END AS tip_{c}" for c in "xy") + " FROM lens)",
    f"bent AS (SELECT *, {_DIST('tip_x', 'tip_y', 'x30', 'y30')} AS l_bent FROM tip)",
]

# whole jobs, over clips of different sizes and rates --------------------------------------------
_MIXED = ("mixed_clips", "mixed_ranges", "mixed_detections", "landmarks")
_CLAMP_MIXED = ", ".join(f"trunc(least(greatest({c}, 0), {top}))::INT AS {c}" for c, top in (("x1", "width - 1"), ("y1", "height - 1"), ("x2", "width"), ("y2", "height")))
_MIXED_FOUND = [
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame, pass ORDER BY {_AREA} DESC, det_idx) AS rk FROM mixed_detections WHERE cls = 0 AND {_AREA} > 0)",
    f"cut_boxes AS (SELECT clip_id, frame, pass, width, height, {_CLAMP_MIXED} FROM ranked JOIN mixed_clips USING (clip_id) WHERE rk = 1)",
    "whole_boxes AS (SELECT * FROM cut_boxes WHERE x2 > x1 AND y2 > y1)",
    "seen AS (SELECT DISTINCT clip_id, frame FROM mixed_detections)",
    "found AS (SELECT s.clip_id, s.frame, " + ", ".join(f"CASE WHEN a.x1 IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM seen s LEFT JOIN whole_boxes a ON a.clip_id = s.clip_id AND a.frame = s.frame AND a.pass = 'original' LEFT JOIN whole_boxes b ON b.clip_id = s.clip_id AND b.frame = s.frame AND b.pass = 'boosted')",
]
_GROWN_SIDE = lambda a, b, sign: f"trunc({a} + ({b} - {a}) / 2 {sign} trunc(({b} - {a}) * 1.3::DOUBLE) / 2)::INT"
_MIXED_ROI = [
    *_MIXED_FOUND,
    f"sides AS (SELECT clip_id, frame, greatest(0, {_GROWN_SIDE('x1', 'x2', '-')}) AS x1, greatest(0, {_GROWN_SIDE('y1', 'y2', '-')}) AS y1, least(width, {_GROWN_SIDE('x1', 'x2', '+')}) AS x2, least(height, {_GROWN_SIDE('y1', 'y2', '+')}) AS y2, width, height FROM found JOIN mixed_clips USING (clip_id) WHERE x1 IS NOT NULL)",
    "mixed_roi AS (SELECT * FROM sides WHERE x2 > x1 AND y2 > y1)",
]
_MIXED_GAIT = [
    *_MIXED_FOUND,
    "asked AS (SELECT clip_id, least(a, b) AS a, greatest(a, b) AS b, abs(b - a) + 1 AS n_asked FROM (SELECT clip_id, greatest(0, start_frame) AS a, least(total_frames - 1, end_frame) AS b FROM mixed_ranges JOIN mixed_clips USING (clip_id)) r)",
    "every AS (SELECT clip_id, unnest(range(a, b + 1))::INT AS frame FROM asked)",
    "carried AS (SELECT e.clip_id, e.frame, " + ", ".join(f"last_value(f.{c} IGNORE NULLS) OVER w AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM every e LEFT JOIN found f USING (clip_id, frame) WINDOW w AS (PARTITION BY e.clip_id ORDER BY e.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "feet AS (SELECT clip_id, frame, lm_id, (c.x1 + l.x * (c.x2 - c.x1)) / width::DOUBLE AS x, (c.y1 + l.y * (c.y2 - c.y1)) / height::DOUBLE AS y FROM landmarks l JOIN carried c USING (clip_id, frame) JOIN mixed_clips USING (clip_id) WHERE lm_id IN (31, 32) AND visibility > 0.5 AND c.x1 IS NOT NULL)",
    "both_feet AS (SELECT clip_id, frame, unnest(['left', 'right']) AS foot, unnest([31, 32]) AS lm_id FROM every)",
    "all_feet AS (SELECT b.clip_id, b.foot, b.frame, f.x, f.y FROM both_feet b LEFT JOIN feet f USING (clip_id, frame, lm_id))",
    "gait AS (SELECT * FROM all_feet WHERE clip_id IN (SELECT clip_id FROM all_feet WHERE y IS NOT NULL))",
    *_gait(_RATE.format("clean"), _RATE.format("smooth")),
]
_MIXED_HIP = [
    *_MIXED_ROI,
    "placed AS (SELECT clip_id, frame, lm_id, (r.y1 + l.y * (r.y2 - r.y1)) / height::DOUBLE AS y FROM landmarks l JOIN mixed_roi r USING (clip_id, frame))",
    "hip_of AS (SELECT s.clip_id, s.frame, 0.5::DOUBLE * (max(y) FILTER (lm_id = 23) + max(y) FILTER (lm_id = 24)) AS hip_y, greatest(max(y) FILTER (lm_id = 27), max(y) FILTER (lm_id = 28)) - max(y) FILTER (lm_id = 0) AS body_h FROM seen s LEFT JOIN placed p USING (clip_id, frame) GROUP BY s.clip_id, s.frame)",
    "user_clips AS (SELECT * FROM mixed_clips)",
]
_SUMMARY_OF_CLIPS = f"""SELECT clip_id, start_frame, end_frame, round(CASE WHEN fps > 0 THEN start_frame / fps END, 6) AS t_start, round(CASE WHEN fps > 0 THEN end_frame / fps END, 6) AS t_end, n_steps, {_r('stride_rate', 'cadence', 'hip_droop_pct', 'hip_droop_trend_pct')}, n_valid
FROM (SELECT c.clip_id, c.fps, CASE WHEN s.last_step IS NOT NULL THEN coalesce(s.first_step, 0) ELSE 0 END AS start_frame, CASE WHEN s.last_step IS NOT NULL THEN s.last_step ELSE c.total_frames - 1 END AS end_frame, t.n_steps, stride_rate, cadence, hip_droop_pct, hip_droop_trend_pct, coalesce(n_valid, 0) AS n_valid
FROM user_clips c LEFT JOIN steps s USING (clip_id) LEFT JOIN stride t USING (clip_id) LEFT JOIN hip_out h USING (clip_id)) z"""

_FOOT = "clip_id, foot, frame"

ORACLES: dict[str, str] = {
    "clip_catalog": _with("SELECT clip_id, path FROM videos", _VIDEOS, base=("clips",)),
    "normalize_clips": _with(f"SELECT clip_id, fps, total_frames FROM ({_NORMAL} clips)", base=("clips",)),
    "frame_sample_plan": _with("SELECT clip_id, frame, stride FROM plan", *_PLAN, base=("clips",)),
    "sample_output_path": _with(f"SELECT clip_id, frame, 'out/' || {_STEM} || '/' || {_STEM} || '_f' || lpad(frame::VARCHAR, 6, '0') || '.jpg' AS output FROM plan", *_PLAN, base=("clips",)),
    "normalize_range": _with("SELECT clip_id, least(a, b) AS start_frame, greatest(a, b) AS end_frame, abs(b - a) + 1 AS n_frames FROM (SELECT clip_id, greatest(0, start_frame) AS a, least(total_frames - 1, end_frame) AS b FROM ranges JOIN user_clips USING (clip_id) WHERE start_frame IS NOT NULL AND end_frame IS NOT NULL) z", *_RANGES, base=("range_marks", "user_clips")),
    "largest_person_box": _with("SELECT f.clip_id, f.frame, f.pass, x1, y1, x2, y2 FROM (SELECT DISTINCT clip_id, frame, pass FROM detections) f LEFT JOIN best USING (clip_id, frame, pass)", _best("best", "clip_id, frame, pass"), base=("detections",)),
    "detect_with_fallback": _with("SELECT * FROM found", *_FOUND, base=("detections",)),
    "expand_roi": _with("SELECT * FROM roi", *_ROI, base=("detections",)),
    "carry_forward_box": _with("SELECT clip_id, frame, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM found", *_FOUND, base=("detections",)),
    "roi_to_frame": _with(f"SELECT clip_id, frame, lm_id, {_r('x', 'y')} FROM placed", _PLACED, base=_LMS),
    "gate_visibility": _with("SELECT clip_id, frame, lm_id, CASE WHEN visibility > 0.5 THEN round(x, 6) END AS x, CASE WHEN visibility > 0.5 THEN round(y, 6) END AS y FROM landmarks", base=("landmarks",)),
    "norm_to_px": _with(f"SELECT clip_id, frame, lm_id, trunc(x * {W})::INT AS px, trunc(y * {H})::INT AS py, CASE WHEN visibility > 0.5 THEN trunc(least(greatest(x, 0), 1) * {W})::INT END AS cx, CASE WHEN visibility > 0.5 THEN trunc(least(greatest(y, 0), 1) * {H})::INT END AS cy FROM landmarks", base=("landmarks",)),
    "hip_series": _with("SELECT r.clip_id, r.frame, round(0.5::DOUBLE * (max(y) FILTER (lm_id = 23) + max(y) FILTER (lm_id = 24)), 6) AS hip_y, round(greatest(max(y) FILTER (lm_id = 27), max(y) FILTER (lm_id = 28)) - max(y) FILTER (lm_id = 0), 6) AS body_h FROM rois r LEFT JOIN placed p USING (clip_id, frame) GROUP BY r.clip_id, r.frame", _PLACED, base=_LMS),
    "foot_series": _with("SELECT clip_id, CASE lm_id WHEN 31 THEN 'left' ELSE 'right' END AS foot, frame, CASE WHEN visibility > 0.5 THEN round(x, 6) END AS x, CASE WHEN visibility > 0.5 THEN round(y, 6) END AS y FROM placed WHERE lm_id IN (31, 32)", _PLACED, base=_LMS),
    "skeleton_qc": _with(
        """SELECT clip_id, frame, too_big, too_small, off_centre, outside > 0.30 AS mostly_outside, round(outside, 6) AS outside, NOT (too_big OR too_small OR off_centre OR outside > 0.30) AS accept FROM (
SELECT clip_id, frame, outside, w > 1.8::DOUBLE * rw OR h > 1.8::DOUBLE * rh AS too_big, h < 0.25::DOUBLE * rh AS too_small, abs(cx - rcx) > 0.6::DOUBLE * rw OR abs(cy - rcy) > 0.6::DOUBLE * rh AS off_centre FROM (
SELECT clip_id, frame, max(px) - min(px) AS w, max(py) - min(py) AS h, (min(px) + max(px)) / 2 AS cx, (min(py) + max(py)) / 2 AS cy, any_value(x2 - x1)::DOUBLE AS rw, any_value(y2 - y1)::DOUBLE AS rh, any_value((x1 + x2) / 2.0::DOUBLE) AS rcx, any_value((y1 + y2) / 2.0::DOUBLE) AS rcy,
avg((px < x1 - 2 OR px > x2 + 2 OR py < y1 - 2 OR py > y2 + 2)::INT::DOUBLE) AS outside
FROM (SELECT p.clip_id, p.frame, p.x * 1920.0::DOUBLE AS px, p.y * 1080.0::DOUBLE AS py, r.x1, r.y1, r.x2, r.y2 FROM placed p JOIN rois r USING (clip_id, frame)) a GROUP BY clip_id, frame) b) c""",
        _PLACED,
        base=_LMS,
    ),
    "drawable_segments": _with(
        "SELECT clip_id, frame, lm_id AS start_id, next_id AS end_id, px AS x1, py AS y1, next_px AS x2, next_py AS y2 FROM paired WHERE next_id = lm_id + 1",
        _PX,
        f"paired AS (SELECT *, lead(lm_id) OVER w AS next_id, lead(px) OVER w AS next_px, lead(py) OVER w AS next_py FROM px WHERE visibility >= 0.1 AND {_IN} WINDOW w AS (PARTITION BY clip_id, frame ORDER BY lm_id))",
        base=("landmarks",),
    ),
    "leg_segments": _with(_LEGS, _CLAMPED, base=("landmarks",)),
    "visible_joints": _with(f"SELECT clip_id, frame, lm_id, px, py FROM px WHERE {_IN}", _PX, base=("landmarks",)),
    "interpolate_gaps": _with(f"SELECT {_FOOT}, {_r('x', 'y')} FROM filled", *_GAIT[:3], base=("gait",)),
    "moving_average": _with(f"SELECT {_FOOT}, {_r('x', 'y')} FROM smooth", *_GAIT[:4], base=("gait",)),
    "velocity": _with(f"SELECT {_FOOT}, {_r('v')} FROM moving", *_GAIT[:5], base=("gait",)),
    "contact_thresholds": _with(f"SELECT clip_id, foot, {_r('y_thr', 'v_thr')} FROM thr", *_GAIT[:6], base=("gait",)),
    "contact_flag": _with(f"SELECT {_FOOT}, c AS contact FROM flagged", *_GAIT[:7], base=("gait",)),
    "drop_short_runs": _with(f"SELECT {_FOOT}, contact FROM clean", *_GAIT[:9], base=("gait",)),
    "rising_edges": _with(f"SELECT {_FOOT}, {_r('t_s')} FROM stepped WHERE step", *_GAIT, base=("gait",)),
    "contact_state": _with("SELECT clip_id, foot, CASE WHEN contact THEN 'CONTACT' ELSE 'SWING' END AS state, count(*) AS frames FROM clean GROUP BY ALL", *_GAIT[:9], base=("gait",)),
    "contact_summary": _with(
        """SELECT clip_id, foot, count(*) FILTER (step) AS steps, count(*) AS n_frames, count(*) FILTER (contact) AS contact_frames, round(max(t_s) - min(t_s), 6) AS total_s,
round(CASE WHEN max(t_s) > min(t_s) THEN count(*) FILTER (step) / (max(t_s) - min(t_s)) ELSE 0 END, 6) AS frequency,
round(CASE WHEN count(*) FILTER (step) >= 2 THEN (max(t_s) FILTER (step) - min(t_s) FILTER (step)) / (count(*) FILTER (step) - 1) END, 6) AS mean_interval_s FROM stepped GROUP BY clip_id, foot""",
        *_GAIT,
        base=("gait",),
    ),
    "foot_trail": _with(f"SELECT {_FOOT}, trunc(least(greatest(x, 0), 1) * {W})::INT AS px, trunc(least(greatest(y, 0), 1) * {H})::INT AS py, contact, row_number() OVER ({_O}) AS seen FROM clean WHERE x IS NOT NULL AND y IS NOT NULL", *_GAIT[:9], base=("gait",)),
    "analysis_window": _with("SELECT clip_id, frame, start_idx, end_idx FROM inside", *_hip("hip_short", _made_up("hip_short")), base=("hip_short",)),
    "valid_pose_frames": _with("SELECT clip_id, frame FROM hip WHERE hip_y IS NOT NULL AND body_h > 1e-4", base=("hip",)),
    "iqr_outlier_flag": _with("SELECT clip_id, frame, m < 5 OR q3 - q1 < 1e-6 OR hip_y BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS hip_y_in FROM valid JOIN (SELECT clip_id, count(*) AS m, quantile_cont(hip_y, 0.25) AS q1, quantile_cont(hip_y, 0.75) AS q3 FROM valid GROUP BY clip_id) q USING (clip_id)", *_hip("hip_short"), base=("hip_short",)),
    "hip_baseline": _with("SELECT clip_id, round(max(base_hip), 6) AS base_hip, round(max(base_height), 6) AS base_height, max(k) AS k, max(n_valid) AS n_valid FROM based GROUP BY clip_id", *_hip("hip_short"), base=("hip_short",)),
    "droop_series": _with("SELECT clip_id, frame, rank, round(droop, 6) AS droop FROM drooped", *_hip("hip"), base=("hip",)),
    "worst_frames": _with("SELECT clip_id, frame, place, round(droop, 6) AS droop FROM worst", *_hip("hip"), base=("hip",)),
    "hip_droop": _with(f"SELECT clip_id, {_r('hip_droop_pct', 'hip_droop_trend_pct')}, n_valid, worst_frames, start_idx, end_idx FROM hip_out", *_hip("hip_short", _made_up("hip_short")), _METRICS, base=("hip_short",)),
    "hip_trail": _with(
        f"""SELECT i.clip_id, i.frame, trunc(i.body_h * 1.5::DOUBLE * {W})::INT AS px, trunc(i.hip_y * {H})::INT AS py, w.frame IS NOT NULL AS worst, row_number() OVER (PARTITION BY i.clip_id ORDER BY i.frame) AS seen
FROM (SELECT h.* FROM (SELECT h.*, count(*) OVER (PARTITION BY clip_id)::INT AS n FROM hip h) h JOIN ({_made_up('hip')}) b USING (clip_id) WHERE frame >= greatest(0, least(first_step, n - 1)) AND frame < least(last_step + 1, n) AND last_step IS NOT NULL AND hip_y IS NOT NULL AND body_h IS NOT NULL) i LEFT JOIN worst w ON w.clip_id = i.clip_id AND w.frame = i.frame""",
        *_hip("hip"),
        base=("hip",),
    ),
    "step_marks_reduce": _with("SELECT clip_id, array_to_string(steps, ',') AS steps, first_step, last_step FROM steps", *_STEPS, base=("step_marks",)),
    "range_marks_reduce": _with("SELECT * FROM ranges", *_RANGES, base=("range_marks",)),
    "stride_metrics": _with(f"SELECT clip_id, n_steps, {_r('mean_interval_s', 'stride_rate', 'cadence')} FROM stride", *_STEPS, *_STRIDE, base=("step_marks", "user_clips")),
    "step_highlight": _with("SELECT clip_id, frame FROM near", *_STEPS, _EACH, _NEAR, base=("step_marks", "user_clips")),
    "phase_flags": _with("SELECT h.clip_id, h.frame, coalesce(frame < first_step, false) AS before_first, coalesce(frame >= coalesce(first_step, 0) AND frame <= last_step, false) AS in_approach, coalesce(frame > last_step, false) AS jump FROM hip_short h LEFT JOIN steps USING (clip_id)", *_STEPS, base=("step_marks", "hip_short")),
    "mark_frames": _with("SELECT h.clip_id, h.frame, n.frame IS NOT NULL AS near_step FROM hip_short h LEFT JOIN near n ON n.clip_id = h.clip_id AND n.frame = h.frame", *_STEPS, _EACH, _NEAR, base=("step_marks", "user_clips", "hip_short")),
    "approach_summary": _with(_SUMMARY_OF_CLIPS, *_STEPS, *_STRIDE, *_hip("hip_short", "SELECT clip_id, first_step, last_step FROM steps"), _METRICS, base=("step_marks", "user_clips", "hip_short")),
    "project_tip": _with(f"SELECT clip_id, {_r('tip_x', 'tip_y', 'l_full')} FROM tip", *_BEND, base=("bend_marks",)),
    "pole_bend": _with(f"SELECT clip_id, {_r('l_hand_tip', 'l_top_hand', 'l_full', 'l_bent')}, round(1 - l_bent / l_full, 6) AS bend_fraction, round((1 - l_bent / l_full) * 100.0::DOUBLE, 6) AS bend_pct FROM bent", *_BEND, base=("bend_marks",)),
    "frame_aligned": _with(
        "SELECT r.clip_id, r.frame, x1, y1, x2, y2, round(hip_y, 6) AS hip_y FROM (SELECT clip_id, frame FROM rois) r LEFT JOIN fixed_found USING (clip_id, frame) LEFT JOIN (SELECT clip_id, frame, 0.5::DOUBLE * (max(y) FILTER (lm_id = 23 AND visibility > 0.5) + max(y) FILTER (lm_id = 24 AND visibility > 0.5)) AS hip_y FROM landmarks WHERE frame % 3 = 0 GROUP BY clip_id, frame) h USING (clip_id, frame)",
        f"sized AS (SELECT clip_id, fps, {W} AS width, {H} AS height FROM mixed_clips)",
        *[x.replace("mixed_clips", "sized") for x in _MIXED_FOUND],
        "fixed_found AS (SELECT * FROM found)",
        base=(*_MIXED, "rois"),
    ),
    "boxes_of_mixed_sizes": _with("SELECT f.clip_id, f.frame, " + ", ".join(f"f.{c} AS box_{c}" for c in ("x1", "y1", "x2", "y2")) + ", " + ", ".join(f"r.{c} AS roi_{c}" for c in ("x1", "y1", "x2", "y2")) + " FROM found f LEFT JOIN mixed_roi r USING (clip_id, frame)", *_MIXED_ROI, base=_MIXED),
    "ground_contacts": _with(f"SELECT {_FOOT}, {_r('s.x', 's.y', 'v', 't_s')}, contact, step FROM stepped s JOIN (SELECT clip_id, foot, frame, v FROM moving) m USING (clip_id, foot, frame)", *_MIXED_GAIT, base=_MIXED),
    "ground_contacts_summary": _with(
        """SELECT clip_id, foot, count(*) FILTER (step) AS steps, max(n_asked)::BIGINT AS n_frames, count(*) FILTER (contact) AS contact_frames, round(max(t_s) - min(t_s), 6) AS total_s,
round(CASE WHEN max(t_s) > min(t_s) THEN count(*) FILTER (step) / (max(t_s) - min(t_s)) ELSE 0 END, 6) AS frequency,
round(CASE WHEN count(*) FILTER (step) >= 2 THEN (max(t_s) FILTER (step) - min(t_s) FILTER (step)) / (count(*) FILTER (step) - 1) END, 6) AS mean_interval_s FROM stepped JOIN asked USING (clip_id) GROUP BY clip_id, foot""",
        *_MIXED_GAIT,
        base=_MIXED,
    ),
    "approach": _with(_SUMMARY_OF_CLIPS, *_STEPS, *_MIXED_HIP, *_STRIDE, *_hip("hip_of", "SELECT clip_id, first_step, last_step FROM steps"), _METRICS, base=("step_marks", *_MIXED)),
    "any_foot_guard": _with("SELECT clip_id, foot, count(*) AS frames FROM gait WHERE clip_id IN (SELECT clip_id FROM gait WHERE y IS NOT NULL AND clip_id % 5 <> 0) GROUP BY clip_id, foot", base=("gait",)),
    "display_to_original": _with("SELECT clip_id, step, click, trunc(x / 0.75::DOUBLE)::INT AS x, trunc(y / 0.75::DOUBLE)::INT AS y FROM bend_marks", base=("bend_marks",)),
    "output_names": _with("SELECT clip_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') || '_pv_processed.mp4' AS processed, regexp_replace(path, '\\.[^./]+$', '') || '_foot_contact_overlay.mp4' AS overlay FROM clips", base=("clips",)),
    "write_by_clip": _with(f"SELECT {_FOOT}, {_r('x', 'y')} FROM gait", base=("gait",)),
}
# cutting clips into chunks changes nothing
ORACLES["carry_forward_box_in_chunks"] = ORACLES["carry_forward_box"]
ORACLES["hip_droop_in_chunks"] = ORACLES["hip_droop"]

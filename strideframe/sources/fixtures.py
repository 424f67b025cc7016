"""Pose, detection and label tables derived from the supplied test tables, for both engines.

Each is one SELECT of integer and plain arithmetic that Spark and DuckDB compute alike; the
few spellings that differ are filled in for the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT, FPS = 1920, 1080, 30.0

_SPARK = {"lms": "LATERAL VIEW explode(sequence(0, 32)) t AS lm_id", "clicks": "LATERAL VIEW explode(sequence(0, 4)) t AS j", "el": "element_at", "int": "CAST({} AS INT)"}
_DUCK = {"lms": ", unnest(range(33)) t(lm_id)", "clicks": ", unnest(range(5)) t(j)", "el": "list_extract", "int": "CAST(trunc({}) AS INT)"}


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_FRAMES = "CAST(row_number() OVER (PARTITION BY {clip} ORDER BY ts, event_id) - 1 AS INT)"


def _foot(foot: str, phase: str) -> str:
    y = f"{_d('0.9')} - {_d('0.02')} * greatest(0, least({phase} - 7, 20 - {phase})) + ((event_id * 7919) % 10007) * {_d('1.0371e-7')}"
    x = f"{_d('0.1')} + (frame % 700) * {_d('0.001')} + ((event_id * 31) % 101) * {_d('1.0173e-6')}"
    return f"SELECT clip_id, '{foot}' AS foot, frame, CASE WHEN event_id % 11 = 0 THEN NULL ELSE {x} END AS x, CASE WHEN event_id % 11 = 0 THEN NULL ELSE {y} END AS y FROM (SELECT user_id AS clip_id, {_FRAMES.format(clip='user_id')} AS frame, event_id FROM {{events}}) g"


def _hip(clip: str) -> str:
    gone = "event_type = 'error' OR event_id % 37 = 0"
    return f"""SELECT {clip} AS clip_id, {_FRAMES.format(clip=clip)} AS frame,
    CASE WHEN {gone} THEN NULL ELSE {_d('0.5')} + value / {_d('10000')} END AS hip_y,
    CASE WHEN {gone} THEN NULL ELSE {_d('0.3')} + (event_id % 101) / {_d('10000')} END AS body_h FROM {{events}}"""


def texts(duck: bool) -> dict[str, str]:
    """SQL of each derived table; base tables stand in braces."""
    e = _DUCK if duck else _SPARK
    integer = e["int"].format
    marks = f"SELECT user_id AS clip_id, {_FRAMES.format(clip='user_id')} AS seq, event_id, event_type FROM {{events}}"
    at = "greatest(0, seq * 7 + CAST(event_id % 5 AS INT) - CASE WHEN event_id % 17 = 0 THEN 60 ELSE 0 END)"
    element = lambda i: f"{e['el']}(embedding, {i})"
    clip_name = "concat('clips/set A/run#', CAST(o_orderkey AS STRING), CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.mkv' WHEN 3 THEN '.txt' WHEN 4 THEN '.avi' ELSE '.m4v' END)"
    return {
        "gait": _foot("right", "frame % 20") + " UNION ALL " + _foot("left", "(frame + 10) % 20"),
        "hip": _hip("user_id % 10"),
        "hip_short": _hip("user_id"),
        "detections": f"""SELECT l_orderkey % 50 AS clip_id, CAST(l_orderkey AS INT) AS frame, CASE WHEN l_linestatus = 'F' THEN 'original' ELSE 'boosted' END AS pass,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS det_idx,
    CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS cls, 1 - l_discount AS conf,
    (l_partkey % 2400) - {_d('200.5')} AS x1, (l_suppkey % 97) * 12 - {_d('40.25')} AS y1,
    (l_partkey % 2400) - {_d('200.5')} + l_quantity * 12 AS x2, (l_suppkey % 97) * 12 - {_d('40.25')} + l_extendedprice / {_d('150')} AS y2 FROM {{lineitem}}""",
        "landmarks": f"""SELECT CAST(label AS BIGINT) AS clip_id, frame, vec_id, CAST(lm_id AS INT) AS lm_id,
    {_d('0.5')} + {_d(element('CAST(2 * (lm_id % 32) + 1 AS INT)'))} AS x, {_d('0.5')} + {_d(element('CAST(2 * (lm_id % 32) + 2 AS INT)'))} AS y,
    ((vec_id * 31 + lm_id * 17) % 100) / {_d('100')} AS visibility
    FROM (SELECT label, vec_id, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame FROM {{embeddings}}) v {e['lms']}""",
        "rois": """SELECT CAST(label AS BIGINT) AS clip_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, vec_id % 13 <> 0 AS has,
    CAST(vec_id % 400 AS INT) AS x1, CAST(vec_id % 200 AS INT) AS y1, CAST(vec_id % 400 + 300 + vec_id % 97 AS INT) AS x2, CAST(vec_id % 200 + 500 + vec_id % 89 AS INT) AS y2 FROM {embeddings}""",
        "mixed_clips": f"""SELECT CAST(label AS BIGINT) AS clip_id, concat('set B/take ', CAST(label AS STRING), '.mp4') AS path, {_d("CASE label % 4 WHEN 0 THEN 25 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 59.94 END")} AS fps,
    CAST(CASE label % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1280 ELSE 3840 END AS INT) AS width, CAST(CASE label % 3 WHEN 0 THEN 1080 WHEN 1 THEN 720 ELSE 2160 END AS INT) AS height, CAST(count(*) AS INT) AS total_frames FROM {{embeddings}} GROUP BY label
    UNION ALL SELECT CAST(max(label) + 1 AS BIGINT), 'set B/no frames.avi', {_d("0")}, 1920, 1080, 0 FROM {{embeddings}}""",
        "mixed_ranges": """SELECT CAST(label AS BIGINT) AS clip_id, CAST(count(*) - 2 AS INT) AS start_frame, CAST(3 + label % 4 AS INT) AS end_frame FROM {embeddings} GROUP BY label""",
        "mixed_detections": f"""SELECT CAST(label AS BIGINT) AS clip_id, frame, CASE WHEN vec_id % 7 = 0 THEN 'boosted' ELSE 'original' END AS pass, CAST(j AS INT) AS det_idx, CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 0 END AS cls, {_d("1")} AS conf,
    (vec_id % 400) - {_d("50.5")} AS x1, (vec_id % 200) - {_d("20.25")} AS y1, (vec_id % 400) + 300 + (vec_id % 97) * (j + 1) + {_d("0.5")} AS x2, (vec_id % 200) + 500 + (vec_id % 89) * (j + 1) + {_d("0.75")} AS y2
    FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame FROM {{embeddings}}) v {e['clicks']} WHERE j < 2 AND vec_id % 11 <> 0""",
        "step_marks": f"""SELECT clip_id, seq, action, {at} AS frame FROM (SELECT *, CASE WHEN event_id % 1009 = 0 THEN 'abort' WHEN event_type = 'click' THEN 's' WHEN event_type = 'purchase' AND event_id % 13 = 0 THEN 'e' END AS action FROM ({marks}) a) m WHERE action IS NOT NULL""",
        "range_marks": f"""SELECT clip_id, seq, action, {at} AS frame FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'start' WHEN event_id % 7 = 1 THEN 'end' WHEN event_id % 11 = 2 THEN 'confirm' WHEN event_id % 97 = 3 THEN 'cancel' END AS action FROM ({marks}) a) m WHERE action IS NOT NULL""",
        "bend_marks": f"""SELECT vec_id AS clip_id, CASE WHEN j < 2 THEN 1 WHEN j < 4 THEN 2 ELSE 3 END AS step, CAST(CASE WHEN j < 4 THEN j % 2 ELSE 0 END AS INT) AS click,
    {integer(_d(element('CAST(2 * j + 1 AS INT)')) + ' * 1000')} AS x, {integer(_d(element('CAST(2 * j + 2 AS INT)')) + ' * 1000')} AS y FROM {{embeddings}} {e['clicks']}""",
        "clips": f"""SELECT o_orderkey AS clip_id, {clip_name} AS path,
    {_d("CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 25 WHEN '3-MEDIUM' THEN 30 WHEN '4-NOT SPECIFIED' THEN 75 ELSE 240 END")} AS fps, {integer('o_totalprice / 1000')} AS total_frames FROM {{orders}}""",
        "user_clips": f"SELECT user_id AS clip_id, {_d('CASE WHEN user_id % 7 = 0 THEN 0 ELSE 25 + user_id % 3 * 45 END')} AS fps, CAST(count(*) * 7 AS INT) AS total_frames FROM {{events}} GROUP BY user_id",
    }


_BASES = ("events", "lineitem", "embeddings", "orders")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = texts(False)[name]
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in _BASES if f"{{{b}}}" in text}
    return spark.sql(text, **used)


def duck_cte(*names: str) -> str:
    """The derived tables as DuckDB CTEs, without WITH."""
    found = texts(True)
    return ",\n".join(f"{n} AS MATERIALIZED ({found[n].format(**{b: b for b in _BASES})})" for n in names)

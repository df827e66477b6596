"""Common table expressions of the check queries, in DuckDB's SQL."""

ORDER = "PARTITION BY recording_id ORDER BY i"

GAZE = """
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id AS sample_seq,
    (epoch_us(ts) - 1704067200000000) / 3.6e8 AS timestamp_ms,
    CASE WHEN event_type <> 'error' THEN value / 0.97 END AS x,
    CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS DOUBLE) END AS y,
    CASE WHEN event_type <> 'error' THEN 2.0 + (event_id % 37) / 19.0 END AS pupil,
    event_type <> 'error' AS valid,
    CASE event_type WHEN 'purchase' THEN 'task_start' WHEN 'signup' THEN 'task_end' END AS marker,
    CASE WHEN user_id % 4 <> 0 THEN
      CASE event_type WHEN 'click' THEN 'fix' WHEN 'view' THEN 'Fixation' WHEN 'purchase' THEN 'SACC'
        WHEN 'signup' THEN 'SP' WHEN 'error' THEN 'blink_start' END END AS event_label,
    't' || (user_id % 2) AS trial
  FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, sample_seq) - 1 AS i FROM raw)"""

RECORDINGS = """
rec AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording_id, 's' || user_id AS session_id,
    CAST(user_id // 3 AS VARCHAR) AS subject_id, 'c' || (user_id % 3) AS condition, 't' || (user_id % 2) AS trial
  FROM events)"""


def interpolated(dst: str, src: str, columns: dict[str, str]) -> str:
    """``columns`` maps a result column to the expression whose nulls are filled."""
    masked = ", ".join(f"{e} AS m_{c}" for c, e in columns.items())
    near = ", ".join(
        f"""last_value(m_{c} IGNORE NULLS) OVER back AS pv_{c},
        last_value(CASE WHEN m_{c} IS NOT NULL THEN i END IGNORE NULLS) OVER back AS pi_{c},
        first_value(m_{c} IGNORE NULLS) OVER ahead AS nv_{c},
        first_value(CASE WHEN m_{c} IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS ni_{c}"""
        for c in columns
    )
    values = ", ".join(
        f"coalesce(m_{c}, pv_{c} + (i - pi_{c}) * (nv_{c} - pv_{c}) / nullif(ni_{c} - pi_{c}, 0), pv_{c}, nv_{c}) AS {c}"
        for c in columns
    )
    drop = ", ".join(columns)
    return f"""
{dst}_m AS (SELECT *, {masked} FROM {src}),
{dst}_n AS (SELECT *, {near} FROM {dst}_m WINDOW
  back AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  ahead AS ({ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{dst} AS (SELECT * EXCLUDE ({drop}), {values} FROM {dst}_n)"""


def interpolated_samples(dst: str, src: str = "g") -> str:
    return interpolated(dst, src, {c: f"CASE WHEN valid THEN {c} END" for c in ("x", "y", "pupil")})


def smoothed(dst: str, src: str, window: int = 5, columns=("x", "y", "pupil")) -> str:
    means = ", ".join(f"avg({c}) OVER near AS {c}" for c in columns)
    return f"""
{dst} AS (SELECT * EXCLUDE ({', '.join(columns)}), {means} FROM {src}
  WINDOW near AS ({ORDER} ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING))"""


def velocity(dst: str, src: str = "g") -> str:
    return f"""
{dst}_d AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS dt,
    sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step
  FROM {src} WINDOW w AS ({ORDER})),
{dst} AS (SELECT *, coalesce(step, 0.0) AS step_px,
    CASE WHEN valid THEN coalesce(step / (nullif(dt, 0.0) / 1000.0), 0.0) ELSE 0.0 END AS velocity FROM {dst}_d)"""


def kind_of(threshold: float = 850.0) -> str:
    return f"CASE WHEN NOT valid THEN 'blink' WHEN velocity >= {threshold} THEN 'saccade' ELSE 'fixation' END"


def label_kind(column: str = "event_label") -> str:
    return (
        f"CASE lower(trim({column})) WHEN 'fix' THEN 'fixation' WHEN 'fixation' THEN 'fixation' WHEN 'sacc' THEN 'saccade' "
        "WHEN 'sp' THEN 'smooth_pursuit' WHEN 'blink_start' THEN 'blink' END"
    )


def runs(dst: str, src: str, label: str) -> str:
    """Samples of ``src`` with the label and the index of the first sample of its run."""
    return f"""
{dst}_l AS (SELECT *, {label} AS kind FROM {src}),
{dst}_b AS (SELECT *, CASE WHEN i = 0 OR kind IS DISTINCT FROM lag(kind) OVER ({ORDER}) THEN 1 ELSE 0 END AS edge FROM {dst}_l),
{dst} AS (SELECT *, sum(edge) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM {dst}_b)"""


def events(dst: str, src: str, keep: str | None = None) -> str:
    """Event table of the runs in ``src``; ``keep`` is the condition that exempts a run from the filters."""
    exempt = keep or "FALSE"
    return f"""
{dst}_a AS (SELECT recording_id, kind, min(timestamp_ms) AS start_time_ms, max(timestamp_ms) AS end_time_ms,
    max(timestamp_ms) - min(timestamp_ms) AS duration_ms, min(i) AS start_index, max(i) AS end_index,
    CASE WHEN kind <> 'blink' THEN sqrt(pow(arg_max_null(x, i) - arg_min_null(x, i), 2) + pow(arg_max_null(y, i) - arg_min_null(y, i), 2)) ELSE 0.0 END AS amplitude,
    max(velocity) AS peak_velocity,
    CASE WHEN kind <> 'blink' THEN avg(x) END AS centroid_x, CASE WHEN kind <> 'blink' THEN avg(y) END AS centroid_y,
    arg_min_null(event_label, i) AS source_label, bool_or({exempt}) AS exempt
  FROM {src} WHERE kind IS NOT NULL GROUP BY recording_id, run, kind),
{dst} AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_index) - 1 AS event_index
  FROM {dst}_a WHERE exempt OR NOT ((kind = 'fixation' AND duration_ms < 60) OR (kind = 'blink' AND duration_ms < 75)))"""


VELOCITY = velocity("v")
THRESHOLD_RUNS = runs("r", "v", kind_of())
EVENTS = events("ev", "r")
BASE_EVENTS = [GAZE, VELOCITY, THRESHOLD_RUNS, EVENTS]

# preprocessed samples and the events of the full pipeline (labels where the recording has them)
PRE = [GAZE, interpolated_samples("gi"), smoothed("p", "gi")]
PRE_EVENTS = PRE + [
    velocity("pv", "p"),
    "pl AS (SELECT *, count(event_label) OVER (PARTITION BY recording_id) > 0 AS from_labels FROM pv)",
    runs("pr", "pl", f"CASE WHEN from_labels THEN {label_kind()} ELSE {kind_of()} END"),
    events("pe", "pr", "from_labels"),
]

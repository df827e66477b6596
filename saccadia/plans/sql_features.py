"""Feature CTEs of the check queries; ``src`` has i and velocity, ``evs`` is an event CTE."""

from saccadia.plans.sql import ORDER

SIGNALS = ("x", "y", "pupil")


def base(dst, src):
    return f"""
{dst} AS (SELECT recording_id, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, count(*) AS sample_count,
    avg(CAST(valid AS DOUBLE)) AS valid_ratio, sum(step_px) AS path_length, avg(velocity) AS velocity_mean,
    max(velocity) AS velocity_peak FROM {src} GROUP BY recording_id)"""


def event_features(dst, src, evs):
    return f"""
{dst}_d AS (SELECT recording_id, greatest((max(timestamp_ms) - min(timestamp_ms)) / 1000.0, 1e-6) AS s FROM {src} GROUP BY 1),
{dst}_o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, kind ORDER BY start_index) AS nth FROM {evs}),
{dst}_l AS (SELECT a.recording_id, avg(a.start_time_ms - b.end_time_ms) AS saccade_latency_mean
  FROM {dst}_o a JOIN {dst}_o b ON a.recording_id = b.recording_id AND a.nth = b.nth AND a.kind = 'saccade' AND b.kind = 'fixation'
  GROUP BY 1),
{dst}_c AS (SELECT recording_id,
    count(*) FILTER (kind = 'fixation') AS fixation_count, avg(duration_ms) FILTER (kind = 'fixation') AS fixation_duration_mean,
    sum(duration_ms) FILTER (kind = 'fixation') AS fixation_duration_total,
    count(*) FILTER (kind = 'saccade') AS saccade_count, avg(amplitude) FILTER (kind = 'saccade') AS saccade_amplitude_mean,
    avg(peak_velocity) FILTER (kind = 'saccade') AS saccade_peak_velocity_mean,
    count(*) FILTER (kind = 'blink') AS blink_count, avg(duration_ms) FILTER (kind = 'blink') AS blink_duration_mean
  FROM {evs} GROUP BY 1),
{dst} AS (SELECT recording_id,
    coalesce(fixation_count, 0) AS fixation_count, coalesce(fixation_duration_mean, 0) AS fixation_duration_mean,
    coalesce(fixation_duration_total, 0) AS fixation_duration_total, coalesce(fixation_count, 0) / s AS fixation_density,
    coalesce(saccade_count, 0) AS saccade_count, coalesce(saccade_amplitude_mean, 0) AS saccade_amplitude_mean,
    coalesce(saccade_peak_velocity_mean, 0) AS saccade_peak_velocity_mean,
    coalesce(saccade_latency_mean, 0) AS saccade_latency_mean,
    coalesce(blink_count, 0) AS blink_count, coalesce(blink_count, 0) / s AS blink_rate_hz,
    coalesce(blink_duration_mean, 0) AS blink_duration_mean
  FROM {dst}_d LEFT JOIN {dst}_c USING (recording_id) LEFT JOIN {dst}_l USING (recording_id))"""


def moments(dst, src):
    """Skewness and kurtosis from centred powers: sums of raw powers lose the digits compared here."""
    centred = ", ".join(f"{c} - avg({c}) OVER u AS c_{c}" for c in SIGNALS)
    parts = []
    for c in SIGNALS:
        n, m2, m3, m4 = f"count({c})", f"avg(c_{c} * c_{c})", f"avg(c_{c} * c_{c} * c_{c})", f"avg(c_{c} * c_{c} * c_{c} * c_{c})"
        skew = f"CASE WHEN {n} >= 3 THEN sqrt({n} * ({n} - 1.0)) / ({n} - 2.0) * {m3} / pow({m2}, 1.5) END"
        kurt = f"CASE WHEN {n} >= 4 THEN ({n} - 1.0) / (({n} - 2.0) * ({n} - 3.0)) * (({n} + 1.0) * ({m4} / ({m2} * {m2}) - 3.0) + 6.0) END"
        parts.append(f"""avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max,
    quantile_cont({c}, 0.25) AS {c}_q25, quantile_cont({c}, 0.75) AS {c}_q75,
    coalesce({skew}, 0) AS {c}_skew, coalesce({kurt}, 0) AS {c}_kurtosis""")
    return f"""
{dst}_c AS (SELECT *, {centred} FROM {src} WHERE valid WINDOW u AS (PARTITION BY recording_id)),
{dst} AS (SELECT recording_id, {', '.join(parts)} FROM {dst}_c GROUP BY 1)"""


def rolling(dst, src, window_ms=500.0):
    frames = ", ".join(f"avg({c}) OVER f AS m_{c}, coalesce(stddev_samp({c}) OVER f, 0) AS s_{c}" for c in SIGNALS)
    outs = ", ".join(f"stddev_pop(m_{c}) AS {c}_rolling_mean_std, avg(s_{c}) AS {c}_rolling_std_mean" for c in SIGNALS)
    return f"""
{dst}_v AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS vi, timestamp_ms - lag(timestamp_ms) OVER ({ORDER}) AS vdt
  FROM {src} WHERE valid),
{dst}_n AS (SELECT *, CAST(greatest(round_even({window_ms} / greatest(coalesce(median(vdt) OVER (PARTITION BY recording_id), {window_ms}), 1.0), 0), 2) AS BIGINT) AS k
  FROM {dst}_v),
{dst}_f AS (SELECT recording_id, {frames} FROM {dst}_n
  WINDOW f AS (PARTITION BY recording_id ORDER BY vi ROWS BETWEEN (k - 1) PRECEDING AND CURRENT ROW)),
{dst} AS (SELECT recording_id, {outs} FROM {dst}_f GROUP BY 1)"""


def pupil(dst, src):
    return f"""
{dst}_v AS (SELECT *, lag(timestamp_ms) OVER ({ORDER}) AS lt, lag(pupil) OVER ({ORDER}) AS lp,
    count(pupil) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS k, count(pupil) OVER (PARTITION BY recording_id) AS n
  FROM {src} WHERE valid),
{dst} AS (SELECT recording_id, coalesce(avg(pupil) FILTER (k <= greatest(floor(n * 0.1), 1)), 0) AS pupil_baseline,
    coalesce(avg(abs(pupil - lp) / (nullif(timestamp_ms - lt, 0.0) / 1000.0)), 0) AS pupil_change_rate
  FROM {dst}_v GROUP BY 1)"""


def entropy(dst, src):
    long = " UNION ALL ".join(
        f"SELECT recording_id, '{c}' AS signal, i, {c} AS a FROM {src} WHERE valid AND {c} IS NOT NULL" for c in SIGNALS
    )
    w = "PARTITION BY recording_id, signal"
    outs = ", ".join(
        f"coalesce(max(apen) FILTER (signal = '{c}'), 0) AS {c}_approx_entropy" for c in SIGNALS
    )
    return f"""
{dst}_s AS (SELECT *, row_number() OVER ({w} ORDER BY i) AS k, count(*) OVER ({w}) AS n,
    greatest(0.2 * stddev_pop(a) OVER ({w}), 1e-6) AS tol,
    lead(a) OVER ({w} ORDER BY i) AS b, lead(a, 2) OVER ({w} ORDER BY i) AS c FROM ({long})),
{dst}_p AS (SELECT p.recording_id, p.signal, p.k, any_value(p.n) AS n,
    count(*) FILTER (p.b IS NOT NULL AND q.b IS NOT NULL AND abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol) AS c2,
    count(*) FILTER (p.c IS NOT NULL AND q.c IS NOT NULL AND abs(p.a - q.a) <= p.tol AND abs(p.b - q.b) <= p.tol AND abs(p.c - q.c) <= p.tol) AS c3
  FROM {dst}_s p JOIN {dst}_s q ON p.recording_id = q.recording_id AND p.signal = q.signal GROUP BY 1, 2, 3),
{dst}_e AS (SELECT recording_id, signal,
    avg(ln(c2 / (n - 1.0))) FILTER (c2 > 0) - avg(ln(c3 / (n - 2.0))) FILTER (c3 > 0) AS apen
  FROM {dst}_p WHERE n >= 12 GROUP BY 1, 2),
{dst} AS (SELECT recording_id, {outs} FROM {dst}_e GROUP BY 1)"""


BASE_NUM = "duration_ms valid_ratio path_length velocity_mean velocity_peak"
EVENT_NUM = (
    "fixation_duration_mean fixation_duration_total fixation_density saccade_amplitude_mean saccade_peak_velocity_mean "
    "saccade_latency_mean blink_rate_hz blink_duration_mean"
)
COUNTS = "sample_count fixation_count saccade_count blink_count"
MOMENT_NUM = " ".join(f"{c}_{m}" for c in SIGNALS for m in "mean std min max q25 q75 skew kurtosis".split())
ROLLING_NUM = " ".join(f"{c}_{m}" for c in SIGNALS for m in ("rolling_mean_std", "rolling_std_mean"))
ENTROPY_NUM = " ".join(f"{c}_approx_entropy" for c in SIGNALS)
PUPIL_NUM = "pupil_baseline pupil_change_rate"
ALL_NUM = " ".join([BASE_NUM, EVENT_NUM, MOMENT_NUM, ROLLING_NUM, ENTROPY_NUM, PUPIL_NUM])
QUICK_NUM = " ".join([BASE_NUM, EVENT_NUM, MOMENT_NUM, ROLLING_NUM, PUPIL_NUM])


def all_features(dst, src, evs, complexity=True):
    parts = [base(f"{dst}1", src), event_features(f"{dst}2", src, evs), moments(f"{dst}3", src), rolling(f"{dst}4", src), pupil(f"{dst}5", src)]
    if complexity:
        parts.append(entropy(f"{dst}6", src))
    joins = " ".join(f"LEFT JOIN {dst}{k} USING (recording_id)" for k in range(2, 7 if complexity else 6))
    columns = (ALL_NUM if complexity else QUICK_NUM).split() + COUNTS.split()
    picked = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)
    parts.append(f"{dst} AS (SELECT recording_id, {picked} FROM {dst}1 {joins})")
    return parts


def pupil_load(dst, src, window_ms=1000.0, baseline_ms=500.0):
    """``src`` has i, valid, pupil, timestamp_ms; blinks are the invalid samples."""
    from saccadia.plans.sql import interpolated

    return f"""
{dst}_g AS (SELECT *, (NOT valid OR pupil IS NULL OR pupil <= 0) AS blink_mask,
    min(timestamp_ms) OVER (PARTITION BY recording_id) AS t0, timestamp_ms - lag(timestamp_ms) OVER ({ORDER}) AS dt0 FROM {src}),
{interpolated(dst + "_c", f"(SELECT *, CAST(NULL AS DOUBLE) AS cp FROM {dst}_g)", {"cp": "CASE WHEN NOT blink_mask THEN pupil END"})},
{dst}_s AS (SELECT *, avg(coalesce(cp, 0.0)) OVER ({ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cleaned_pupil FROM {dst}_c),
{dst}_k AS (SELECT *, sum(CASE WHEN blink_mask THEN 0 ELSE 1 END) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS k FROM {dst}_s),
{dst}_b AS (SELECT recording_id, coalesce(avg(cleaned_pupil) FILTER (NOT blink_mask AND timestamp_ms <= t0 + {baseline_ms}),
    avg(cleaned_pupil) FILTER (NOT blink_mask AND k <= 10), 0) AS baseline_value FROM {dst}_k GROUP BY 1),
{dst}_t AS (SELECT *, cleaned_pupil - baseline_value AS bc_pupil FROM {dst}_s JOIN {dst}_b USING (recording_id)),
{dst}_n AS (SELECT *, CAST(greatest(round_even({window_ms} / greatest(coalesce(median(dt0) OVER (PARTITION BY recording_id), {window_ms}), 1.0), 0), 2) AS BIGINT) AS fr,
    greatest(max(bc_pupil) OVER (PARTITION BY recording_id), 0.0) AS peak FROM {dst}_t),
{dst}_f AS (SELECT *, avg(cleaned_pupil) OVER f AS tonic, greatest(bc_pupil - avg(bc_pupil) OVER f, 0.0) AS phasic FROM {dst}_n
  WINDOW f AS ({ORDER} ROWS BETWEEN (fr - 1) PRECEDING AND CURRENT ROW)),
{dst} AS (SELECT recording_id, avg(bc_pupil) AS pupil_bc_mean, stddev_pop(bc_pupil) AS pupil_bc_std, max(peak) AS pupil_bc_peak,
    quantile_cont(bc_pupil, 0.75) AS pupil_bc_q75, avg(tonic) AS pupil_tonic_level, avg(phasic) AS pupil_phasic_mean,
    max(phasic) AS pupil_phasic_peak,
    coalesce(min(timestamp_ms) FILTER (peak > 0 AND bc_pupil >= 0.5 * peak) - min(t0), 0) AS pupil_dilation_latency_ms,
    avg(CAST(blink_mask AS DOUBLE)) AS pupil_blink_ratio, avg(CAST(blink_mask AS DOUBLE)) AS pupil_interpolation_ratio
  FROM {dst}_f GROUP BY 1)"""


LOAD_NUM = (
    "pupil_bc_mean pupil_bc_std pupil_bc_peak pupil_bc_q75 pupil_tonic_level pupil_phasic_mean pupil_phasic_peak "
    "pupil_dilation_latency_ms pupil_blink_ratio pupil_interpolation_ratio"
)

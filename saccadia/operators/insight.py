"""Cohort batches, anomalies and the rule-based report.

Texts are assembled per recording with column expressions; one row per recording and
section, so a report for a whole cohort is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from saccadia.functions import insight_texts as texts
from saccadia.functions.ordered import join_small, lay_out
from saccadia.operators import aoi as areas_
from saccadia.operators import events as ev
from saccadia.operators import signal as sg
from saccadia.operators.features import extract_features
from saccadia.operators.quality import fixed, quality_grade
from saccadia.schema import KEY
from saccadia.sources import readers
from saccadia.sources.readers import uri

EMPTY_RECORDING = "recording contains no samples"


def batch_analyze(
    samples: DataFrame,
    recordings: DataFrame | None = None,
    areas: Sequence[areas_.Area] | None = None,
    include_complexity: bool = False,
    preprocess_options: dict | None = None,
    event_options: dict | None = None,
    window_ms: float = 500.0,
) -> DataFrame:
    """One row per recording: features, design columns, grade, area columns, ``error``.

    ``samples`` may carry an ``error`` text; a recording with one gets an error row and
    does not disturb the others. Recordings in ``recordings`` without samples are errors too.
    """
    if "error" in samples.columns:
        errors = samples.groupBy(KEY).agg(F.max("error").alias("error")).filter("error IS NOT NULL")
        samples = join_small(samples, errors.select(KEY), KEY, "left_anti").drop("error")
    else:
        errors = None
    laid = lay_out(samples)
    clean = sg.preprocess(laid, normalize=False, **(preprocess_options or {}))
    options = event_options or {}
    label_options = {k: v for k, v in options.items() if k in ("source", "threshold", "label_column", "label_map")}
    run_options = {k: v for k, v in options.items() if k in ("min_fixation_ms", "min_blink_ms")}
    labelled = ev.label_samples(clean, **label_options)
    features = extract_features(clean, labelled, window_ms=window_ms, include_complexity=include_complexity, **run_options)
    out = features.join(quality_grade(samples).select(KEY, "quality_grade"), KEY, "left").withColumn(
        "error", F.lit(None).cast("string")
    )
    if areas:
        fixations = areas_.assign(ev.fixation_table(ev.runs_to_events(labelled, **run_options)), areas)
        names = [a.name for a in areas]
        metrics = areas_.metrics(fixations, names, features.select(KEY, "duration_ms"))
        out = out.join(areas_.wide_columns(metrics, names), KEY, "left")
    if errors is not None:
        out = out.unionByName(errors, allowMissingColumns=True)
    if recordings is not None:
        out = recordings.join(out, KEY, "full").withColumn(
            "error", F.when(F.col("sample_count").isNull() & F.col("error").isNull(), EMPTY_RECORDING).otherwise(F.col("error"))
        )
    return out


def analyze_files(
    spark: SparkSession, paths: list[str], areas: Sequence[areas_.Area] | None = None, folders: Sequence[str] = (), **options
) -> DataFrame:
    """``batch_analyze`` over files; missing and unreadable files become error rows keyed by path.

    ``folders`` stand for all files in them: the driver gets the kinds of files found there, not their names.
    """
    requested = spark.createDataFrame([(p,) for p in paths], "file_path string").select(uri("file_path").alias("file_path"))
    listed = _listed(spark, sorted({p.rsplit("/", 1)[0] for p in paths})) if paths else None
    if folders:
        inside = readers.existing_files(spark, list(folders)).select(uri("file_path").alias("file_path")).distinct()
        inside = readers.materialize(inside.withColumn("kind", F.regexp_extract("file_path", r"\.(\w+)$", 1)), "inside")
        requested = requested.join(inside, "file_path", "left_anti")
    if listed is None:
        present, missing = [], requested
    else:
        listed = listed.select(uri("file_path").alias("file_path")).distinct()
        present = [r[0] for r in requested.join(listed, "file_path", "left_semi").collect()]
        missing = requested.join(listed, "file_path", "left_anti")
    gone = missing.select(F.col("file_path").alias(KEY), F.concat(F.lit("file not found: "), "file_path").alias("error"))
    kinds = sorted(r[0] for r in inside.select("kind").distinct().collect()) if folders else []
    if "" in kinds:  # no pattern fits only names without an ending
        present += [r[0] for r in inside.filter("kind = ''").select("file_path").collect()]
        kinds.remove("")
    if not present and not kinds:
        return gone
    by_format: dict[str, list[str]] = {}
    for p in present:
        by_format.setdefault(readers.file_format(p, None), []).append(p)
    parts, broken, read = [], [], []
    for name, files in by_format.items():
        try:
            parts.append(readers.read_recordings(spark, files, name, strict=False))
        except ValueError as e:
            broken += [(f, str(e)) for f in files]
    for kind in kinds:
        ours = inside.filter(F.col("kind") == kind).select(F.col("file_path").alias(KEY))
        try:
            parts.append(readers.read_recordings(spark, list(folders), readers.file_format(f".{kind}", kind), strict=False, pattern=f"*.{kind}"))
            read.append(ours)
        except ValueError as e:
            gone = gone.union(ours.withColumn("error", F.lit(str(e))))
    if broken:
        gone = gone.union(spark.createDataFrame(broken, gone.schema))
    if not parts:
        return gone
    samples = parts[0]
    for part in parts[1:]:
        samples = samples.unionByName(part)
    done = {f for f, _ in broken}
    rows = spark.createDataFrame([(p,) for p in present if p not in done], f"{KEY} string")
    for ours in read:
        rows = rows.union(ours)
    samples = readers.materialize(samples.withColumn(KEY, uri(KEY)), "samples")  # else each step that reads them opens all files
    return batch_analyze(samples, rows, areas, **options).unionByName(gone, allowMissingColumns=True)


def _listed(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    """Files of the folders that exist: all at once, and by halves where one is missing."""
    try:
        return readers.existing_files(spark, folders)
    except AnalysisException:
        if len(folders) == 1:
            return None
    middle = len(folders) // 2
    halves = [h for h in (_listed(spark, folders[:middle]), _listed(spark, folders[middle:])) if h is not None]
    return halves[0].union(halves[1]) if len(halves) == 2 else (halves[0] if halves else None)


def successful_rows(batch: DataFrame) -> DataFrame:
    return batch.filter(F.trim(F.coalesce("error", F.lit(""))) == "")


def _limit(spec: dict, name: str) -> Column:
    return F.lit(float(spec[name]) if name in spec else None).cast("double")


def feature_anomalies(features: DataFrame) -> DataFrame:
    """Rows for features outside their range, with direction, severity and reference text."""
    specs = {k: v for k, v in texts.THRESHOLDS.items() if k in features.columns}
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("feature_order"),
                F.lit(name).alias("feature"),
                F.col(name).cast("double").alias("value"),
                *[_limit(s, n).alias(n) for n in ("critical_low", "low", "high", "critical_high")],
                F.lit(s["unit"]).alias("unit"),
                F.lit(s["desc"]).alias("desc"),
            )
            for k, (name, s) in enumerate(specs.items())
        ]
    )
    df = features.select(KEY, F.inline(rows)).filter(F.col("value").isNotNull())
    v = F.col("value")
    hit = (
        F.when(v < F.col("critical_low"), "low critical")
        .when(v < F.col("low"), "low warning")
        .when(v > F.col("critical_high"), "high critical")
        .when(v > F.col("high"), "high warning")
    )
    df = df.withColumn("_hit", F.split(hit, " ")).filter("_hit IS NOT NULL")
    return df.select(
        KEY,
        "feature_order",
        "feature",
        "value",
        F.col("_hit")[0].alias("direction"),
        F.col("_hit")[1].alias("severity"),
        F.concat("desc", F.lit("，实测 "), fixed(v, 2), "unit").alias("threshold_ref"),
    )


def anomaly_hypotheses(features: DataFrame) -> DataFrame:
    """Hypothesis text and recommendations per recording; recordings without anomalies say so."""
    found = feature_anomalies(features)
    rule = F.concat_ws("|", "feature", "direction")

    def lookup(which):
        pairs = [(f"{f}|{d}", texts_[which]) for (f, d), texts_ in texts.ANOMALY_RULES.items() if texts_[which]]
        return F.create_map(*[F.lit(x) for p in pairs for x in p])[rule]

    row = F.struct(
        "feature_order", "feature", "value", "direction", "severity", "threshold_ref",
        lookup(0).alias("hypothesis"), lookup(1).alias("recommendation"),
    )
    # at most one row per feature and recording, so the list is short
    listed = found.groupBy(KEY).agg(F.array_sort(F.collect_list(row)).alias("anomalies"))
    df = features.select(KEY).join(listed, KEY, "left")

    def parts(field):
        return F.filter(F.transform("anomalies", lambda a: a[field]), lambda t: t.isNotNull())

    critical = F.exists("anomalies", lambda a: a["severity"] == "critical")
    text = F.concat(
        F.when(critical, texts.SEVERITY_TEXT["critical"]).otherwise(texts.SEVERITY_TEXT["warning"]),
        F.lit("（"), F.concat_ws("、", parts("feature")), F.lit("）。"), F.concat_ws("；", parts("hypothesis")), F.lit("。"),
    )
    none = F.array().cast("array<string>")
    return df.select(
        KEY,
        F.when(F.col("anomalies").isNull(), texts.NO_ANOMALY).otherwise(text).alias("hypothesis"),
        F.when(F.col("anomalies").isNull(), none).otherwise(parts("recommendation")).alias("recommendations"),
        "anomalies",
    )


def value_text(name: str, value: Column) -> Column:
    digits, suffix = texts.VALUE_FORMATS.get(name, (2, ""))
    scaled = value * 100.0 if suffix == "%" else value
    return F.concat(fixed(scaled, digits), F.lit(suffix))


def metric_label(name: str, lang: str) -> str:
    return texts.METRIC_LABELS[lang].get(name, name)


def metric_level(name: str, value: Column) -> Column:
    spec = texts.THRESHOLDS[name]
    low, high = (texts.POOR_RATIO, texts.GOOD_RATIO) if name == "valid_ratio" else (spec["low"], spec["high"])
    return F.when(value < low, "low").when(value > high, "high").otherwise("normal")


def interpret_metric(name: str, value: Column, lang: str = "zh") -> Column:
    """Sentence on a metric's level; names without limits get the plain value."""
    label = metric_label(name, lang)
    known = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if name not in texts.THRESHOLDS:
        if lang == "en":
            text = F.concat(F.lit(f"{label} is "), fixed(known, 2), F.lit(", with no built-in heuristic threshold."))
        else:
            text = F.concat(F.lit(f"{label}为"), fixed(known, 2), F.lit("，当前未内置通用阈值。"))
    else:
        level = metric_level(name, known)
        meanings = texts.MEANINGS[lang].get(name, {})

        def pick(words):
            return F.coalesce(*[F.when(level == k, F.lit(words.get(k, ""))) for k in ("low", "normal", "high")])

        pieces = (" is ", ", which is ", ". ") if lang == "en" else ("为", "，", "。")
        text = F.concat(
            F.lit(label + pieces[0]), value_text(name, known), F.lit(pieces[1]), pick(texts.LEVELS[lang]), F.lit(pieces[2]), pick(meanings)
        )
    missing = f"{label} is unavailable." if lang == "en" else f"{label}暂无可解释数值。"
    return F.when(known.isNull(), missing).otherwise(text)


def interpret_metrics(features: DataFrame, names: Sequence[str], lang: str = "zh") -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                (metric_level(n, F.col(n)) if n in texts.THRESHOLDS else F.lit(None).cast("string")).alias("level"),
                interpret_metric(n, F.col(n).cast("double"), lang).alias("text"),
            )
            for n in names
        ]
    )
    return features.select(KEY, F.inline(rows))


def quality_note(ratio: Column, lang: str = "zh", grade: Column | None = None) -> Column:
    """Sentence on tracking ratio and grade, ending by how far the data can be trusted."""
    names = texts.GRADE_NAMES[lang]
    own = F.when(ratio.isNull(), texts.UNKNOWN_GRADES[lang])
    for least, name in zip((0.9, 0.75, 0.5), names):
        own = own.when(ratio >= least, name)
    own = own.otherwise(names[3])
    shown = own if grade is None else F.coalesce(grade, own)
    tails = texts.QUALITY_TAILS[lang]
    tail = F.when(ratio < texts.POOR_RATIO, tails["poor"]).when(ratio >= texts.GOOD_RATIO, tails["good"]).otherwise(tails["usable"])
    a, b, c = texts.QUALITY_LINE[lang]
    u, v = texts.QUALITY_UNKNOWN[lang]
    known = F.concat(F.lit(a), value_text("valid_ratio", ratio), F.lit(b), shown, F.lit(c), tail)
    return F.when(ratio.isNull(), F.concat(F.lit(u), shown, F.lit(v))).otherwise(known)


def overview_text(context: dict | None, lang: str) -> str:
    """The study described by its scenario; the same for every recording."""
    context = context or {}
    values = [
        context.get("name") or context.get("scenario_name"),
        context.get("product"),
        context.get("design_type") or context.get("design") or context.get("research_design_type"),
    ]
    values = [str(v).strip() if v is not None and str(v).strip().lower() != "nan" else "" for v in values]
    if not any(values):
        return texts.OVERVIEW_DEFAULT[lang]
    name, plain, product, design = texts.OVERVIEW_PARTS[lang]
    parts = [name.format(value=values[0]) if values[0] else plain]
    parts += [t.format(value=v) for t, v in ((product, values[1]), (design, values[2])) if v]
    joint, stop = texts.OVERVIEW_JOIN[lang]
    return joint.join(parts) + stop


def _lines(parts: list[Column], joint: str = "\n") -> Column:
    """Texts that are present, joined."""
    return F.concat_ws(joint, F.filter(F.array(*parts), lambda t: t.isNotNull()))


def _feature_body(columns: list[str], lang: str) -> Column:
    lines = []
    for name in texts.FEATURE_ORDER:
        if name not in columns:
            continue
        v = F.col(name).cast("double")
        if name in texts.FEATURE_LINES[lang]:
            before, after = texts.FEATURE_LINES[lang][name]
            text = F.concat(F.lit(before), value_text(name, v), F.lit(after))
        else:
            text = F.concat(F.lit("- "), interpret_metric(name, v, lang))
        lines.append(F.when(v.isNotNull(), text))
    body = _lines(lines) if lines else F.lit("")
    return F.when(body == "", texts.NO_FEATURES[lang]).otherwise(body)


def _aoi_body(lang: str) -> Column:
    d, f, r = texts.AOI_DWELL[lang], texts.AOI_FIRST[lang], texts.AOI_REVISIT[lang]
    dwell = F.concat(
        F.lit(d[0]), "top_dwell", F.lit(d[1]), fixed(F.col("top_dwell_ms"), 1), F.lit(d[2]),
        fixed(F.col("top_dwell_prop") * 100.0, 1), F.lit("%" + d[3]),
    )
    first = F.concat(F.lit(f[0]), "fastest", F.lit(f[1]), fixed(F.col("fastest_ms"), 1), F.lit(f[2]))
    revisit = F.when(
        F.col("top_revisits") > 0, F.concat(F.lit(r[0]), "top_revisit", F.lit(r[1]), F.col("top_revisits").cast("string"), F.lit(r[2]))
    )
    return F.when(F.col("top_dwell").isNull(), texts.NO_AOI[lang]).otherwise(_lines([dwell, first, revisit], texts.SENTENCE_JOIN[lang]))


def _recommendation_body(columns: list[str], with_areas: bool, lang: str) -> Column:
    say = texts.RECOMMENDATIONS[lang]

    def value(name):
        return F.col(name).cast("double") if name in columns else F.lit(None).cast("double")

    def limit(name, which):
        return texts.THRESHOLDS[name][which]

    fixation = value("fixation_duration_mean")
    found = [
        F.when(value("valid_ratio") < texts.POOR_RATIO, say["poor_ratio"]),
        F.when(fixation > limit("fixation_duration_mean", "high"), say["long_fixations"]).when(
            fixation < limit("fixation_duration_mean", "low"), say["short_fixations"]
        ),
        F.when(value("blink_rate_hz") > limit("blink_rate_hz", "high"), say["blinks"]),
        F.when(value("saccade_amplitude_mean") > limit("saccade_amplitude_mean", "high"), say["wide_saccades"]),
    ]
    if with_areas:
        a, b = say["revisits"]
        found.append(F.when(F.col("top_revisits") > 0, F.concat(F.lit(a), "top_revisit", F.lit(b))))
        a, b = say["slow_entry"]
        found.append(F.when(F.col("slow_entry"), F.concat(F.lit(a), "slowest", F.lit(b))))
    present = F.filter(F.array(*found), lambda t: t.isNotNull())
    few = F.when(F.size(present) < 2, F.array(F.lit(say["triangulate"]), F.lit(say["iterate"]))).otherwise(F.array(F.lit(say["iterate"])))
    chosen = F.slice(F.concat(present, few), 1, 3)
    return F.concat_ws("\n", F.transform(chosen, lambda t: F.concat(F.lit("- "), t)))


def _anomaly_body(lang: str) -> Column:
    words = texts.ANOMALY_SECTION[lang]

    def line(a):
        severity = F.when(a["severity"] == "critical", words["critical"]).otherwise(words["warning"])
        direction = F.when(a["direction"] == "high", words["high"]).otherwise(words["low"])
        return F.concat(
            F.lit("- `"), a["feature"], F.lit("` = "), fixed(a["value"], 3), F.lit("  ["), severity, F.lit(" · "), direction,
            F.lit("]  "), a["threshold_ref"],
        )

    advice = F.when(
        F.size("recommendations") > 0,
        F.concat(
            F.lit("\n\n" + words["recommendations"] + "\n"),
            F.concat_ws("\n", F.transform("recommendations", lambda r: F.concat(F.lit("- "), r))),
        ),
    ).otherwise("")
    body = F.concat(
        F.lit(words["found"] + "\n"), F.concat_ws("\n", F.transform("anomalies", line)), F.lit("\n\n" + words["hypothesis"] + "  "),
        "hypothesis", advice, F.lit("\n\n\n" + texts.ANOMALY_SOURCE),
    )
    return F.when(F.col("anomalies").isNull(), words["none"]).otherwise(body)


def statistics_body(results: DataFrame, lang: str) -> DataFrame:
    """One text for the study's test results, a row per metric (few, named by the caller)."""
    joint = (": ", ". ") if lang == "en" else ("：", "。")
    line = F.concat(F.lit("- "), "test_name", F.lit(joint[0]), "apa", F.lit(joint[1]), "conclusion")
    listed = results.agg(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))).alias("_l"))
    return listed.select(F.concat_ws("\n", F.transform("_l", lambda e: e["line"])).alias("_statistics"))


def insight_sections(
    features: DataFrame,
    context: dict | None = None,
    results: DataFrame | None = None,
    area_metrics: DataFrame | None = None,
    explain_anomalies: bool = False,
    lang: str = "zh",
) -> DataFrame:
    """The report of every recording, one row per section in order.

    ``results`` are the study's tests, shown in each report; ``quality_grade`` is taken from
    the features if there.
    """
    lang = "en" if str(lang).strip().lower() == "en" else "zh"
    columns = features.columns
    df = features
    if area_metrics is not None:
        df = df.join(areas_.highlights(area_metrics), KEY, "left")
    if results is not None:
        # one row of text for all recordings
        text = statistics_body(results, lang).first()["_statistics"]
        statistics = F.lit(text or texts.NO_STATISTICS[lang])
    else:
        statistics = F.lit(texts.NO_STATISTICS[lang])
    if explain_anomalies:
        df = df.join(anomaly_hypotheses(features), KEY, "left")
    grade = F.col("quality_grade") if "quality_grade" in columns else None
    ratio = F.col("valid_ratio").cast("double") if "valid_ratio" in columns else F.lit(None).cast("double")
    bodies = {
        "overview": F.lit(overview_text(context, lang)),
        "quality": quality_note(ratio, lang, grade),
        "features": _feature_body(columns, lang),
        "statistics": statistics,
        "aoi": _aoi_body(lang) if area_metrics is not None else F.lit(texts.NO_AOI[lang]),
        "recommendation": _recommendation_body(columns, area_metrics is not None, lang),
    }
    if explain_anomalies:
        bodies["anomaly_explanation"] = _anomaly_body(lang)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("section_order"), F.lit(name).alias("section"), F.lit(texts.HEADINGS[lang][name]).alias("heading"), body.alias("body"))
            for k, (name, body) in enumerate(bodies.items(), 1)
        ]
    )
    return df.select(KEY, F.inline(rows))

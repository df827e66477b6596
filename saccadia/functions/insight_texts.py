"""Wording of the rule-based report, in Chinese and English.

Fixed values throughout: reports are compared by their text.
"""

LANGUAGES = ("zh", "en")

# limits per feature, in the order features are reported; absent limits never apply
THRESHOLDS = {
    "valid_ratio": {"critical_low": 0.5, "low": 0.75, "unit": "", "desc": "建议 ≥ 0.75"},
    "fixation_count": {"critical_low": 3, "low": 5, "high": 100, "unit": "次", "desc": "正常范围 5–100 次"},
    "fixation_duration_mean": {"critical_low": 80, "low": 150, "high": 400, "critical_high": 600, "unit": "ms", "desc": "正常范围 150–400 ms"},
    "saccade_count": {"low": 2, "high": 80, "unit": "次", "desc": "正常范围 2–80 次"},
    "saccade_amplitude_mean": {"low": 2.0, "high": 8.0, "critical_high": 12.0, "unit": "°", "desc": "正常范围 2–8°"},
    "blink_rate_hz": {"low": 0.1, "high": 0.4, "critical_high": 0.6, "unit": "Hz", "desc": "正常范围 0.1–0.4 Hz"},
    "blink_duration_mean": {"high": 400, "critical_high": 600, "unit": "ms", "desc": "正常 < 400 ms"},
    "pupil_change_rate": {"high": 0.3, "critical_high": 0.5, "unit": "", "desc": "正常 < 0.3"},
}
POOR_RATIO, GOOD_RATIO = 0.5, 0.9

# (feature, direction) -> hypothesis, recommendation
ANOMALY_RULES = {
    ("valid_ratio", "low"): ("有效追踪率不足，数据可信度降低", "检查眼动仪标定质量，确认用户坐姿与距离"),
    ("fixation_count", "low"): ("注视次数过少，用户可能快速跳过或放弃探索", "检查关键功能入口的视觉显著性"),
    ("fixation_duration_mean", "low"): ("注视时长过短，可能存在浏览式扫读或注意力分散", "检查界面信息密度，考虑减少单屏内容量"),
    ("fixation_duration_mean", "high"): ("注视时长过长，可能存在认知困惑或信息处理负荷高", "简化当前界面元素的视觉复杂度"),
    ("saccade_amplitude_mean", "low"): ("扫视幅度偏小，注意力局限在局部区域", None),
    ("saccade_amplitude_mean", "high"): ("扫视幅度偏大，注意力在界面大范围跳跃", "优化视觉引导路径，减少跨区域跳转"),
    ("blink_rate_hz", "low"): ("眨眼频率偏低，用户高度专注或存在视觉搜索困难", None),
    ("blink_rate_hz", "high"): ("眨眼频率偏高，提示疲劳或认知负荷较大", "考虑增加任务间隔或降低视觉刺激强度"),
    ("pupil_change_rate", "high"): ("瞳孔变化率异常，认知负荷可能较高", "考虑拆分当前任务步骤，降低单步认知压力"),
}
NO_ANOMALY = "各项眼动指标处于正常范围，未检测到明显异常。"
SEVERITY_TEXT = {"critical": "存在严重异常指标", "warning": "存在轻度异常指标"}

HEADINGS = {
    "zh": {
        "overview": "实验概览", "quality": "数据质量", "features": "核心指标摘要", "statistics": "统计检验结果",
        "aoi": "AOI 分析摘要", "recommendation": "建议", "anomaly_explanation": "认知状态异常解读",
    },
    "en": {
        "overview": "Study Overview", "quality": "Data Quality", "features": "Feature Summary", "statistics": "Statistical Results",
        "aoi": "AOI Summary", "recommendation": "Recommendations", "anomaly_explanation": "Cognitive State Analysis",
    },
}
METRIC_LABELS = {
    "zh": {
        "valid_ratio": "有效追踪率", "fixation_count": "注视次数", "fixation_duration_mean": "平均注视时长", "saccade_count": "扫视次数",
        "saccade_amplitude_mean": "平均扫视幅度", "blink_rate_hz": "眨眼频率", "pupil_baseline": "瞳孔基线",
    },
    "en": {
        "valid_ratio": "Valid tracking ratio", "fixation_count": "Fixation count", "fixation_duration_mean": "Mean fixation duration",
        "saccade_count": "Saccade count", "saccade_amplitude_mean": "Mean saccade amplitude", "blink_rate_hz": "Blink rate",
        "pupil_baseline": "Pupil baseline",
    },
}
LEVELS = {"zh": {"low": "偏低", "normal": "正常", "high": "偏高"}, "en": {"low": "low", "normal": "normal", "high": "high"}}
MEANINGS = {
    "zh": {
        "fixation_duration_mean": {"low": "视觉加工停留较短，可能更偏向快速浏览。", "normal": "信息提取节奏相对平衡。", "high": "用户可能需要更长时间理解局部内容。"},
        "blink_rate_hz": {"low": "任务节奏整体稳定，中断较少。", "normal": "眨眼节律处于常见观察范围。", "high": "可能存在疲劳上升或认知负荷偏高的情况。"},
        "valid_ratio": {"low": "数据质量偏弱，解读时需保持谨慎。", "normal": "数据整体可用，但仍有一定缺失。", "high": "追踪质量稳定，适合进一步解释。"},
        "saccade_amplitude_mean": {"low": "视觉搜索主要集中在较紧凑的局部区域。", "normal": "视线搜索跨度处于中等范围。", "high": "注意力切换覆盖了更大的界面空间。"},
    },
    "en": {
        "fixation_duration_mean": {
            "low": "Visual processing appears brief and possibly scan-oriented.", "normal": "Visual processing tempo is relatively balanced.",
            "high": "Participants may need more time to interpret local content.",
        },
        "blink_rate_hz": {
            "low": "Task pacing appears stable and interruption is limited.", "normal": "Blink rhythm remains within a typical observation band.",
            "high": "Fatigue or cognitive load may be elevated.",
        },
        "valid_ratio": {
            "low": "Data quality is weak and interpretation should stay cautious.", "normal": "Data quality is usable with some missingness.",
            "high": "Tracking quality is stable enough for interpretation.",
        },
        "saccade_amplitude_mean": {
            "low": "Visual search stays within a relatively compact area.", "normal": "Search span is within a moderate range.",
            "high": "Attention shifts cover a wide spatial range across the interface.",
        },
    },
}
# format of a metric's value: decimals and suffix (percent values are scaled first)
VALUE_FORMATS = {
    "valid_ratio": (1, "%"), "fixation_duration_mean": (1, " ms"), "blink_rate_hz": (2, " Hz"), "saccade_amplitude_mean": (2, " deg"),
    "fixation_count": (0, ""), "saccade_count": (0, ""), "pupil_baseline": (2, ""),
}
GRADE_NAMES = {"zh": ["优", "良", "可用", "建议剔除"], "en": ["excellent", "good", "usable", "poor"]}
UNKNOWN_GRADES = {"zh": "未知", "en": "unknown"}

OVERVIEW_DEFAULT = {
    "zh": "本次报告面向单次眼动分析，聚焦整体注意分配、数据质量与可设计改进点。",
    "en": "This report summarizes a single eye-tracking analysis and highlights the most actionable attention and usability patterns.",
}
# {value} is replaced; the second text stands for a missing scenario name
OVERVIEW_PARTS = {
    "zh": ("本次分析基于“{value}”场景", "本次分析基于单次眼动分析", "产品对象为{value}", "研究设计类型为{value}"),
    "en": (
        'This report is based on the "{value}" scenario', "This report is based on a single eye-tracking analysis",
        "for the product {value}", "under a {value} research design",
    ),
}
OVERVIEW_JOIN = {"zh": ("，", "。"), "en": (" ", ".")}

QUALITY_TAILS = {
    "zh": {
        "poor": "数据缺失较多，后续结论应谨慎解释。", "usable": "整体数据可用，但仍存在一定缺失，需要结合任务上下文解读。",
        "good": "追踪稳定性较好，可支持后续行为与界面解读。",
    },
    "en": {
        "poor": "The data loss is substantial, so downstream interpretation should be conservative.",
        "usable": "The data is usable overall, although a small amount of missingness remains.",
        "good": "Tracking stability is strong enough to support downstream interpretation.",
    },
}
# pieces around: ratio text, grade
QUALITY_LINE = {"zh": ("有效追踪率为", "，质量等级为“", "”。"), "en": ("Valid tracking ratio is ", ', with quality grade "', '". ')}
QUALITY_UNKNOWN = {
    "zh": ("当前质量等级为“", "”，但未提供有效追踪率，建议结合原始采样日志复核。"),
    "en": ('Quality grade is "', '", but no valid tracking ratio was provided.'),
}

# feature lines: text before and after the number
FEATURE_LINES = {
    "zh": {
        "fixation_count": ("- 注视次数：", " 次，反映任务过程中形成稳定视觉停留的频次。"),
        "pupil_baseline": ("- 瞳孔基线：", "，可作为后续认知负荷变化的基线参照。"),
    },
    "en": {
        "fixation_count": ("- Fixation count: ", ". This reflects how often the participant established stable visual anchors during the task."),
        "pupil_baseline": ("- Pupil baseline: ", ". This value can serve as a reference for later workload-related pupil changes."),
    },
}
FEATURE_ORDER = ["fixation_count", "fixation_duration_mean", "saccade_count", "blink_rate_hz", "pupil_baseline", "saccade_amplitude_mean"]
NO_FEATURES = {"zh": "未提供可用于解释的核心特征指标。", "en": "No core feature metrics were provided."}
NO_STATISTICS = {"zh": "暂无统计检验结果。", "en": "No statistical test results are available yet."}
NO_AOI = {
    "zh": "暂无 AOI 指标，暂时无法进一步总结区域级注意分配。",
    "en": "No AOI-level metrics are available, so regional attention allocation cannot be summarized.",
}
# pieces around: area, dwell, share / area, TTFF / area, revisits
AOI_DWELL = {
    "zh": ("用户注意力主要集中在“", "”区域，累计驻留 ", " ms，约占总驻留的 ", "。"),
    "en": ('Attention is concentrated most on "', '" (', " ms dwell, ", " of total dwell)."),
}
AOI_FIRST = {
    "zh": ("首次注意最早落在“", "”区域（TTFF ", " ms）。"),
    "en": ('The earliest first fixation landed on "', '" (TTFF ', " ms)."),
}
AOI_REVISIT = {
    "zh": ("“", "”的回视次数最高（", " 次），可能存在信息核对或理解阻塞。"),
    "en": ('"', '" shows the highest revisit count (', "), which may indicate repeated confirmation or local comprehension friction."),
}
SENTENCE_JOIN = {"zh": "", "en": " "}

RECOMMENDATIONS = {
    "zh": {
        "poor_ratio": "先优化采集环境与校准流程，避免数据缺失过高影响后续解释。",
        "long_fixations": "平均注视时长偏高，建议简化信息层级、减少需要长时间停留理解的界面元素。",
        "short_fixations": "平均注视时长偏低，建议强化关键内容的视觉强调，避免用户过快扫过重要信息。",
        "blinks": "眨眼频率偏高，可优先检查任务负荷、文本密度或操作步骤是否过于紧张。",
        "wide_saccades": "扫视跨度偏大，建议加强版面分组与关键控件聚合，降低跨区域搜索成本。",
        "revisits": ("优先优化“", "”区域的信息层级或标签表达，减少反复确认。"),
        "slow_entry": ("“", "”较晚才获得首次注意，建议提升其入口可见性或前置提示。"),
        "triangulate": "建议结合任务完成率、主观量表或访谈结果做交叉验证，以确认眼动模式背后的真实原因。",
        "iterate": "建议在下一轮迭代中保留关键视觉层级的一致性，再针对高摩擦区域做定点优化。",
    },
    "en": {
        "poor_ratio": "Improve calibration and capture conditions first, because severe data loss weakens downstream interpretation.",
        "long_fixations": "Mean fixation duration is elevated; consider simplifying the information hierarchy and reducing elements that require prolonged inspection.",
        "short_fixations": "Mean fixation duration is low; strengthen visual emphasis for critical information so it is not skimmed too quickly.",
        "blinks": "Blink rate is elevated; review task load, text density, or interaction pacing for potential overload.",
        "wide_saccades": "Saccade amplitude is high; improve grouping and cluster key controls to reduce cross-screen search cost.",
        "revisits": ('Prioritize clearer hierarchy or labeling in "', '" to reduce repeated checking.'),
        "slow_entry": ('"', '" receives attention late; increase its visual discoverability or introduce earlier cues.'),
        "triangulate": "Triangulate these findings with task success, subjective ratings, or interviews to validate the underlying causes.",
        "iterate": "Keep the core visual hierarchy stable in the next iteration, then target the highest-friction areas for refinement.",
    },
}
ANOMALY_SECTION = {
    "zh": {
        "none": "各项眼动指标均处于正常参考范围，未检测到显著异常。", "found": "**检测到的异常特征：**", "hypothesis": "**认知状态假说：**",
        "recommendations": "**UX 改进建议：**", "warning": "⚠ 轻度异常", "critical": "🔴 严重异常", "high": "偏高", "low": "偏低",
    },
    "en": {
        "none": "All features are within normal reference ranges.", "found": "**Detected Anomalies:**", "hypothesis": "**Cognitive State Hypothesis:**",
        "recommendations": "**UX Recommendations:**", "warning": "⚠ Warning", "critical": "🔴 Critical", "high": "High", "low": "Low",
    },
}
ANOMALY_SOURCE = "*解读来源：rule_based*"

"""Mapping of eye-tracker event labels to event kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label aliases and the event kind each stands for, in matching order.
EVENT_LABELS = {
    "fixation": "fixation",
    "fix": "fixation",
    "fix_start": "fixation",
    "fix_end": "fixation",
    "saccade": "saccade",
    "sac": "saccade",
    "sacc": "saccade",
    "saccade_start": "saccade",
    "saccade_end": "saccade",
    "blink": "blink",
    "bl": "blink",
    "blink_start": "blink",
    "blink_end": "blink",
    "smooth_pursuit": "smooth_pursuit",
    "pursuit": "smooth_pursuit",
    "sp": "smooth_pursuit",
}


def event_kind(label: Column, label_map: dict[str, str] | None = None) -> Column:
    """Kind for a raw label: exact alias, else the first alias found inside it, else the label itself."""
    known = EVENT_LABELS | {k.lower(): v for k, v in (label_map or {}).items()}
    text = F.lower(F.trim(label))
    exact = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])[text]
    contained = F.coalesce(*[F.when(text.contains(alias), F.lit(kind)) for alias, kind in known.items()])
    return F.when(text != "", F.coalesce(exact, contained, text))

"""Stored settings over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.model import SETTING_DEFAULTS, SETTINGS_SCHEMA


def resolve_settings(requests: DataFrame, settings: DataFrame, key: str = "req_id") -> DataFrame:
    """Every setting per request: the stored value, else the default."""
    types = {field.name: field.dataType for field in SETTINGS_SCHEMA}
    resolved = []
    for name, default in SETTING_DEFAULTS.items():
        fallback = F.lit(default).cast(types[name])
        stored = F.col(name).cast(types[name]) if name in settings.columns else None
        resolved.append((fallback if stored is None else F.coalesce(stored, fallback)).alias(name))
    # a row per request, far smaller in its files than in memory: never a broadcast
    return requests.join(settings.hint("merge"), key, "left").select(*requests.columns, *resolved)

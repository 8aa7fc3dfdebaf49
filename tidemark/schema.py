"""Column roles, time frames and the run configuration."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import types as T

TICKS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType()), T.StructField("value", T.DoubleType()),
])

# Minutes of each time frame name; any other name counts as 5.
MINUTES = {
    "1min": 1, "5min": 5, "15min": 15, "30min": 30, "1H": 60, "2H": 120, "4H": 240, "6H": 360, "8H": 480, "12H": 720,
    "1D": 1440, "3D": 4320, "1W": 10080,
}

# Parts of names that are never features.
NOT_FEATURES = ("_label", "_barrier_touched", "_touch_time", "_return", "_holding_hours", "_event", "event_type", "any_event")

# Default parameters of indicators, events, barriers and costs.
DEFAULTS: dict[str, Any] = {
    "ema": [12, 26, 50], "sma": [20, 50, 200], "rsi": 14, "macd": [12, 26, 9], "bollinger": {"n": 20, "k": 2.0}, "atr": 14,
    "cusum": {"threshold": 2.0, "drift": 0.5, "reset": 100},
    "bb_events": {"lookback": 3, "min_distance": 1.0},
    "events": {"corr": 0.7, "breakout": 2.0, "lookback": 100, "outlier": 2.5, "momentum": 0.3},
    "covents": {"window": 2, "max": 50},
    "periods": {"intraday": {"short": 12, "medium": 26, "long": 50}, "hourly": {"short": 6, "medium": 24, "long": 72}, "daily": {"short": 5, "medium": 20, "long": 50}},
    "barriers": {"vol_mult": 2.0, "stop_mult": 1.2, "holding_days": 1.0, "min_rr": 1.5, "volume": True, "regime": True, "theory": True, "profit_take": 0.02, "stop_loss": 0.015},
    "costs": {"fee": 0.0026, "spread": 0.0005, "slippage": 0.0003, "funding": 0.00005, "multiplier": 2.5},
}

# The base events in their order, and the combinations that are looked for first.
EVENTS = ("vpd_event", "outlier_event", "momentum_event", "cusum_flag", "bb_upper_cross", "bb_lower_cross", "bb_middle_up", "bb_middle_down", "bb_squeeze", "bb_expansion")
PAIRS = (
    ("cusum_flag", "bb_upper_cross"), ("cusum_flag", "bb_lower_cross"), ("vpd_event", "momentum_event"), ("outlier_event", "bb_expansion"),
    ("momentum_event", "bb_squeeze"), ("vpd_event", "outlier_event"), ("bb_upper_cross", "momentum_event"), ("bb_lower_cross", "momentum_event"),
)
TRIPLES = (
    ("cusum_flag", "vpd_event", "momentum_event"), ("bb_upper_cross", "outlier_event", "momentum_event"), ("bb_lower_cross", "outlier_event", "momentum_event"),
    ("vpd_event", "outlier_event", "momentum_event"), ("cusum_flag", "bb_expansion", "momentum_event"),
)


def minutes(frame: str) -> int:
    return MINUTES.get(frame, 5)


def config(over: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults with `over` merged in at every level."""

    def merge(a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = merge(dict(a[k]), v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v
        return a

    return merge(copy.deepcopy(DEFAULTS), over or {})


def is_label(name: str) -> bool:
    return name.endswith("_label")


def is_event(name: str) -> bool:
    return name != "event_type" and any(p in name for p in ("_event", "covent", "any_event"))


def features(schema: T.StructType) -> list[str]:
    """Numeric columns whose names hold none of the reserved parts."""
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and not any(p in f.name for p in NOT_FEATURES)]


def frames_of(columns: list[str]) -> list[str]:
    """Higher time frames whose columns are there, the shortest first."""
    return sorted((f for f in MINUTES if f"{f}_close" in columns), key=minutes)


def validate(columns: list[str], low: str | None = None) -> None:
    """OHLCV columns are needed, of the base bars or of the low frame."""
    base = [c for c in ("open", "high", "low", "close", "volume") if c not in columns]
    if base and (low is None or any(f"{low}_{c}" not in columns for c in ("open", "high", "low", "close", "volume"))):
        raise ValueError(f"missing columns: {base}")


def detect_frame(seconds: float | None) -> str:
    """Name of the step between the first two times."""
    if seconds is None:
        return "unknown"
    for size, unit in ((60, "s"), (3600, "min"), (86400, "H")):
        if seconds < size:
            n = seconds if unit == "s" else seconds * (1 / (size / 60 if unit == "min" else size / 24))
            return f"{n:.0f}{unit}" if n == int(n) else f"{n:.1f}{unit}"
    n = seconds / 86400
    return f"{n:.0f}D" if n == int(n) else f"{n:.1f}D"

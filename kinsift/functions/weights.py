"""Feature weights: parsing, normalising, blending."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ("semantic", "levenshtein", "jaro_winkler", "winnowing", "gst", "code_metric")
DEFAULTS = {"semantic": 0.7, "levenshtein": 0.3, "jaro_winkler": 0.0}


def parse_weights(given: dict | str | list | None = None, extra: tuple[str, ...] = ()) -> dict[str, float]:
    """Weights that sum to 1 (or are all 0) from a dict, "a=1,b=2" or a list of such items."""
    if given is None:
        items = dict(DEFAULTS)
    elif isinstance(given, dict):
        items = dict(given)
    else:
        parts = given.split(",") if isinstance(given, str) else list(given)
        pairs = [str(p).partition("=") for p in parts if str(p).strip()]
        if any(not sep for _, sep, _ in pairs):
            raise ValueError("weights are written name=value")
        items = {name.strip(): value for name, _, value in pairs}
    out = {}
    for name, value in items.items():
        if name not in FEATURES and name not in extra:
            raise ValueError(f"Unsupported feature name: {name}")
        number = float(value)
        if not math.isfinite(number) or number < 0:
            raise ValueError(f"weights are finite and not negative: {name}")
        out[name] = number
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else out


def check_scales(weights: dict[str, float], function: str, normalized: bool) -> None:
    """Unbounded semantic scores can't be blended with other features."""
    active = [k for k, v in weights.items() if v > 0]
    if "semantic" in active and len(active) > 1 and function != "cosine" and not normalized:
        raise ValueError(f"{function} scores must be normalised before they are blended")


def blend(weights: dict[str, float], columns: dict[str, Column]) -> Column:
    """The weighted sum; features of weight 0 are never computed."""
    parts = [columns[k] * F.lit(w) for k, w in weights.items() if w > 0]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

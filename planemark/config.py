"""Settings of a run: one flat dict with defaults, and column names by table."""

from __future__ import annotations

import copy
from typing import Any

# The names and defaults that callers rely on.
DEFAULTS: dict[str, Any] = {
    "property_filter": None,
    "prospect_filter": None,
    "hole_filter": None,
    "exclude_low_recovery": False,
    "low_recovery_col": "LowRecovery_<=85pct",
    "score_columns": ["Ag_ppm", "Pb_pct", "Zn_pct"],
    "log_transform_score": True,
    "active_score_quantile": 0.85,
    "radius_m": 120.0,
    "min_neighbors": 100,
    "distance_sigma_m": 80.0,
    "exclude_same_hole_neighbors": True,
    "min_holes": 3,
    "decluster_by_hole": True,
    "estimator": "shape_pca",
    "lsq_ridge": 1e-3,
    "min_sampling_conditioning": 0.0,
    "columns": {
        "samples": {"hole": None, "from": None, "to": None},
        "points": {"hole": None, "from": None, "to": None, "easting": None, "northing": None, "elevation": None},
        "collars": {k: None for k in ("hole", "easting", "northing", "elevation", "length", "dip", "azimuth", "property", "prospect", "holetype")},
        "surveys": {"hole": None, "depth": None, "dip": None, "azimuth": None},
    },
    "auto_detect_columns": True,
}


def settings(**given: Any) -> dict[str, Any]:
    """The defaults with some replaced; a name that is not among them is a KeyError."""
    unknown = sorted(set(given) - set(DEFAULTS))
    if unknown:
        raise KeyError(f"no such settings: {unknown}")
    return copy.deepcopy(DEFAULTS) | given


def settings_from_payload(payload: dict[str, Any]) -> dict[str, Any]:
    """Settings of an application request: under cfg or beside it; score_column is one column's name; columns names some point columns,
    others stay automatic. An unknown name under cfg is a KeyError."""
    out = settings(**({k: v for k, v in payload.items() if k in DEFAULTS and k != "columns"} | (payload.get("cfg") or {})))
    if payload.get("score_column"):
        out["score_columns"] = [payload["score_column"]]
    for key, name in (payload.get("columns") or {}).items():
        if name:
            out["columns"]["points"][key] = name
    return out

"""Analysis settings: defaults, and what a YAML file changes of them."""

from __future__ import annotations

import copy

from settlegrid.sources.scans import parse_yaml

#: The published settings of the analysis.
DEFAULTS = {
    "canvas": {"half_size_m": 1000, "resolution_m": 1.0},
    "analysis": {
        "r_min": 2,
        "r_max": 2000,
        "r_steps": 20,
        "mfa": {"q_min": -10, "q_max": 10, "q_steps": 41, "grid_shift_count": 16},
        "lacunarity": {"full_scan": True},
        "percolation": {"d_min": 1, "d_max": 2000, "d_steps": 100, "distance_type": "shortest_path", "node_filter": "building"},
    },
    "network": {"snap_tolerance": 4.0, "connection_threshold": 10.0, "use_road_width": True},
}


def _over(base: dict, changes: dict) -> dict:
    for key, value in changes.items():
        base[key] = _over(base[key], value) if isinstance(base.get(key), dict) and isinstance(value, dict) else value
    return base


def settings(text: str | None = None) -> dict:
    """The defaults with the values of a YAML text over them, level by level; unknown names pass through."""
    changes = parse_yaml(text) if text else None
    if changes is not None and not isinstance(changes, dict):
        raise ValueError("settings must be a mapping")
    return _over(copy.deepcopy(DEFAULTS), changes or {})

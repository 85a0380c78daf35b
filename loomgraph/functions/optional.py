"""Optional numeric packages. Everything here runs with numpy alone, which the graph solvers on one machine use."""

from __future__ import annotations

import importlib.util


def has_local_extra() -> bool:
    """Whether the solvers that run on one machine can be used; never raises."""
    try:
        return importlib.util.find_spec("numpy") is not None
    except (ImportError, ValueError):
        return False


def require_numpy(feature: str) -> None:
    if not has_local_extra():
        raise ImportError(f"{feature} needs numpy; install loomgraph[local]")

"""Settings in layers."""

from __future__ import annotations

from functools import reduce


def merged(*layers: dict) -> dict:
    """The layers put together: later ones win, dictionaries are merged level by level, lists are replaced."""

    def both(a: dict, b: dict) -> dict:
        return {k: both(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    return reduce(both, (x or {} for x in layers), {})

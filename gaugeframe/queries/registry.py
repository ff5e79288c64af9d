"""All registered queries."""

from __future__ import annotations

from gaugeframe.queries import features, modeling, ordering, reporting, scans

MODULES = (scans, features, ordering, reporting, modeling)


def all_queries() -> dict:
    merged: dict = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = pair
    return merged

"""All check SQL by query name."""

from __future__ import annotations

from trailmark.plans import check_items, check_kpi, check_live, check_users


def all_checks() -> dict[str, str]:
    return {**check_kpi.checks(), **check_users.checks(), **check_items.checks(), **check_live.checks()}

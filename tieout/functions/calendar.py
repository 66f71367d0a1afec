"""Business days: Monday to Friday, less a list of holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bank holidays the books observe (fixed values).
HOLIDAYS = (
    "2024-01-26", "2024-03-25", "2024-04-11", "2024-08-15", "2024-10-02", "2024-11-01", "2024-12-25",
    "2025-01-26", "2025-03-14", "2025-08-15", "2025-10-02", "2025-12-25",
)


def is_business_day(day: str, holidays: Sequence[str] = HOLIDAYS) -> Column:
    """`day` is a SQL expression, as in `add_business_days`."""
    return F.expr(_business_day_sql(day, holidays))


def _business_day_sql(day: str, holidays: Sequence[str]) -> str:
    listed = ", ".join(f"DATE'{h}'" for h in holidays)
    return f"(weekday({day}) < 5" + (f" AND {day} NOT IN ({listed}))" if holidays else ")")


def add_business_days(day: str, count: int, holidays: Sequence[str] = HOLIDAYS) -> Column:
    """The `count`-th business day after (before, if negative) `day`; 0 leaves it alone.

    Looks at a stretch of days long enough to hold that many business days even
    if every holiday fell into it. Meant for distinct dates, not for every row.
    """
    if count == 0:
        return F.expr(day)
    step, steps = (1, count) if count > 0 else (-1, -count)
    reach = steps + 2 * (steps // 5 + 1) + len(holidays) + 2
    days = f"sequence(date_add({day}, {step}), date_add({day}, {step * reach}), interval {step} day)"
    return F.expr(f"element_at(filter({days}, d -> {_business_day_sql('d', holidays)}), {steps})")

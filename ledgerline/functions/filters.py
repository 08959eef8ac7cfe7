"""Dashboard filter contract: inclusive date range on the purchase date and a state list.

"All" (or an empty list) means no state filter. Predicates are Column expressions built from
parameters, never SQL text, so values cannot inject SQL. The date range is expressed as a
half-open timestamp range so it reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_STATES = "All"


def as_date(value) -> dt.date | None:
    if value is None or isinstance(value, dt.date):
        return value if not isinstance(value, dt.datetime) else value.date()
    return dt.date.fromisoformat(str(value))  # anything but a whole ISO date is an error


@dataclass(frozen=True)
class SalesFilter:
    start: dt.date | str | None = None
    end: dt.date | str | None = None
    states: tuple[str, ...] = field(default_factory=tuple)

    @property
    def state_list(self) -> list[str]:
        states = list(self.states or ())
        return [] if (not states or ALL_STATES in states) else states

    @property
    def selects(self) -> bool:
        """Whether anything is filtered at all."""
        return self.start is not None or self.end is not None or bool(self.state_list)

    def date_predicate(self, ts: str = "order_purchase_timestamp") -> Column:
        pred = F.lit(True)
        start, end = as_date(self.start), as_date(self.end)
        if start is not None:
            pred = pred & (F.col(ts) >= F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz"))
        if end is not None:
            stop = end + dt.timedelta(days=1)
            pred = pred & (F.col(ts) < F.lit(f"{stop.isoformat()} 00:00:00").cast("timestamp_ntz"))
        return pred

    def month_predicate(self, month: str = "order_month") -> Column:
        """The same range on a first-of-month DATE column (for partition pruning)."""
        pred = F.lit(True)
        start, end = as_date(self.start), as_date(self.end)
        if start is not None:
            pred = pred & (F.col(month) >= F.lit(start.replace(day=1)))
        if end is not None:
            pred = pred & (F.col(month) <= F.lit(end.replace(day=1)))
        return pred

    def state_predicate(self, state: str = "customer_state") -> Column:
        states = self.state_list
        return F.col(state).isin(states) if states else F.lit(True)

"""Calendar expressions: weekday convention, US federal holidays, nearness to one.

Weekdays count Sunday as 0 through Saturday as 6. The holiday test is a plain
expression over the date, so flagging rows needs neither a join nor a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadcurve.constants import HOLIDAY_WINDOW_DAYS

SUNDAY, MONDAY, THURSDAY, SATURDAY = 0, 1, 4, 6

# Holidays on a fixed (month, day) ...
FIXED_HOLIDAYS = {
    "New Year": (1, 1),
    "Juneteenth": (6, 19),
    "Independence": (7, 4),
    "Veterans": (11, 11),
    "Christmas": (12, 25),
}
# ... and on the nth given weekday of a month; 0 stands for the last one.
FLOATING_HOLIDAYS = {
    "King": (1, MONDAY, 3),
    "Presidents": (2, MONDAY, 3),
    "Memorial": (5, MONDAY, 0),
    "Labor": (9, MONDAY, 1),
    "Columbus": (10, MONDAY, 2),
    "Thanksgiving": (11, THURSDAY, 4),
}


def day_of_week(day: Column) -> Column:
    return F.dayofweek(day) - F.lit(1)


def is_weekend(dow: Column) -> Column:
    return dow.isin(SUNDAY, SATURDAY)


def _nth_weekday(year: str, month: int, weekday: int, n: int) -> str:
    """SQL for the nth ``weekday`` of a month; ``n`` = 0 gives the last one."""
    first = f"make_date({year}, {month}, 1)"
    if n == 0:
        last = f"last_day({first})"
        return f"date_sub({last}, pmod(dayofweek({last}) - 1 - {weekday}, 7))"
    return f"date_add({first}, pmod({weekday} + 1 - dayofweek({first}), 7) + {7 * (n - 1)})"


def nth_weekday(year: str, month: int, weekday: int, n: int) -> Column:
    """Date of the nth ``weekday`` of a month in the year held by a column."""
    return F.expr(_nth_weekday(year, month, weekday, n))


def _holiday_dates(year: str) -> dict[str, str]:
    dates = {name: f"make_date({year}, {m}, {d})" for name, (m, d) in FIXED_HOLIDAYS.items()}
    for name, rule in FLOATING_HOLIDAYS.items():
        dates[name] = _nth_weekday(year, *rule)
    return dates


def holidays_of_year(year: str) -> Column:
    """Array of ``struct<holiday, holiday_date>``: the eleven federal holidays of a year column."""
    rows = [
        f"named_struct('holiday', '{name}', 'holiday_date', {day})"
        for name, day in _holiday_dates(year).items()
    ]
    return F.expr(f"array({', '.join(rows)})")


def is_federal_holiday(day: str) -> Column:
    """Whether a date column holds a federal holiday."""
    return F.expr(f"{day} IN ({', '.join(_holiday_dates(f'year({day})').values())})")


def near_holiday(day: str, window: int = HOLIDAY_WINDOW_DAYS) -> Column:
    """Whether a holiday lies within ``window`` days of a date column; windows up to two weeks.

    Only New Year and Christmas lie close enough to a year's end to be reached
    from the neighbouring year.
    """
    if not 0 <= window <= 14:
        raise ValueError("window must lie between 0 and 14 days")
    dates = [*_holiday_dates(f"year({day})").values()]
    dates += [f"make_date(year({day}) + 1, 1, 1)", f"make_date(year({day}) - 1, 12, 25)"]
    return F.expr(" OR ".join(f"abs(datediff({day}, {h})) <= {window}" for h in dates))

"""Wording of recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadcurve import constants as C
from leadcurve.functions.fares import cents


def short_date(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def window_text(start: Column, end: Column) -> Column:
    one, both = F.format_string(C.WINDOW_OF_ONE_DAY, short_date(start)), F.format_string(C.WINDOW_OF_DAYS, short_date(start), short_date(end))
    return F.when(start == end, one).otherwise(both)


def buy_now_message(when: Column) -> Column:
    return F.format_string(C.MSG_BUY, when)


def wait_message(when: Column, best_date: Column, savings: Column) -> Column:
    return F.format_string(C.MSG_WAIT, when, short_date(best_date), F.format_string("%.2f", cents(savings)))


def too_far_message(days_left: Column) -> Column:
    return F.format_string(C.MSG_TOO_FAR, days_left.cast("string"))

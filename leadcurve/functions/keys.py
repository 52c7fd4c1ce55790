"""Identifiers derived from rows: routes, decision ids, stable draws, stops choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadcurve.constants import STOPS_SPELLINGS


def route_key(origin="startingAirport", destination="destinationAirport") -> Column:
    # concat, not concat_ws: a missing end leaves no route
    return F.concat(F.col(origin), F.lit("-"), F.col(destination))


def decision_id(route: Column, flight_date: Column, nonstop: Column, as_of: Column) -> Column:
    return F.concat_ws(
        "|",
        route,
        F.date_format(flight_date, "yyyy-MM-dd"),
        F.when(nonstop, "True").otherwise("False"),
        as_of.cast("string"),
    )


def stable_uniform(key: Column) -> Column:
    """A number in [0, 1] fixed by ``key``: its first eight SHA-256 bytes over 2^64 - 1."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def stable_slot(key: Column, size: Column) -> Column:
    """An integer in [0, size) fixed by ``key``."""
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.when(size > 0, F.pmod(head, F.greatest(size, F.lit(1))))


def normalize_stops(stops: Column, nonstop_only: Column | None = None) -> Column:
    """``all``, ``nonstop`` or ``connecting``; null for a spelling that is not known."""
    plain = F.regexp_replace(F.lower(stops), r"^\s+|\s+$|[ _-]", "")
    known = F.create_map(*[F.lit(x) for pair in STOPS_SPELLINGS.items() for x in pair])
    absent = F.lit("all")
    if nonstop_only is not None:
        absent = F.when(F.coalesce(nonstop_only, F.lit(False)), "nonstop").otherwise("all")
    return F.when(stops.isNull(), absent).otherwise(F.try_element_at(known, plain))

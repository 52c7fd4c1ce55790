"""Values worked out once inside a row, however often an expression names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``. Spark works a value out again for each mention of it inside a lambda or a branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

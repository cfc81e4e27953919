"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda variable can't be copied into inner loops by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

"""Single-precision expressions: Spark's division and roots are double, so they are rounded back at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value) -> Column:
    """A FLOAT literal."""
    return F.lit(float(np.float32(value))).cast("float")


def single(c: Column) -> Column:
    return c.cast("float")


def div(a: Column, b: Column) -> Column:
    """Correctly rounded single-precision quotient."""
    return single(a / b)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")).cast("float"))


def sql(value) -> str:
    """The FLOAT literal as text for the SQL forms."""
    return f"{float(np.float32(value))!r}::FLOAT"

"""Weights that fall with age (days). Negative ages count as 0."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Decay(Protocol):
    """Anything that turns an age column into a weight column."""

    def __call__(self, age_days: Column) -> Column: ...


def exponential(half_life: float = 180.0) -> Decay:
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return lambda age: F.exp(-math.log(2.0) * F.greatest(age, F.lit(0.0)) / half_life)


def linear(window: float = 365.0) -> Decay:
    if window <= 0:
        raise ValueError("window must be positive")
    return lambda age: F.greatest(F.lit(0.0), 1.0 - F.greatest(age, F.lit(0.0)) / window)


def none() -> Decay:
    return lambda age: F.when(age.isNotNull(), F.lit(1.0))


def custom(fn: Callable[[Column], Column]) -> Decay:
    """A function of columns; for plain Python use ``F.pandas_udf`` inside it."""
    return lambda age: fn(F.greatest(age, F.lit(0.0)))

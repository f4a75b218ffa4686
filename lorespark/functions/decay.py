"""Time decay of salience. Lambda 0.01 a day, sigma 0.3, floor 0.05."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAMBDA, SIGMA, FLOOR, DAY = 0.01, 0.3, 0.05, 86400


def _decay(salience: Column, days: Column, n: Column) -> Column:
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), salience)) * F.exp(F.lit(-LAMBDA) * days)
    bonus = F.lit(SIGMA) * F.log1p(F.greatest(F.lit(0.0), n.cast("double"))) / (F.lit(1.0) + days)
    out = F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), base + bonus))
    return F.when(F.isnan(out), F.lit(FLOOR)).otherwise(out)


def decay_frac(salience: Column, last_seen: Column, n: Column, now: int) -> Column:
    """The canonical form: fractional days."""
    return _decay(salience, F.greatest(F.lit(0.0), (F.lit(now) - last_seen) / F.lit(float(DAY))), n)


def decay_days(salience: Column, last_seen: Column, n: Column, now: int) -> Column:
    """The form used for ranking and retention: whole days."""
    return _decay(salience, F.floor(F.greatest(F.lit(0), F.lit(now) - last_seen) / F.lit(DAY)).cast("double"), n)

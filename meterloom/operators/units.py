"""Cost units of a record: tokens weighted by the tier of their model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MODEL_WEIGHTS


def cost_units(model: Column, given: Column, output: Column, cached: Column) -> Column:
    """Unknown counts weigh nothing; an unknown model is of the middle tier; reasoning is part of no price."""
    m, zero = F.lower(model), lambda c: F.coalesce(c, F.lit(0))
    weighed = lambda w: zero(given) * w[0] + zero(output) * w[1] + zero(cached) * w[2]
    return F.when(m.contains("opus"), weighed(MODEL_WEIGHTS["opus"])).when(m.contains("haiku"), weighed(MODEL_WEIGHTS["haiku"])).otherwise(weighed(MODEL_WEIGHTS[None]))

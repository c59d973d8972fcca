"""Fields out of program logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = ("first", "sum", "count", "avg", "max", "min")


def extract(lines: DataFrame, fields: dict[str, tuple[str, str]], run: str = "run", order: str = "line") -> DataFrame:
    """One row a run: each field's pattern (its first group) over the run's lines, reduced.

    fields: name -> (pattern, reducer). All reducers but first and count read numbers.
    """
    out = []
    for name, (pattern, how) in fields.items():
        if how not in REDUCERS:
            raise ValueError(f"unknown reducer {how}")
        hit = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
        if how == "first":
            col = F.min_by(hit, F.when(hit.isNotNull(), F.col(order)))
        elif how == "count":
            col = F.count(hit)
        else:
            col = getattr(F, how)(hit.try_cast("double"))
        out.append(col.alias(name))
    return lines.groupBy(run).agg(*out)

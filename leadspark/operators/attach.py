"""Attach the columns of a one-row result (a global aggregate) to every row.

The right side is a global aggregate, so it has exactly one row by
construction: the join is a broadcast of that row, never a pairing of data
rows.  ``attach_row`` checks that the plan really is such an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plan_is_one_row(plan) -> bool:
    while plan is not None:
        name = plan.nodeName()
        if name == "Aggregate":
            return plan.groupingExpressions().isEmpty()
        if name == "Project":
            plan = plan.children().head()
            continue
        # a filter could remove the row, and with it every data row; so could a join that is not a plain pairing
        if name == "Join" and plan.condition().isEmpty() and plan.joinType().sql() in ("CROSS", "INNER"):
            kids = plan.children()
            return all(_plan_is_one_row(kids.apply(i)) for i in range(kids.size()))
        return False
    return False


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row frame ``row`` added to each row."""
    if not _plan_is_one_row(row._jdf.queryExecution().optimizedPlan()):
        raise ValueError("attach_row needs a global aggregate (exactly one row)")
    return df.crossJoin(F.broadcast(row))

"""Filters on the fields of records, from nested conditions to one column expression that a scan can take over."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What compares a field with a value.  A missing field fits ``$ne`` and ``$nin`` alone.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c.isNull() | (c != F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "$nin": lambda c, v: c.isNull() | ~c.isin(*v) if v else F.lit(True),
    "$contains": lambda c, v: F.contains(c, F.lit(v)),
    "$not_contains": lambda c, v: c.isNull() | ~F.contains(c, F.lit(v)),
}


def condition(where: dict[str, Any]) -> Column:
    """A column from conditions: ``{field: value}``, ``{field: {operator: value}}``, ``$and`` and ``$or`` over lists of such.

    Several entries must all hold; no entries, or an empty ``$and``, always do; an empty ``$or`` never does.
    """
    parts = []
    for name, value in where.items():
        if name in ("$and", "$or"):
            both, start = (Column.__and__, F.lit(True)) if name == "$and" else (Column.__or__, F.lit(False))
            parts.append(reduce(both, map(condition, value)) if value else start)
        elif name.startswith("$"):
            raise ValueError(f"{name} stands where a field is expected")
        elif isinstance(value, dict):
            unknown = set(value) - set(OPERATORS)
            if unknown or not value:
                raise ValueError(f"no such operator: {', '.join(sorted(unknown)) or 'none given'}")
            parts += [OPERATORS[op](F.col(name), v) for op, v in value.items()]
        else:
            parts.append(OPERATORS["$eq"](F.col(name), value))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def matching(records: DataFrame, where: dict[str, Any] | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """The records that fit, the first ``limit`` of them in order where one is given."""
    kept = records.where(condition(where)) if where else records
    return kept.orderBy(order).limit(limit) if limit is not None else kept

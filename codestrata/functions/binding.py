"""Bind a value once for use many times in one expression."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time, also after predicates are inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)

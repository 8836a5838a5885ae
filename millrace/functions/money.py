"""Exact sums of two-digit amounts that are stored as doubles.

A sum of doubles depends on the order in which tasks finish, so a retried task
could change the answer. Amounts are turned into whole cents first and summed as
decimals, which is exact, and about as fast as summing the doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: str | Column) -> Column:
    """Whole cents of an amount, as a decimal whose sums cannot overflow a long."""
    return _hundredfold(amount).cast("decimal(18,0)")


def revenue(price: str | Column = "l_extendedprice", discount: str | Column = "l_discount") -> Column:
    """price * (1 - discount), in hundredths of a cent."""
    return (_hundredfold(price) * (100 - _hundredfold(discount))).cast("decimal(18,0)")


def amount(total: str | Column, digits: int = 2) -> Column:
    """A total of ``cents`` (2 digits) or ``revenue`` (4 digits) as a double."""
    column = F.col(total) if isinstance(total, str) else total
    return column.cast("double") / F.lit(float(10**digits))


def _hundredfold(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.rint(column * 100).cast("bigint")

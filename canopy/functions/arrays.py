"""Array functions (A1-A5). Elements are compared and sorted as text; NULL elements are dropped.

Results are ``array<string>`` sorted by UTF-8 bytes, as the reference joins, splits and sorts text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions._util import col_of


def _text(a: Column) -> Column:
    return a.cast("array<string>")


def _clean(a: Column) -> Column:
    return F.filter(_text(a), lambda e: e.isNotNull())


def array_intersect(a, b) -> Column:
    """A1. Distinct common elements, sorted; NULL if either side is NULL."""
    a, b = col_of(a), col_of(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.array_sort(F.array_intersect(_clean(a), _clean(b))))


def array_merge(a, b) -> Column:
    """A2. Distinct union, sorted; if one side is NULL the other is returned unchanged."""
    a, b = col_of(a), col_of(b)
    return (F.when(a.isNull(), _text(b))
            .when(b.isNull(), _text(a))
            .otherwise(F.array_sort(F.array_union(_clean(a), _clean(b)))))


def array_minus(a, b) -> Column:
    """A3. Distinct elements of ``a`` not in ``b``, sorted; NULL if ``a`` is NULL, ``a`` if ``b`` is NULL."""
    a, b = col_of(a), col_of(b)
    return (F.when(a.isNull(), F.lit(None).cast("array<string>"))
            .when(b.isNull(), _text(a))
            .otherwise(F.array_sort(F.array_except(_clean(a), _clean(b)))))


def array_sort(a) -> Column:
    """A4. Sorted as text, duplicates kept."""
    return F.array_sort(_clean(col_of(a)))


def array_uniq(a) -> Column:
    """A5. Distinct, sorted as text."""
    return F.array_sort(F.array_distinct(_clean(col_of(a))))

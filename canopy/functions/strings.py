"""String helpers: code generation (G1 helpers, G2) and the query-text normalisations of the admin views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions._util import col_of


def put_to_str(arr, delimiter: str = ",", prefix: str = "") -> Column:
    """G2. ``prefix`` before each element, joined by ``delimiter``; an empty list gives ``prefix``."""
    return F.concat(F.lit(prefix), F.array_join(col_of(arr), delimiter + prefix))


def quote_ident(name: str) -> str:
    """G1 rule: a column name holding '#' is quoted (backquotes in Spark SQL)."""
    return f"`{name}`" if "#" in name else name


def query_short(q) -> Column:
    """Lock views: pairs of blanks/tabs/newlines are removed, then 20 characters kept."""
    return F.substring(F.regexp_replace(col_of(q), r"[ \t\r\n]{2}", ""), 1, 20)


def query_collapsed(q, width: int = 80) -> Column:
    """Activity list (B1): white space to one blank, trimmed, first ``width`` characters."""
    one = F.regexp_replace(F.regexp_replace(col_of(q), r"[ \t\r\n]", " "), " +", " ")
    return F.substring(F.trim(one), 1, width)

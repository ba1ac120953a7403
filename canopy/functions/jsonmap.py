"""Flat JSON map functions (J1-J3) over JSON text, through VARIANT (numbers stay numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions._util import col_of, lit_of


def json_map(js) -> Column:
    """Text -> ``map<string,variant>``; NULL or '' is the empty object."""
    js = col_of(js)
    parsed = F.when(js.isNull() | (js == ""), F.parse_json(F.lit("{}"))).otherwise(F.parse_json(js))
    return parsed.cast("map<string,variant>")


def json_set(js, name: str, value) -> Column:
    """J1. Set key ``name`` to the *string* ``value`` (NULL -> JSON null); returns JSON text."""
    m = json_map(js)
    kept = F.map_filter(m, lambda k, v: k != F.lit(name))
    val = lit_of(value).cast("string").cast("variant")
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(name), val)))


def json_get(js, name: str) -> Column:
    """J2. Value of ``name`` as text (JSON text for nested values); NULL if missing or JSON null."""
    v = F.try_element_at(json_map(js), F.lit(name))
    return F.when(~F.is_variant_null(v), v.cast("string"))


def json_check(js, name: str, value) -> Column:
    """J3. The stored value equals the string ``value``: a number never equals a string; a missing
    key or JSON null equals a NULL ``value``."""
    v = F.try_element_at(json_map(js), F.lit(name))
    value = lit_of(value).cast("string")
    missing = v.isNull() | F.is_variant_null(v)
    is_text = F.schema_of_variant(v) == F.lit("STRING")
    return (F.when(missing, value.isNull())
            .when(value.isNull(), F.lit(False))
            .otherwise(is_text & (v.cast("string") == value)))

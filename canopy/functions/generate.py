"""Synthetic column generators (D1-D6), repeatable and the same in every engine: the random source is a counter-based
md5. Block b of a stream is ``md5('<seed>:<key>:<b>')``, and its 32 hexadecimal digits are eight numbers below 65,536.

``key`` identifies the row (an id column of the input), so the same row always gets the same value
and recomputation after an executor loss gives identical output. No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions._util import col_of

# Fixed values (must equal the reference): alphabets and the domain list.
LOWER = "abcdefghijklmnopqrstuvwxyz"
TEXT_SYMBOLS = "abcdefghijklmnopqrstuvwxyz 0123456789"
DOMAINS = ["com", "ru", "info", "co.il"]

DIGITS, PER_BLOCK = 4, 8


def _block(seed: int, key: Column, block: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text, F.lit(":"), block.cast("string")))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def draws(length: int, below: int, key: Column, seed: int) -> Column:
    """An array of ``length`` numbers in [0, below), ``below`` at most 65,536."""
    blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((length - 1) // PER_BLOCK)), lambda b: _block(seed, key, b)), "")
    spots = F.sequence(F.lit(1), F.lit(DIGITS * (length - 1) + 1), F.lit(DIGITS))
    # The digits are bound once by the outer lambda, whatever the number of draws.
    return F.flatten(F.transform(F.array(blocks), lambda hex_digits: F.transform(spots, lambda at: F.shiftright(
        _number(F.substring(hex_digits, at, F.lit(DIGITS))) * below, 4 * DIGITS))))


def wide(seed: int, key, block: int = 0, digits: int = 8) -> Column:
    """A number below 16 ** digits (13 digits at most) of one block."""
    return _number(F.substring(_block(seed, col_of(key), F.lit(block)), 1, digits))


def uniform(seed: int, key) -> Column:
    """Double in [0, 1), a multiple of 2 ** -52."""
    return wide(seed, key, digits=13).cast("double") / F.lit(float(1 << 52))


def _chars(length: int, below: int, key: Column, seed: int, symbol) -> Column:
    if length <= 0:
        return F.lit("")
    return F.array_join(F.transform(draws(length, below, key, seed), symbol), "")


def generate_integer(length: int, key, seed: int = 1) -> Column:
    """D1. ``length`` random digits (leading zeros possible)."""
    return _chars(length, 10, col_of(key), seed, lambda v: v.cast("string"))


def _symbol(alphabet: str, v: Column) -> Column:
    return F.substring(F.lit(alphabet), (v + 1).cast("int"), F.lit(1))


def generate_string(length: int, key, use_upper: int = 1, seed: int = 2) -> Column:
    """D2. ``length`` letters a-z; if ``use_upper > 0`` each is upper case with p = 0.5."""
    letters = LOWER + LOWER.upper() if use_upper > 0 else LOWER
    return _chars(length, len(letters), col_of(key), seed, lambda v: _symbol(letters, v))


def generate_domain(key, seed: int = 3) -> Column:
    """D3. One of the fixed domains."""
    arr = F.array(*[F.lit(d) for d in DOMAINS])
    return F.element_at(arr, (F.get(draws(1, len(DOMAINS), col_of(key), seed), F.lit(0)) + 1).cast("int"))


def generate_email(user_len: int, domain_len: int, key, seed: int = 4) -> Column:
    """D4. ``D2(user_len)@D2(domain_len, 0).D3``, from three streams of its own."""
    return F.concat(generate_string(user_len, key, 1, 10 * seed + 1), F.lit("@"),
                    generate_string(domain_len, key, 0, 10 * seed + 2), F.lit("."), generate_domain(key, 10 * seed + 3))


def generate_point(lat_min: float, lat_max: float, lon_min: float, lon_max: float, key, seed: int = 5) -> Column:
    """D5. ``struct(lat, lon, wkt)``; offsets are multiples of 0.00001, WKT ``POINT(lat lon)``."""
    def coord(lo, hi, block):
        least, steps = round(lo * 100_000), round((hi - lo) * 100_000) + 1
        units = F.lit(least) + F.shiftright(wide(seed, key, block) * F.lit(steps), 32)
        return (units.cast("decimal(14,0)") * F.lit(0.00001).cast("decimal(5,5)")).cast("decimal(20,5)")
    lat, lon = coord(lat_min, lat_max, 0), coord(lon_min, lon_max, 1)
    wkt = F.concat(F.lit("POINT("), lat.cast("string"), F.lit(" "), lon.cast("string"), F.lit(")"))
    return F.struct(lat.alias("lat"), lon.alias("lon"), wkt.alias("wkt"))


def generate_text(length: int, key, seed: int = 6) -> Column:
    """D6. ``length`` symbols from a-z, blank and 0-9."""
    return _chars(length, len(TEXT_SYMBOLS), col_of(key), seed, lambda v: _symbol(TEXT_SYMBOLS, v))

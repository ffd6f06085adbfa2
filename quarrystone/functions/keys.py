"""Deterministic keys: significant digits, conditions, identities, order-free signatures, and hash draws.

Quantising is done with arithmetic (floor of a scaled value), so that any engine
computes the same key; text formats differ between engines in the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.clean import squeeze

MISSING = "NA"


def quantised(x: Column, digits: int) -> Column:
    """x to so many significant digits as 'mantissa e exponent' with integer mantissa; 'NA' for NULL and NaN, '0' for 0 and -0.

    The mantissa is rounded half up in absolute value.
    """
    power = F.floor(F.log10(F.abs(x))).cast("int")
    raw = F.floor(F.abs(x) * F.pow(F.lit(10.0), F.lit(digits - 1) - power) + 0.5).cast("long")
    over = raw >= 10**digits
    mantissa, exponent = F.when(over, F.floor(raw / 10)).otherwise(raw), F.when(over, power + 1).otherwise(power)
    text = F.concat(F.when(x < 0, "-").otherwise(""), mantissa.cast("long").cast("string"), F.lit("e"), exponent.cast("string"))
    return F.when(x.isNull() | F.isnan(x), MISSING).when(x == 0, "0").otherwise(text)


def rounded_figures(x: Column, digits: int) -> Column:
    """x rounded to so many significant figures as a number."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


def written_figures(text: Column) -> Column:
    """How many significant digits a number is written with: leading zeros and, in whole numbers, trailing zeros don't count; NULL if it is no number."""
    t = F.regexp_replace(F.lower(squeeze(text)), r"^[-+]|e[-+]?\d+$", "")
    number = t.rlike(r"^\d*\.?\d+$|^\d+\.$")
    digits = F.regexp_replace(F.regexp_replace(t, r"\.", ""), r"^0+", "")
    digits = F.when(t.contains("."), digits).otherwise(F.regexp_replace(digits, r"0+$", ""))
    return F.when(number, F.greatest(F.length(digits), F.lit(1)))


def condition_key(columns: list[Column], digits: int = 9) -> Column:
    """The conditions joined with '|', unrecorded ones as 'NA', so unrecorded equals unrecorded."""
    return F.concat_ws("|", *[quantised(c, digits) for c in columns])


def identity_hash(categories: list[Column], numbers: list[Column], digits: int = 12) -> Column:
    """24 hexadecimal digits of the SHA-256 of all fields, separated by the unit separator."""
    parts = [F.coalesce(F.lower(squeeze(c)), F.lit(MISSING)) for c in categories] + [quantised(n, digits) for n in numbers]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def component_signature(names: Column, amounts: Column) -> Column:
    """'name@amount' of parallel arrays, sorted and joined with ';', '?' for a missing side; free of the components' order."""
    pairs = F.zip_with(names, amounts, lambda n, a: F.concat(F.coalesce(n, F.lit("?")), F.lit("@"), F.coalesce(quantised(a, 6), F.lit("?"))))
    return F.array_join(F.array_sort(pairs), ";")


def short_hash(columns: list[Column], length: int = 16) -> Column:
    """The first digits of the SHA-1 of text fields joined with '|', NULL as 'NA'."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(MISSING)) for c in columns])), 1, length)


def draw(*parts: Column) -> Column:
    """A number in [0, 1) drawn from the parts by MD5: the same in every engine, for sampling and resampling without a generator."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_order(*parts: Column) -> Column:
    """A text to order by that shuffles rows reproducibly."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def on_log_grid(x: Column, step: float = 0.01, tol: float = 1e-6) -> Column:
    """Whether log10(x) lies on a grid, as values read off a logarithmic axis do."""
    q = F.log10(x) / step
    return F.coalesce(F.abs(q - F.round(q)) * step < tol, F.lit(False))

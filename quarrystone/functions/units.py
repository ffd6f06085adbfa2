"""Column builders for numbers and concentration units written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.clean import is_blank

# Hidden states, and micromoles per litre in one of each (per gram needs a molar mass).
UNITS = ("M", "mM", "mol/m3", "uM", "g/L", "mg/L")
MICROMOLES = {"M": 1e6, "mM": 1e3, "mol/m3": 1e3, "uM": 1.0}
MICROGRAMS = {"g/L": 1e6, "mg/L": 1e3}

# How each unit is written once blanks, dots and carets are gone, in lower case.
SPELLINGS = {
    "M": ("m", "molar", "mol/l", "moll-1", "mol/dm3", "moldm-3"),
    "mM": ("mm", "mmol/l", "mmoll-1", "mmol/dm3", "mmoldm-3", "millimolar"),
    "mol/m3": ("mol/m3", "molm-3"),
    "uM": ("um", "umol/l", "umoll-1", "umol/dm3", "umoldm-3", "micromolar"),
    "g/L": ("g/l", "gl-1", "g/dm3", "gdm-3"),
    "mg/L": ("mg/l", "mgl-1", "mg/dm3", "mgdm-3", "ppm"),
}
_ANY = "|".join(sorted((s for names in SPELLINGS.values() for s in names), key=len, reverse=True))
_NUMBER = r"^(?:~|≈|ca\.?|c=|approx\.?|about)*([-+]?\d+(?:[.,]\d+)?)(?:[x×*]10\^?([-+]?\d+)|e([-+]?\d+))?(.*)$"


def packed(text: Column) -> Column:
    """Lower case without white space, with superscripts, micro signs and minus signs in their plain form."""
    plain = F.translate(F.lower(text), "⁻−¹²³µμ", "--123uu")
    return F.regexp_replace(plain, r"[\s\u00a0\u2000-\u200b\u202f\u00b7\u22c5]+", "")


def unit_code(unit: Column) -> Column:
    """The canonical unit of a packed unit text, NULL if it is none."""
    u = F.regexp_replace(unit, r"\^", "")
    out = F.lit(None).cast("string")
    for name, spelled in SPELLINGS.items():
        out = F.when(u.isin(*spelled), F.lit(name)).otherwise(out)
    return out


def stated_number(text: Column) -> Column:
    """The number that a text states ('ca. 1,5 x 10^-2 M' is 0.015), NULL for blanks and texts that state none."""
    t = packed(text)
    mantissa = F.regexp_replace(F.regexp_extract(t, _NUMBER, 1), ",", ".").try_cast("double")
    power = F.coalesce(F.nullif(F.regexp_extract(t, _NUMBER, 2), F.lit("")), F.nullif(F.regexp_extract(t, _NUMBER, 3), F.lit("")))
    return F.when(~is_blank(text), F.when(power.isNull(), mantissa).otherwise(F.concat(mantissa.cast("string"), F.lit("e"), power).try_cast("double")))


def stated_unit(text: Column) -> Column:
    """The unit written behind the number of a text, NULL if there is none."""
    return unit_code(F.regexp_extract(packed(text), _NUMBER, 4))


def noted_unit(comment: Column, subject: str) -> Column:
    """The unit that the last of a comment's ';'-separated notes matching `subject` ends with, NULL if none does."""
    notes = F.filter(F.split(F.lower(comment), ";"), lambda x: x.rlike(subject))
    units = F.transform(notes, lambda x: unit_code(F.regexp_extract(F.regexp_replace(packed(x), r"\^", ""), rf"(?<=[^a-z]|in|as|are|unit)({_ANY})\.?$", 1)))
    return F.try_element_at(F.filter(units, lambda u: u.isNotNull()), F.lit(-1))


def micromolar(value: Column, unit: Column, molar_mass: Column) -> Column:
    """The quantity in micromoles per litre; NULL where the unit is NULL or a mass unit meets no molar mass."""
    out = F.lit(None).cast("double")
    for name, factor in MICROMOLES.items():
        out = F.when(unit == name, value * factor).otherwise(out)
    for name, factor in MICROGRAMS.items():
        out = F.when(unit == name, value * factor / molar_mass).otherwise(out)
    return out


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits, as a double; 0 stays 0."""
    place = F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int")
    scaled = F.round(x * F.pow(F.lit(10.0), place))
    return F.when(x == 0, F.lit(0.0)).when(place > 0, scaled / F.pow(F.lit(10.0), place)).otherwise(scaled * F.pow(F.lit(10.0), -place))

"""Column builders for structured free text: notes, components, mixtures, oxidation states, Unicode folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.clean import is_blank, squeeze

# Roman numerals of oxidation states.
ROMAN = ("0", "I", "II", "III", "IV", "V", "VI", "VII")


def split_components(text: Column, separators: str = r"[;+]") -> Column:
    """The non-blank parts of a text in order, squeezed; [] for NULL and blanks."""
    parts = F.transform(F.split(text, separators), squeeze)
    return F.coalesce(F.filter(parts, lambda x: ~is_blank(x)), F.array().cast("array<string>"))


def key_values(text: Column, keys: list[str]) -> Column:
    """The 'Key: value' notes of a ';'-separated text for known keys (case ignored), as a map from lower-case key to value; the last one counts."""
    notes = F.filter(F.split(text, ";"), lambda x: F.lower(squeeze(F.substring_index(x, ":", 1))).isin(*[k.lower() for k in keys]) & x.contains(":"))
    pairs = F.transform(notes, lambda x: F.struct(F.lower(squeeze(F.substring_index(x, ":", 1))), squeeze(F.regexp_replace(x, r"^[^:]*:", ""))))
    fold = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["col1"]), F.create_map(p["col1"], p["col2"])))
    return F.coalesce(fold, F.create_map().cast("map<string,string>"))


def canonical_names(parts: Column, names: dict[str, str]) -> Column:
    """Each part by its canonical name where the (lower-case) dictionary has one, else as it is; sorted, each once."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), x))))


def parse_mixture(text: Column) -> Column:
    """array<struct<name, fraction>> of 'A with p% B', 'A f, B g' or a single name; commas inside names (1,2-...) don't split; fractions of percentages sum to 1; NULL for blanks."""
    t = squeeze(text)
    item = lambda n, f: F.struct(squeeze(n).alias("name"), f.cast("double").alias("fraction"))
    with_ = r"^(.+?) with (\d+(?:\.\d+)?) ?% (.+)$"
    share = F.regexp_extract(t, with_, 2).try_cast("double") / 100
    two = r"^(.+) (0?\.\d+), ?(.+) (0?\.\d+)$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    return (
        F.when(is_blank(text), F.lit(None))
        .when(t.rlike(with_), F.array(item(part(with_, 1), 1 - share), item(part(with_, 3), share)))
        .when(t.rlike(two), F.array(item(part(two, 1), part(two, 2).try_cast("double")), item(part(two, 3), part(two, 4).try_cast("double"))))
        .otherwise(F.array(item(t, F.lit(1.0))))
    )


def weighted_property(parts: Column, value: Column) -> Column:
    """The fraction-weighted mean of a name -> value map over a parsed mixture; NULL if a part is unknown or nothing weighs."""
    one = F.transform(parts, lambda p: F.struct(p["fraction"].alias("f"), F.try_element_at(value, p["name"]).alias("v")))
    known = ~F.exists(one, lambda x: x["v"].isNull() | x["f"].isNull())
    total = F.aggregate(one, F.lit(0.0), lambda a, x: a + x["f"])
    return F.when(known & (total > 0), F.aggregate(one, F.lit(0.0), lambda a, x: a + x["f"] * x["v"]) / total)


def state_text(symbol: Column, oxidation: Column) -> Column:
    """'Nd(III)' from a symbol and a number; NULL where either is missing or no small whole number."""
    return F.concat(symbol, F.lit("("), F.get(F.array(*[F.lit(r) for r in ROMAN]), F.when(oxidation == F.floor(oxidation), oxidation.cast("int"))), F.lit(")"))


def parse_state(text: Column) -> Column:
    """struct<symbol, oxidation> of 'Nd(III)'; NULL if it is none."""
    form = r"^([A-Z][a-z]?)\((0|I{1,3}|IV|VI{0,2})\)$"
    ox = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.regexp_extract(text, form, 2)) - 1
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("symbol"), ox.cast("int").alias("oxidation")))


def nfkc(text: Column) -> Column:
    """Unicode normal form KC, unified dashes, squeezed white space; by Arrow batches, as Spark has no normaliser."""
    dashes = {ord(c): "-" for c in "‐‑‒–—−"}

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(dashes).split()), na_action="ignore")

    return fold(text)

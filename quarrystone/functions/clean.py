"""Column builders that turn dirty scalars into comparable ones.

Every builder is a composition of built-in Spark functions, so it stays inside
whole-stage code generation. All of them are total: any input, NULL included,
has a defined result and none raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that stand for "nothing was written", in lower case.
BLANK_TOKENS = ("", "-", "- -", "n/a", "?", "none", "nan")

# English month names as the curators write them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_WS = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+"


def squeeze(text: Column) -> Column:
    """Collapses every run of white space (Unicode spaces included) to one space and trims; NULL stays NULL."""
    return F.trim(F.regexp_replace(text, _WS, " "))


def is_blank(text: Column) -> Column:
    """True for NULL and for the blank tokens in any case; never NULL."""
    return F.coalesce(F.lower(squeeze(text)).isin(*BLANK_TOKENS), F.lit(True))


def text_or_null(text: Column) -> Column:
    """The squeezed text, NULL where it is blank."""
    return F.when(~is_blank(text), squeeze(text))


def number_or_null(x: Column) -> Column:
    """The number, NULL where it is NULL or NaN."""
    return F.when(~F.isnan(x), x)


def in_range(x: Column, low: float, high: float) -> Column:
    """The number where it is finite and low <= x <= high, else NULL."""
    return F.when(~F.isnan(x) & (x >= low) & (x <= high), x)


def is_filled(df, name: str) -> Column:
    """True where column `name` of df holds a usable value; the test follows the column's type."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        return F.col(name).isNotNull() & ~F.isnan(F.col(name))
    if kind == "string":
        return ~is_blank(F.col(name))
    return F.col(name).isNotNull()


def date_key(text: Column) -> Column:
    """yyyymmdd as an int from ISO, slashed, dotted (day first), compact or '10 April 2014' dates; NULL if unreadable."""
    t = F.lower(squeeze(text))
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[t ].*)?$"
    dot = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    packed = r"^(\d{4})(\d{2})(\d{2})$"
    named = r"^(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{4})$"
    led = r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"
    month_of = lambda c: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c)
    part = lambda p, i: F.regexp_extract(t, p, i)
    whole = lambda p, i: part(p, i).try_cast("int")
    join = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), (y * 10000 + m * 100 + d).cast("int"))
    return (
        F.when(t.rlike(iso), join(whole(iso, 1), whole(iso, 2), whole(iso, 3)))
        .when(t.rlike(dot), join(whole(dot, 3), whole(dot, 2), whole(dot, 1)))
        .when(t.rlike(packed), join(whole(packed, 1), whole(packed, 2), whole(packed, 3)))
        .when(t.rlike(named), join(whole(named, 3), month_of(part(named, 2)), whole(named, 1)))
        .when(t.rlike(led), join(whole(led, 3), month_of(part(led, 1)), whole(led, 2)))
    )


def label_key(text: Column) -> Column:
    """Lower-case letters and digits of a label, so that spelling variants agree; NULL where nothing is left."""
    key = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(~is_blank(text) & (key != ""), key)


def doi_list(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Sorted distinct DOIs of a reference text in lower case, without resolver prefixes and those in `ignored`; [] for NULL."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(10\.\d{4,9}/[^\s,;|\"<>]+)"), 1)
    bare = F.transform(found, lambda d: F.regexp_replace(d, r"[.)\]]+$", ""))
    kept = F.filter(bare, lambda d: ~d.isin(*ignored) & (d != "")) if ignored else bare
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def smiles_key(smiles: Column) -> Column:
    """A structure text without white space and with its dot-separated fragments in sorted order; NULL where blank."""
    bare = F.regexp_replace(smiles, _WS, "")
    return F.when(~is_blank(smiles), F.array_join(F.array_sort(F.split(bare, r"\.")), "."))


def split_role(text: Column) -> Column:
    """'train', 'validation' or 'test' however it is written, NULL for anything else."""
    t = F.regexp_replace(F.lower(text), r"[^a-z]", "")
    return F.when(t.startswith("train"), "train").when(t.startswith("val") | (t == "dev"), "validation").when(t.startswith("test"), "test")

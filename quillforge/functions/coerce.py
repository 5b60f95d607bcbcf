"""Coercion of untyped fields: null, blank, missing marker and non-finite all become null, by rules with names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "none", "null", "nan", "NaN", "None")
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def finite(value: Column) -> Column:
    """A finite double, or null for text that is no number, NaN and infinities."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_or_marker(value: Column) -> Column:
    """As ``finite``, with missing markers taken as null first."""
    text = F.trim(value.cast("string"))
    return finite(F.when(~text.isin(*MISSING), text))


def boolean(value: Column) -> Column:
    """True and false from their usual spellings; anything else is null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def strict_boolean(df, name: str) -> Column:
    """The column if it is typed boolean, else null: strings and numbers are not taken for booleans."""
    return F.col(name) if dict(df.dtypes)[name] == "boolean" else F.lit(None).cast("boolean")


def missing_list(value: Column) -> Column:
    """Sorted names of a comma-separated list; blank entries go."""
    return F.array_sort(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def six_decimals(value: Column) -> Column:
    """Text with six decimals for sinks; null becomes an empty field."""
    return F.when(value.isNotNull(), F.format_string("%.6f", value)).otherwise("")


def integral(value: Column) -> Column:
    """A long if the number has no fraction, else null."""
    x = finite(value)
    return F.when(x == F.floor(x), x.cast("long"))


def not_finite(value: Column) -> Column:
    """True if a field is filled but is no finite number (a violation on resume)."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return (text != "") & finite(text).isNull()


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])

"""Numbers, years and coordinates read from text: Column in, Column out, null where nothing can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Texts that say that there is no number.
NO_NUMBER = ["", "-", "--", "no", "n", "false", "absent", "none", "not provided", "n/a", "na", "unknown"]
#: What a float literal looks like; casts alone also take type suffixes.
FLOAT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def as_float(c: Column) -> Column:
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def coerce_number(c: Column) -> Column:
    """First signed decimal of a text; codes with several numbers, such as parcel ids, have none."""
    text = F.lower(strip(c))
    compact = F.replace(text, F.lit(","), F.lit(""))
    number = F.regexp_extract(compact, r"[-+]?\d*\.?\d+", 0)
    return F.when(~text.isin(NO_NUMBER) & ~compact.rlike(r"\d+[-.]\d+[-.]\d+"), number.try_cast("double"))


def parse_year(c: Column) -> Column:
    """Last run of four digits, if it is a year from 1900 to 2100; earlier runs aren't tried."""
    year = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d{4})"), 1), F.lit(-1)).cast("int")
    return F.when(year.between(1900, 2100), year)


def year_suffix(c: Column) -> Column:
    """The last four characters, or ``unknown``."""
    return F.when(F.length(c) >= 4, F.right(c, F.lit(4))).otherwise(F.lit("unknown"))


def first_year(*columns: Column) -> Column:
    return F.coalesce(*[parse_year(c) for c in columns])


def parse_coordinate(c: Column) -> Column:
    """Degrees, with a comma or a dot as the decimal sign."""
    text = strip(c)
    comma = r"^(-?\d{1,3}),(\d{2,})$"
    return F.when(F.lower(text).isin("", "nan", "none", "null"), F.lit(None).cast("double")).when(text.rlike(comma), F.replace(text, F.lit(","), F.lit(".")).try_cast("double")).otherwise(as_float(text))


def geocoded(c: Column) -> Column:
    """``(lat, lon)`` text as a struct, null if it is anything else."""
    pattern = r"^\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)$"
    text = strip(c)
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("lat"), F.regexp_extract(text, pattern, 2).cast("double").alias("lon")))


def parse_flow(c: Column) -> Column:
    """A flow; one to three digits, a dot and three digits are thousands."""
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(F.lower(text).isin("", "nan"), F.lit(None).cast("double")).when(text.rlike(r"^\d{1,3}\.\d{3}$"), F.replace(text, F.lit("."), F.lit("")).try_cast("double")).otherwise(as_float(text))


def parse_number(c: Column) -> Column:
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(~F.lower(text).isin("", "nan"), as_float(text))


def first_number(c: Column) -> Column:
    """First unsigned number, thousands commas dropped."""
    return F.replace(F.regexp_extract(c, r"\d{1,4}(?:,\d{3})?(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def general(c: Column) -> Column:
    """Six significant digits without trailing zeros, as ``%g`` prints numbers from 1e-4 to 1e6."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(c))).cast("int"))
    fixed = F.when(c == 0, F.lit("0")).otherwise(F.format_string("%.10f", F.round(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")

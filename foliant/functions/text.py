"""Cleaning and extraction of text as Spark expressions. Every function takes and returns a Column and runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def collapsed(c: Column) -> Column:
    """White space runs to one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def upper_key(c: Column) -> Column:
    """For classification: upper case, collapsed, null to empty."""
    return collapsed(F.upper(F.coalesce(c, F.lit(""))))


def lower_key(c: Column) -> Column:
    """For section tags and table text: lower case, collapsed."""
    return F.lower(collapsed(F.coalesce(c, F.lit(""))))


def field_text(c: Column) -> Column:
    """For fields: null to empty, no-break spaces to spaces, collapsed."""
    return collapsed(F.regexp_replace(F.coalesce(c, F.lit("")), " ", " "))


def page_text(c: Column) -> Column:
    """For page text: no NULs, runs of blanks to one, lines trimmed, at most one empty line in a row."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\u0000", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def region_key(c: Column) -> Column:
    """For region names: upper case, runs of other characters to one underscore, none at the ends."""
    made = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(c.rlike(r"\A(?:[A-Z0-9]+(?:_[A-Z0-9]+)*+)?\z"), c).otherwise(made)


def folded(c: Column) -> Column:
    """Empty strings and words for nothing become null."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "none", "null", "nan", "n/a", "na", "unknown"), F.lit(None)).otherwise(t)


def number(c: Column) -> Column:
    """A number after currency signs and commas are dropped; null if it is none."""
    t = F.regexp_replace(folded(c), r"[,₹$€£\s]", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))


def amount(c: Column) -> Column:
    """The first number in a text, commas dropped."""
    t = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), r"-?\d+(?:\.\d+)?", 0)
    return F.when(t != "", t.cast("double"))


def percentage(c: Column) -> Column:
    """The first number of a text such as 9%/9%."""
    t = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+(?:\.\d+)?)\s*%?", 1)
    return F.when(t != "", t.cast("double"))


def first_of(*columns: Column) -> Column:
    """The first that holds something; 0 holds something."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def first_match(c: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, cleaned; empty without a match."""
    found = [F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit("")) for p in patterns]
    return field_text(F.coalesce(*found, F.lit("")))


def field_amounts(c: Column) -> Column:
    """Amounts with two decimals in grouped form; of 1234.50, not grouped, the last three digits before the point match."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([-−]?\s*(?:₹|Rs\.?|INR|\$|€|£)?\s*\d{1,3}(?:,\d{3})*\.\d{2})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"^(?i)(?:₹|Rs\.?|INR|\$|€|£)", ""), ",", ""), "−", "-"))


def table_amounts(c: Column) -> Column:
    """Amounts with two decimals, grouped or not."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\d.])[-−]?\d[\d,]*\.\d{2}(?![\d.])"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), "−", "-"))


SPATIAL_AMOUNT = r"(?i)(?<![A-Za-z0-9])(?:₹|Rs\.?|INR|\$|€|£)?\s*-?\d[\d,]*(?:\.\d{1,2})?(?![A-Za-z0-9])"


def spatial_amounts(c: Column) -> Column:
    """Any standing number, as double."""
    found = F.regexp_extract_all(collapsed(F.coalesce(c, F.lit(""))), F.lit(SPATIAL_AMOUNT), F.lit(0))
    digits = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)Rs\.", ""), r"[^0-9.\-]", ""))
    return F.transform(F.filter(digits, lambda x: ~x.isin("", "-", ".")), lambda x: x.try_cast("double"))


def n_spatial_amounts(c: Column) -> Column:
    """How many standing numbers there are: all that spatial_amounts finds hold a digit, so none is dropped there."""
    found = F.regexp_count(collapsed(c), F.lit(SPATIAL_AMOUNT))
    return F.when(c.rlike("[0-9]"), found).otherwise(0)


def percentages(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.cast("double"))


def quantity_tokens(c: Column) -> Column:
    """Standing whole numbers of one to three digits, 1 to 999, with no percent sign within two characters."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9.])(?<!%.?)(\d{1,3})(?![A-Za-z0-9.])(?!.?%)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x >= 1)


def token_key(c: Column) -> Column:
    """For voting on words: lower case letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def shown(c: Column) -> Column:
    """A double without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def safe_name(c: Column) -> Column:
    """A file name: characters that file systems forbid to underscores, blanks and points at the ends dropped, never empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(t == "", F.lit("document")).otherwise(t)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def near(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Equal within a tolerance; null is equal to nothing."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def whole(c: Column, pattern: str) -> Column:
    """All of the text matches, no newline left over."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def valid_pan(c: Column) -> Column:
    return whole(F.upper(F.trim(c)), "[A-Z]{5}[0-9]{4}[A-Z]")


def valid_gstin(c: Column) -> Column:
    return whole(F.upper(F.trim(c)), "[0-9]{2}[A-Z0-9]{13}")


def valid_state(c: Column) -> Column:
    return whole(F.trim(c), r"\d{2}")


def valid_hsn(c: Column) -> Column:
    return whole(F.trim(c), r"\d{4,8}")


def valid_identifier(c: Column) -> Column:
    return whole(F.trim(c), "[A-Za-z0-9][A-Za-z0-9./_-]{3,80}")

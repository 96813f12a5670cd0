"""Text helpers with the truthiness and whitespace rules the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Unicode whitespace characters, the ASCII separators among them.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space."""
    return F.regexp_replace(text, f"[{SPACES}]+", " ")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def or_else(value: Column, default: Column | str) -> Column:
    """`value`, or `default` where it is NULL or the empty string."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def ellipsize(text: Column, width: int) -> Column:
    """Cut to `width` characters, the last one becoming an ellipsis when cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def cut(text: Column, width: int | None) -> Column:
    """The first `width` characters; all of them if it is None."""
    return text if width is None else F.substring(text, 1, width)


def to_number(text: Column) -> Column:
    """Parse a plain decimal number, NULL for anything else."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First regex match or NULL (Spark's own function gives '' for both cases)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def float_text(value: Column) -> Column:
    """Render a double positionally ('124.0', '12345678.9') instead of in Java's E notation."""
    plain = value.cast("string")
    wide = F.regexp_replace(value.cast("decimal(30,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value)
    return F.when((size >= 1e7) & (size < 1e16), wide).otherwise(plain)

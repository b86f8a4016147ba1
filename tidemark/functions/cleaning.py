"""Typed values out of text cells."""

from pyspark.sql import Column, functions as F

# Everything that counts as white space at the ends of a cell.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = (
    r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def safe_int(text: Column, default: int | None = None) -> Column:
    """Whole number of a cell; anything else (also ``8.0``) gives the default."""
    number = F.when(text.rlike(_INT), strip(text).try_cast("int"))
    return number if default is None else F.coalesce(number, F.lit(default))


def safe_double(text: Column, default: float | None = None) -> Column:
    """Floating number of a cell.  NaN becomes NULL because it compares to nothing."""
    number = F.when(text.rlike(_FLOAT), strip(text).try_cast("double"))
    if default is not None:
        number = F.coalesce(number, F.lit(float(default)))
    return F.nullif(number, F.lit(float("nan")))


def capitalise(text: Column) -> Column:
    """First letter upper, all others lower (not per word)."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))


def first_token(text: Column, default: str = "Unknown") -> Column:
    """First word of a name; blank names give the default."""
    token = F.regexp_extract(text, r"(?U)(\S+)", 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.lit(default))


def cell_or_default(cell: Column, default: str | None) -> Column:
    """An empty cell reads as the default."""
    filled = F.nullif(cell, F.lit(""))
    return filled if default is None else F.coalesce(filled, F.lit(default))


def preview(text: Column, length: int = 2000) -> Column:
    """First characters of a report, followed by three dots."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))

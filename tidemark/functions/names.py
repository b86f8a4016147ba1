"""Key slugs and pseudonyms."""

from pyspark.sql import Column, functions as F


def slug(name: Column) -> Column:
    return F.lower(name)


def pseudonym(name: Column, suffix: str) -> Column:
    """Session id that never shows the name: hash prefix of the lower-cased name."""
    digest = F.substring(F.sha2(slug(name), 256), 1, 12)
    return F.concat(F.lit("session_employee_"), digest, F.lit(f"_{suffix}"))

"""Deny-list scan of generated text.  One pass per row, no shuffle, whole texts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.constants import DENY_PATTERN_WORDS, DENY_PATTERNS, SAFE_BRIEFING

# Ignore case, "^" at line starts, only "\n" ends a line, Unicode word borders.
_FLAGS = "(?imdU)"
# Letters that a pattern matches without case but that do not lower to the plain letter.
_ODD_LETTERS = ("\u017f", "\u0131", "\u0130", "\u212a")


def blocked_by(text: Column, patterns: Sequence[str] = DENY_PATTERNS) -> Column:
    """First pattern the text matches, NULL for a clean text."""
    return F.coalesce(
        *[F.when(text.rlike(_FLAGS + pattern), F.lit(pattern)) for pattern in patterns]
    )


def with_blocked_by(
    rows: DataFrame,
    text: str = "text",
    out: str = "blocked_by",
    patterns: Sequence[str] = DENY_PATTERNS,
    words: Mapping[str, str] = DENY_PATTERN_WORDS,
) -> DataFrame:
    """Adds the first pattern each text matches, for large texts.

    ``words`` names lower-case text that every match of a pattern contains.  A pattern
    runs only on rows with its word (or with letters that fold oddly), which is several
    times faster than running every pattern; a pattern without a word runs on all rows.
    """
    source = F.col(text)
    odd = source.contains(_ODD_LETTERS[0])
    for letter in _ODD_LETTERS[1:]:
        odd = odd | source.contains(letter)
    hits = []
    for pattern in patterns:
        matches = source.rlike(_FLAGS + pattern)
        if pattern in words:
            matches = (F.col("_lower").contains(words[pattern]) | F.col("_odd")) & matches
        hits.append(F.when(matches, F.lit(pattern)))
    prepared = rows.withColumns({"_lower": F.lower(source), "_odd": odd})
    return prepared.withColumn(out, F.coalesce(*hits)).drop("_lower", "_odd")


def safe_text(text: Column, blocked: Column) -> Column:
    """The text itself, or the safe text when a pattern blocked it."""
    return F.when(blocked.isNull(), text).otherwise(F.lit(SAFE_BRIEFING))


def screen(text: Column, patterns: Sequence[str] = DENY_PATTERNS) -> Column:
    """The text itself, or the safe text when any pattern matches."""
    return safe_text(text, blocked_by(text, patterns))

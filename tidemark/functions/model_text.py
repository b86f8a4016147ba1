"""Values out of text a model answered with."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.cleaning import strip

TREND_ANSWER = "ARRAY<STRUCT<signal_name: STRING, details: STRING>>"


def strip_fences(text: Column) -> Column:
    """Text without Markdown code fences around it."""
    opened = F.regexp_replace(F.regexp_replace(strip(text), r"^```json", ""), r"^```", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def json_block(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the whole text if there is none."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(block, F.lit("")), text)


def with_json_object(rows: DataFrame, text: Column, fields: str, out: str) -> DataFrame:
    """Adds the text's one JSON object as a struct, NULL for anything else.

    Parsed as the only element of an array: Spark would read an object and ignore what
    follows it.  A column of its own, so that the text is parsed once per row however
    many fields are used.
    """
    elements = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        f"ARRAY<STRUCT<{fields}>>",
        {"allowSingleQuotes": "false"},
    )
    return rows.withColumn("_elements", elements).withColumn(
        out, F.when(F.size("_elements") == 1, F.get("_elements", F.lit(0)))
    ).drop("_elements")


def whole_number(text: Column) -> Column:
    """A score as answered: ``5``, ``"5"`` and ``5.0`` are all 5."""
    return F.when(
        text.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"),
        strip(text).try_cast("double").try_cast("int"),
    )

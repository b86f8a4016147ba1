"""Signal-name sets and their similarity."""

from pyspark.sql import Column, functions as F


def signal_names(signals: Column) -> Column:
    """Distinct signal names in name order; entries without a name are left out.

    The gap marker has no signal name for this purpose.
    """
    named = F.filter(
        signals,
        lambda s: (s.getField("kind") != "gap")
        & s.getField("signal_name").isNotNull()
        & (s.getField("signal_name") != ""),
    )
    names = F.transform(named, lambda s: s.getField("signal_name"))
    return F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>"))


def display_name(signal: Column) -> Column:
    """Name to show for one signal entry."""
    return F.coalesce(signal.getField("signal_name"), F.lit("Unknown"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all names; two empty sets are the same set."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def percent(similarity: Column) -> Column:
    """Whole percents, cut off and not rounded."""
    return (similarity * 100).cast("int")

"""Case-based answers: the nearest stored evaluation by signal-name overlap.

Detected signals come from a fixed vocabulary.  A pool of any size shrinks, by a
map-side combined aggregate, to at most one case per subset of the vocabulary (512 for
nine names), so matching happens between subsets and never between rows.  Sets over any
other vocabulary are matched by a set-similarity join.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.sets import percent
from tidemark.operators.set_join import nearest_sets

MAX_VOCABULARY = 12


@dataclass(frozen=True)
class Search:
    """One question to the pool: which records count, and what to take from the best.

    Results get ``<prefix>similarity`` and ``<prefix><name>`` columns.
    """

    prefix: str
    eligible: Column
    payload: tuple[str, ...]


def case_search(*more: str) -> Search:
    """Scores may be taken from records a model wrote."""
    payload = ("score", "classification", "rationale", *more)
    return Search("case_", F.col("origin") == "model", payload)


def briefing_search() -> Search:
    """Briefings may be taken from records with a real text, not the safe one."""
    text = F.coalesce("briefing", F.lit(""))
    return Search("past_", (text != "") & ~text.contains(C.SAFE_BRIEFING_MARK), ("briefing",))


def subset_mask(names: Column, vocabulary: Sequence[str]) -> Column:
    """Bit per vocabulary name that is in the set."""
    bits = [
        F.when(F.array_contains(names, name), F.lit(1 << i)).otherwise(F.lit(0))
        for i, name in enumerate(vocabulary)
    ]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    return mask


def nearest_cases(
    queries: DataFrame,
    pool: DataFrame,
    searches: Sequence[Search],
    names: str = "names",
    vocabulary: Sequence[str] | None = C.SIGNAL_VOCABULARY,
    floor: float = C.SIMILARITY_FLOOR,
) -> DataFrame:
    """``queries`` plus, per search, the payload of the most similar record.

    Both sides hold their signal names in ``names``; query sets hold vocabulary names
    only, pool sets may hold others, which count in the union.  Below ``floor`` the new
    columns are NULL; ties go to the first (employee, week).  The pool is read once for
    all searches.  Without a vocabulary, or with more names than a table of subsets is good
    for, a set-similarity join finds the same records (``set_join``).
    """
    if vocabulary is None or len(vocabulary) > MAX_VOCABULARY:
        return nearest_sets(queries, pool, searches, names, floor)
    known = F.array(*[F.lit(v) for v in vocabulary])
    # Among records with the same known names, the one with the fewest unknown names is
    # at least as similar to every query set.
    best_per_subset = (
        pool.withColumns(
            {
                "_mask": subset_mask(F.col(names), vocabulary),
                "_unknown": F.size(F.array_except(F.col(names), known)),
            }
        )
        .groupBy("_mask")
        .agg(
            *[
                F.min(
                    F.when(
                        search.eligible,
                        F.struct(
                            F.col("_unknown").alias("unknown"),
                            F.col("employee").alias("first_employee"),
                            F.col("week").alias("first_week"),
                            F.struct(*search.payload).alias("payload"),
                        ),
                    )
                ).alias(search.prefix)
                for search in searches
            ]
        )
    )
    cases = best_per_subset.agg(
        F.collect_list(F.struct("_mask", *[search.prefix for search in searches]))
    ).scalar()

    def best(search: Search) -> Column:
        def ranked(case: Column) -> Column:
            found, mask, other = case.getField(search.prefix), F.col("_mask"), case.getField("_mask")
            shared = F.bit_count(mask.bitwiseAND(other))
            union = F.bit_count(mask.bitwiseOR(other)) + found.getField("unknown")
            similarity = F.when(union == 0, F.lit(1.0)).otherwise(shared / union)
            return F.struct(
                (-similarity).alias("rank"),
                found.getField("first_employee").alias("employee"),
                found.getField("first_week").alias("week"),
                found.getField("payload").alias("payload"),
            )

        eligible = F.filter("cases", lambda case: case.getField(search.prefix).isNotNull())
        near = F.filter(
            F.transform(eligible, ranked), lambda case: -case.getField("rank") >= floor
        )
        return F.array_min(near).alias(search.prefix)

    # One row per possible subset: at most 2 ** len(vocabulary) rows.
    matches = (
        queries.sparkSession.range(1 << len(vocabulary))
        .select(F.col("id").cast("int").alias("_mask"), cases.alias("cases"))
        .select("_mask", *[best(search) for search in searches])
        .select(
            "_mask",
            *[
                column
                for s in searches
                for column in (
                    (-F.col(f"{s.prefix}.rank")).alias(f"{s.prefix}similarity"),
                    *[F.col(f"{s.prefix}.payload.{p}").alias(f"{s.prefix}{p}") for p in s.payload],
                )
            ],
        )
    )
    keyed = queries.withColumn("_mask", subset_mask(F.col(names), vocabulary))
    return keyed.join(F.broadcast(matches), "_mask", "left").drop("_mask")


def case_rationale(similarity: Column, rationale: Column) -> Column:
    return F.format_string(
        C.CASE_RATIONALE_FORMAT, percent(similarity), F.coalesce(rationale, F.lit(""))
    )


def case_briefing(similarity: Column, briefing: Column) -> Column:
    return F.format_string(C.CASE_BRIEFING_FORMAT, percent(similarity), briefing)

"""Weekly flags, confirmation over adjacent weeks, severity, signals as of a week."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import constants as C
from tidemark.operators.timeline import employee_order, with_missing_weeks
from tidemark.schemas import SIGNAL_DDL


@dataclass(frozen=True)
class Rule:
    """How one signal is flagged and graded, as SQL expressions on a timeline row.

    ``worst`` is the measure kept over the confirmed weeks, ``keep`` says whether its
    largest or smallest value counts, ``high`` and ``medium`` are conditions on it.
    """

    name: str
    flag: str
    worst: str
    keep: str
    high: str
    medium: str

    @property
    def key(self) -> str:
        return self.name.lower().replace(" ", "_").replace("-", "_")

    def severity(self, worst: str) -> str:
        return (
            f"CASE WHEN {worst} {self.high} THEN 'high' "
            f"WHEN {worst} {self.medium} THEN 'medium' ELSE 'low' END"
        )


def _relative(difference: str, base: str) -> str:
    """Change relative to a positive base; NULL when it is not a number."""
    return f"nullif(IF({base} > 0, ({difference}) / {base}, NULL), double('NaN'))"


def _cuts(op: str, cuts: tuple) -> tuple[str, str]:
    return f"{op} {cuts[0]}", f"{op} {cuts[1]}"


_DROP = _relative("base_tasks - completed_tasks", "base_tasks")
_RISE = _relative("response_time - base_response", "base_response")
_HOURS = f"coalesce(nullif(weekly_hours, 0), {C.HOURS_WHEN_ZERO})"
_ACCURACY = f"coalesce(nullif(task_accuracy, 0), {C.ACCURACY_WHEN_ZERO})"

# The eight signals, in name order.
RULES = (
    Rule(C.BURNOUT, f"weekly_hours > {C.HIGH_HOURS_FLAG}", _HOURS, "max",
         *_cuts(">", C.HIGH_HOURS_CUTS)),
    Rule(C.TASKS, f"{_DROP} >= {C.TASK_DROP_FLAG}D", _DROP, "max",
         *_cuts(">=", tuple(f"{c}D" for c in C.TASK_DROP_CUTS))),
    Rule(C.AFTER_HOURS, f"after_hours_logins > {C.AFTER_HOURS_FLAG}", "after_hours_logins", "max",
         *_cuts(">=", C.AFTER_HOURS_CUTS)),
    Rule(C.SICK, f"sick_days > base_sick + {C.SICK_DAYS_MARGIN}", "sick_days - base_sick", "max",
         *_cuts(">=", C.SICK_RISE_CUTS)),
    Rule(C.LOW_ACTIVITY, f"weekly_hours < {C.LOW_HOURS_FLAG}", _HOURS, "min",
         *_cuts("<", C.LOW_HOURS_CUTS)),
    Rule(C.QUALITY, f"task_accuracy < {C.ACCURACY_FLAG}", _ACCURACY, "min",
         *_cuts("<", C.ACCURACY_CUTS)),
    Rule(C.RESPONSE, f"{_RISE} > {C.RESPONSE_RISE_FLAG}D", _RISE, "max",
         *_cuts(">=", tuple(f"{c}D" for c in C.RESPONSE_RISE_CUTS))),
    # Always medium: a flag counts 1, which is at least 1 and never 2.
    Rule(C.WITHDRAWN, f"lower(btrim(sentiment, ' \\t\\r\\n')) = '{C.WITHDRAWN_WORD}'", "1", "max",
         *_cuts(">=", (2, 1))),
)


def weekly_flags(timeline: DataFrame) -> DataFrame:
    """One boolean column per signal; none in week 1, in gaps or without baseline."""
    counted = "NOT data_missing AND week <> 1 AND has_baseline"
    return timeline.withColumns(
        {f"flag_{r.key}": F.expr(f"{counted} AND coalesce({r.flag}, false)") for r in RULES}
    )


def _compact(entries: list[str]) -> Column:
    """Array of the entries that are not NULL."""
    return F.expr(f"array_compact(array({', '.join(entries)}))")


def flags_long(timeline: DataFrame) -> DataFrame:
    """(employee, week, signal_name), one row per raised flag."""
    raised = _compact([f"IF(flag_{r.key}, '{r.name}', NULL)" for r in RULES])
    return weekly_flags(timeline).select(
        "employee", "week", F.explode(raised).alias("signal_name")
    )


def with_runs(timeline: DataFrame) -> DataFrame:
    """Adds, per signal, whether the flag and its neighbours are raised.

    ``now_*``: this week and the week before.  ``run_*``: this week and either
    neighbour.  The timeline is dense, so the neighbouring row is the neighbouring week.
    """
    order = employee_order()
    flagged = weekly_flags(timeline)
    beside = {}
    for r in RULES:
        beside[f"prev_{r.key}"] = F.lag(f"flag_{r.key}", 1, False).over(order)
        beside[f"next_{r.key}"] = F.lead(f"flag_{r.key}", 1, False).over(order)
    runs = {}
    for r in RULES:
        runs[f"now_{r.key}"] = F.expr(f"flag_{r.key} AND prev_{r.key}")
        runs[f"run_{r.key}"] = F.expr(f"flag_{r.key} AND (prev_{r.key} OR next_{r.key})")
    return flagged.withColumns(beside).withColumns(runs)


def confirmed_weeks(timeline: DataFrame) -> DataFrame:
    """(employee, signal_name, week, confirm_week) of flags in a run of two or more.

    ``confirm_week`` is the first week from which the flag counts: its own week when
    the week before is flagged too, else the next.
    """
    hits = _compact(
        [
            f"IF(run_{r.key}, named_struct('signal_name', '{r.name}', "
            f"'confirm_week', IF(now_{r.key}, week, week + 1)), NULL)"
            for r in RULES
        ]
    )
    return with_runs(timeline).select("employee", "week", F.explode(hits).alias("hit")).select(
        "employee", "hit.signal_name", "week", "hit.confirm_week"
    )


def _entry(kind: str, name: str, weeks: str, severity: str, details: str = "NULL") -> str:
    return (
        f"CAST(named_struct('kind', '{kind}', 'signal_name', '{name}', 'weeks_detected', {weeks}, "
        f"'severity', {severity}, 'details', {details}) AS {SIGNAL_DDL})"
    )


def _run(first: str) -> str:
    """The stretch of weeks from ``first`` to the row's week."""
    return f"named_struct('first', {first}, 'last', week)"


def _as_of_entry(rule: Rule) -> str:
    """Signal entry as of the row's week, NULL when nothing is confirmed by then."""
    k = rule.key
    pick = "greatest" if rule.keep == "max" else "least"
    runs = f"IF(now_{k}, array_append(runs_{k}, {_run(f'since_{k}')}), runs_{k})"
    weeks = f"flatten(transform({runs}, r -> sequence(r.first, r.last)))"
    worst = f"IF(now_{k}, {pick}(past_{k}, worst_{k}), past_{k})"
    found = _entry("signal", rule.name, weeks, rule.severity(worst))
    return f"IF(now_{k} OR size(runs_{k}) > 0, {found}, NULL)"


def signals_as_of(timeline: DataFrame) -> DataFrame:
    """Confirmed signals of every employee as of every week, with their severity.

    Returns (employee, week, data_missing, missing_weeks, signals).  Equal to running
    detection again on each prefix of the timeline, but linear: as of week ``w`` the
    confirmed weeks are those before ``w`` with a flagged neighbour, plus ``w`` itself
    when the week before is flagged.  These weeks are kept as runs (first, last): those
    that ended before ``w``, and the one that reaches ``w``; single weeks are listed only in
    the result.  Worst values are running maxima and minima, and everything stays in one
    partitioning by employee.
    """
    before = employee_order().rowsBetween(W.unboundedPreceding, -1)
    worst, running = {}, {}
    for r in RULES:
        worst[f"worst_{r.key}"] = F.expr(f"IF(run_{r.key}, {r.worst}, NULL)")
        worst[f"since_{r.key}"] = F.coalesce(F.max(F.expr(f"IF(flag_{r.key}, NULL, week)")).over(before), F.lit(0)) + 1
        ended = F.expr(f"IF(now_{r.key} AND NOT next_{r.key}, {_run(f'since_{r.key}')}, NULL)")
        extreme = F.max if r.keep == "max" else F.min
        running[f"runs_{r.key}"] = F.collect_list(ended).over(before)
        running[f"past_{r.key}"] = extreme(f"worst_{r.key}").over(before)
    rows = with_missing_weeks(with_runs(timeline)).withColumns(worst).withColumns(running)

    no_baseline = _entry("no_baseline", C.BASELINE_MISSING, "array()", "'low'")
    details = f"format_string('{C.GAP_DETAILS_FORMAT}', array_join(missing_weeks, ', '))"
    gap = _entry("gap", C.GAP_MARKER, "NULL", "'low'", details)
    signals = _compact(
        [
            f"IF(has_baseline, NULL, {no_baseline})",
            *[_as_of_entry(r) for r in RULES],
            f"IF(size(missing_weeks) > 0, {gap}, NULL)",
        ]
    )
    return rows.select(
        "employee", "week", "data_missing", "missing_weeks", signals.alias("signals")
    )


def explode_signals(evaluated: DataFrame) -> DataFrame:
    """One row per (employee, week, signal entry)."""
    return evaluated.select("employee", "week", F.explode("signals").alias("s")).select(
        "employee", "week", "s.*"
    )


def confirmed_as_of_join(timeline: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(employee, as_of_week, signal_name, weeks_detected): what was confirmed by each week.

    The as-of rule for confirmed weeks kept as a table.  Both sides are merged in the
    order of employee and week, and each week of the timeline takes the confirmed rows
    up to it: no row is made for a pair of weeks that don't go together, as a join on the
    employee would.
    """
    hit = F.struct("signal_name", "week")
    merged = confirmed.select("employee", F.col("confirm_week").alias("at"), hit.alias("hit"), F.lit(False).alias("asks")).union(
        timeline.select("employee", "week", F.lit(None).cast("struct<signal_name: string, week: int>"), F.lit(True))
    )
    # A range frame: what is confirmed in a week counts as of that week.
    so_far = W.partitionBy("employee").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    known = merged.withColumn("hits", F.collect_set("hit").over(so_far)).filter("asks")
    names = F.array_distinct(F.transform("hits", lambda h: h.getField("signal_name")))

    def weeks_of(name: Column) -> Column:
        own = F.filter("hits", lambda h: h.getField("signal_name") == name)
        return F.array_sort(F.transform(own, lambda h: h.getField("week")))

    listed = F.transform(names, lambda n: F.struct(n.alias("signal_name"), weeks_of(n).alias("weeks_detected")))
    return known.select("employee", F.col("at").alias("as_of_week"), F.inline(listed))


def add_details(signals: Column, answers: Column) -> Column:
    """Signals with the details a model wrote for the same name.

    Name and computed severity stay; a signal the answer leaves out is kept.
    """
    return F.transform(
        signals,
        lambda s: F.struct(
            s.getField("kind").alias("kind"),
            s.getField("signal_name").alias("signal_name"),
            s.getField("weeks_detected").alias("weeks_detected"),
            s.getField("severity").alias("severity"),
            F.coalesce(
                s.getField("details"),
                F.get(
                    F.filter(
                        answers,
                        lambda a: a.getField("signal_name") == s.getField("signal_name"),
                    ),
                    F.lit(0),
                ).getField("details"),
            ).alias("details"),
        ),
    )

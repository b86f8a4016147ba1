"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over one row; no user function, no shuffle.  The
table below (or one the caller gives) decides: a row is kept if each measure lies within
its bounds.

Measures (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars (code points in words),
n_symbols (characters of ``[#*$%&|<>]``), n_dup_lines (lines with a word that equal an
earlier line), n_repeat_words (words in windows of three words found twice or more),
n_lines (lines with a word), n_stop_words, and the ratios built from them.

Defined cases: null and empty texts have no words and no lines, fail the base rule and
are not kept; ratios of a text without words are 0.  Rows are judged one by one, so
repeated rows get equal verdicts.  Columns of the input never clash: the result has only
``doc_id`` and the measures, and ``keep`` returns the input columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words

SYMBOLS = "#*$%&|<>"

# Frequent short words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by this from or an a "
    "le la les de des du et en un une que qui est pour dans sur au pas par "
    "der die das und zu den von mit ist ein eine nicht im für dem auf des es sich "
    "el los las del y que en por con una para se no al lo su es o"
).split()

# (measure, least, most); None leaves a side open.
THRESHOLDS = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.6),
    ("stop_word_ratio", 0.02, None),
)
BASE = ("n_words", "repeat_word_ratio")


def _let(value: Column, body) -> Column:
    """Binds a value once, so that a lambda over positions does not compute it again."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(found: Column) -> Column:
    """Words covered by a window of three that occurs twice or more: sort windows, look at neighbours."""
    windows = F.when(
        F.size(found) > 2,
        _let(found, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))),
    ).otherwise(F.array().cast("array<string>"))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = _let(
            ordered,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda e, k: F.when(
                        ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)),
                        e["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        return _let(
            F.array_sort(places),
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    # Most texts repeat no window; only the others are sorted.
    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def measure(documents: DataFrame, *keep: str) -> DataFrame:
    """The measures of each row, next to the columns named in ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    found = documents.select(*[F.col(f"`{k}`") for k in keep], text.alias("_text"), words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n_words, dup = F.size("_words").cast("long"), lines
    counted = found.select(
        *[F.col(f"`{k}`") for k in keep],
        n_words.alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(dup).cast("long").alias("n_lines"),
        (F.size(dup) - F.size(F.array_distinct(dup))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one condition over the measures."""
    condition = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            condition &= F.col(name) >= least
        if most is not None:
            condition &= F.col(name) <= most
    return condition


def judge(documents: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, measures, base_failed and kept of every row."""
    base = verdict([t for t in thresholds if t[0] in BASE])
    return measure(documents, "doc_id").select("*", (~base).alias("base_failed"), verdict(thresholds).alias("kept"))


def keep(documents: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``documents`` that pass, with their own columns."""
    columns = documents.columns
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("text"))
    return measure(row, "_row").where(verdict(thresholds)).select("_row.*")

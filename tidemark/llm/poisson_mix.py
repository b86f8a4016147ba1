"""Mixing sources to target weights by Poisson replication.

The rate of a source is ``total * weight / (sum of weights * rows of the source)``: the
mean number of copies that brings the source to its weight.  A row's number of copies
inverts the Poisson distribution at a uniform number hashed from (seed, doc_id, text); the copies are
exploded and dealt globally by a second hash.  Rates above ``CHUNK`` are drawn as a sum of
independent parts (a sum of Poisson numbers is Poisson), so no rate underflows and none
is capped.

Source counts are combined on the map side; the rate table is broadcast only while it
has at most ``MAX_BROADCAST`` sources, else joined by shuffle (AQE splits hot sources).

Defined cases: a null source is a source of its own; a source that the weights don't
name, or with a weight that is null or not positive, gets rate 0 (no copies); a null id
or text hashes as the empty string; rows equal in id and text get equal counts; an empty
table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 16.0
MAX_BROADCAST = 10_000
_TERMS = 90  # at mean 16 the tail beyond is under 1e-35
_UNIT = float(1 << 52)


def tempered_weights(documents: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Weights (source, weight): rows of the source to the power ``exponent``."""
    return documents.groupBy("source").count().select("source", F.pow(F.col("count").cast("double"), exponent).alias("weight"))


def rates(documents: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """source, rate: mean copies of each row of the source.  ``total`` defaults to the rows there are."""
    counts = documents.groupBy("source").agg(F.count("*").alias("n"))
    wanted = weights.where(F.col("weight") > 0).groupBy("source").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    known = counts.alias("c").join(wanted.alias("w"), F.col("c.source").eqNullSafe(F.col("w.source"))).select("c.source", "n", "weight")
    sums = known.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()  # two numbers
    rows = documents.count() if total is None else total
    return known.select("source", (F.lit(float(rows)) * F.col("weight") / F.lit(sums["w"]).cast("double") / F.col("n")).alias("rate"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / _UNIT


def poisson(rate: Column, seed: int, *parts: Column) -> Column:
    """Copies: the least n with u < P(N <= n), summed over ceil(rate / CHUNK) parts."""
    pieces = F.ceil(rate / CHUNK).cast("int")

    def inverted(k: Column) -> Column:
        mean = rate / pieces
        step = F.aggregate(
            F.sequence(F.lit(1), F.lit(_TERMS)),
            F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"), uniform(seed, k, *parts).alias("u")),
            lambda s, i: F.struct(
                (s["p"] * mean / i).alias("p"),
                (s["cdf"] + s["p"] * mean / i).alias("cdf"),
                F.when(s["u"] >= s["cdf"], i).otherwise(s["n"]).alias("n"),
                s["u"].alias("u"),
            ),
        )
        return step["n"]

    return F.when(rate > 0, F.aggregate(F.transform(F.sequence(F.lit(1), pieces), inverted), F.lit(0), lambda a, n: a + n)).otherwise(0)


def mix(documents: DataFrame, weights: DataFrame, seed: int = 11, total: int | None = None, marks: bool = False) -> DataFrame:
    """Documents replicated to the target weights, in a global pseudo-random order.

    With ``marks`` the columns copy_no (from 1) and place (the shuffle key) are added
    (they replace input columns of these names).
    """
    spark = documents.sparkSession
    rate = rates(documents, weights, total)
    small = rate.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rate = rate.select(F.col("source").alias("_of"), F.col("rate").alias("_rate"))
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    joined = row.join(F.broadcast(rate) if small else rate, F.col("_row.source").eqNullSafe(F.col("_of")))
    id_, text = F.col("_row.doc_id"), F.md5(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary"))
    copies = (
        joined.withColumn("_n", poisson(F.col("_rate"), seed, id_, text))
        .where("_n > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
        .withColumn("_place", F.xxhash64(F.lit(seed), id_, text, "_copy"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartition(n, "_place").sortWithinPartitions("_place", "_copy")
    if not marks:
        return dealt.select("_row.*")
    columns = [F.col(f"_row.`{c}`") for c in documents.columns if c not in ("copy_no", "place")]
    return dealt.select(*columns, F.col("_copy").alias("copy_no"), F.col("_place").alias("place"))

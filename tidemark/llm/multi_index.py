"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: principal directions with a learned rotation (iterative quantisation), fitted on a
bounded sample (``FIT_ROWS`` rows by a hash of the id); every row is coded and indexed.
The search radius is the least Hamming radius within which the sample finds at least
``RECALL`` of its true neighbours.

Index: a code is split into substrings of ``SUB_BITS`` bits, each with its own buckets.  Of
two codes within radius r, some substring differs in at most r // substrings bits
(pigeonhole), so probing all values that near in every substring retrieves every code
within r.  A pair met in several substrings counts in the first only.  Retrieved rows
are ranked by the exact distance of the original vectors.  Queries that retrieve fewer
than k rows are searched again with all values probed.

Equal vectors are one class with its k + 1 smallest ids (all that can be among k nearest),
so a vector shared by a third of the rows is one index entry.  Buckets are cut into blocks
of ``BLOCK`` entries, queries likewise; a task holds one block of each.  Only bucket sizes
(at most substrings * 2**SUB_BITS rows) are broadcast.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
vectors of another dimension than the sample's most frequent one, and null ids take no
part; rows that repeat an id count once, with the least of their vectors; ties go to the
smaller id; with fewer than k other rows all are returned; without rows the result is empty.
"""

import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BITS = 64
SUB_BITS = 8
FIT_ROWS = 10_000
RECALL = 0.97
BLOCK = 20_000
_ROUNDS = 50
_TRIAL = 200


class Codes:
    """mean and projection of a fitted code, and the search radius."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, radius: int):
        self.mean, self.projection, self.radius = mean, projection, radius

    @classmethod
    def fit(cls, x: np.ndarray, k: int, recall: float = RECALL, seed: int = 5) -> "Codes":
        rng = np.random.default_rng(seed)
        bits = min(BITS, x.shape[1] // SUB_BITS * SUB_BITS or x.shape[1])
        mean = x.mean(axis=0)
        centred = x - mean
        _, directions = np.linalg.eigh(centred.T @ centred)
        directions = directions[:, ::-1][:, :bits]
        v = centred @ directions
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(_ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        codes = cls(mean, directions @ rotation, bits)
        if len(x) > k + 1:
            code = codes.encode(x)
            picked = rng.permutation(len(x))[:_TRIAL]
            distance = ((x[picked] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]) - 2 * x[picked] @ x.T
            distance[np.arange(len(picked)), picked] = np.inf
            near = np.argpartition(distance, k, axis=1)[:, :k]
            apart = np.bitwise_count(code[picked][:, None] ^ code[near])
            codes.radius = int(np.quantile(apart, recall, method="higher"))
        return codes

    @property
    def bits(self) -> int:
        return self.projection.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.projection > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _valid(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return (
        embeddings.where("vec_id is not null and embedding is not null")
        .where((F.size(x) > 0) & fine)
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )


def _near_masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in chosen) for n in range(min(radius, bits) + 1) for chosen in itertools.combinations(range(bits), n)]


def _search(index: DataFrame, queries: DataFrame, codes: Codes, k: int, radius: int) -> DataFrame:
    """query_id, vec_id, score: up to k nearest within the Hamming radius of each query, bucket by bucket."""
    width = min(SUB_BITS, codes.bits)
    parts = -(-codes.bits // width)
    reach = radius // parts
    every = reach >= width  # all values of any substring: one substring is enough
    subs, low = (1 if every else parts), (1 << width) - 1
    key = lambda j: F.shiftrightunsigned("code", j * width).bitwiseAND(F.lit(low)).cast("int")
    where = F.explode(F.array(*[F.struct(F.lit(j).alias("sub"), key(j).alias("key")) for j in range(subs)]))

    entries = index.select("ids", "embedding", "code", where.alias("at")).select("ids", "embedding", "code", "at.sub", "at.key")
    sizes = F.broadcast(entries.groupBy("sub", "key").count().select("sub", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    masks = F.explode(F.array(*[F.lit(m) for m in _near_masks(width, reach)])).alias("mask")
    probes = (
        queries.select("query_id", "embedding", "code", where.alias("at"))
        .select("query_id", "embedding", "code", "at.sub", "at.key", masks)
        .withColumn("key", F.col("key").bitwiseXOR(F.col("mask")))
        .drop("mask")
    )
    probed = F.broadcast(probes.groupBy("sub", "key").count().select("sub", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("query_blocks")))
    entries = (
        entries.join(sizes, ["sub", "key"])
        .join(probed, ["sub", "key"])
        .withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks")).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
        .drop("blocks", "query_blocks")
    )
    probes = (
        probes.join(sizes, ["sub", "key"])
        .join(probed, ["sub", "key"])
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks", "query_blocks")
    )
    by = ["sub", "key", "block", "query_block"]

    def run(at, rows, asked):
        out_q, out_v, out_s = [], [], []
        if len(rows) and len(asked):
            sub = int(at[0])
            x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            code = rows["code"].to_numpy().view(np.uint64)
            for n, (query_id, q, c) in enumerate(zip(asked["query_id"], asked["embedding"], asked["code"].to_numpy().view(np.uint64))):
                apart = code ^ c
                good = np.bitwise_count(apart) <= radius
                for j in range(sub):  # met before
                    good &= np.bitwise_count((apart >> np.uint64(j * width)) & np.uint64(low)) > reach
                near = np.flatnonzero(good)
                if not len(near):
                    continue
                score = np.sqrt(((x[near] - np.asarray(q, dtype=np.float64)) ** 2).sum(axis=1))
                if len(near) > k + 1:
                    edge = np.partition(score, k)[k]
                    near, score = near[score <= edge], score[score <= edge]
                found = sorted((s, int(i)) for r, s in zip(near, score) for i in rows["ids"].iat[r] if i != query_id)[:k]
                out_q += [query_id] * len(found)
                out_v += [i for _, i in found]
                out_s += [s for s, _ in found]
        return pd.DataFrame({"query_id": np.array(out_q, dtype=np.int64), "vec_id": np.array(out_v, dtype=np.int64), "score": np.array(out_s, dtype=np.float64)})

    return entries.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score double")


def search(embeddings: DataFrame, is_query, k: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` holds."""
    valid = _valid(embeddings)
    share = min(1.0, FIT_ROWS / max(valid.count(), 1))
    sample = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("vec_id").collect()
    sizes = Counter(len(r["embedding"]) for r in sample)
    dimension = sizes.most_common(1)[0][0] if sizes else 1
    fitted = [r["embedding"] for r in sample if len(r["embedding"]) == dimension]
    codes = Codes.fit(np.array(fitted, dtype=np.float64), k, recall) if fitted else Codes(np.zeros(1), np.ones((1, 1)), 1)

    @F.pandas_udf("long")
    def code_of(x: pd.Series) -> pd.Series:
        return pd.Series(codes.encode(np.stack(x.to_numpy()).astype(np.float64)).view(np.int64))

    coded = stored(valid.where(F.size("embedding") == dimension).withColumn("code", code_of("embedding")), "codes")
    order = Window.partitionBy("embedding", "code").orderBy("vec_id")
    classes = (
        coded.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("embedding", "code")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    index = stored(classes, "index")
    queries = coded.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding", "code")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = stored(ranked(_search(index, queries, codes, k, codes.radius)), "found")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    if short.isEmpty():
        result = first
    else:
        again = ranked(_search(index, short, codes, k, codes.bits))
        result = first.join(full, "query_id", "left_semi").unionByName(again)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: ``BINS`` coordinates.  In round i < BINS every shingle is hashed to one bin with a
value in [i, i + 1); in round BINS + j every shingle goes to bin j.  A coordinate keeps its
least value, so after 2 * BINS rounds at most every coordinate is filled, and the rounds
stop when all are (a later round can't change a filled one).  Two sketches agree in a
coordinate with the probability of the Jaccard similarity, with concentration as good as
independent hashing, in O(n + BINS log BINS) expected time.

Banding: keys of ``ROWS`` coordinates, as many as keep the probability of missing a link at
the threshold below ``MISS``: 26 at similarity 0.85, where it is (1 - 0.85^5)^26 < 4e-7, and
38 at 0.80.

Verification: documents with equal shingle sets are one class.  In a bucket all classes
are checked against its leader, the class that meets most others over all bands (the
middle of a group), so a bucket of any size costs one check a class.  After connecting
what was confirmed, members of one leader that are still in different components are
compared with each other inside tasks, in blocks of ``BLOCK`` x ``BLOCK`` of them (against
the leader's largest component, only those outside it): sets are held relative to the
leader's, so a block is one small matrix product and only links leave the task.  So no link
between candidates is lost, and no pairs are emitted.  All checks are on full shingle sets.

Defined cases: null or empty texts have no shingles and link with nothing; fewer words
than the shingle length make one shingle; a null doc_id links with nothing, has a null
component and is kept; rows that repeat an id and text are one document (kept or removed
together); an id with several texts is judged text by text; other input columns are not
read.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, shuffle_partitions, stored
from tidemark.llm.components import components

WORDS = 3
PERCENT = 85
ROWS = 5
MISS = 4e-7
BLOCK = 1024
_MEMO = 300_000
_LOW = np.uint64((1 << 48) - 1)


def bands(percent: int) -> int:
    """Bands of ROWS coordinates that miss a link at the threshold with a probability below MISS."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    return 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


BANDS = bands(PERCENT)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingles of a lower-cased text."""

    def __init__(self, length: int = WORDS):
        self.length, self.memo = length, {}

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = text.lower().split()
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, digest = self.memo, xxhash.xxh3_64_intdigest
        for word in set(tokens):
            if word not in memo:
                memo[word] = digest(word)
        hashed = np.fromiter((memo[w] for w in tokens), dtype=np.uint64, count=len(tokens))
        width = min(self.length, len(tokens))
        if not width:
            return hashed
        n = len(hashed) - width + 1
        out = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
        return np.unique(out)


class Sketcher:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.seeds = _mix(np.arange(1, 2 * self.bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        t, empty = self.bins, np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.full(t, empty, dtype=np.uint64)
        at, step = 0, max(1, -(-800 // len(shingles)))
        while at < t and (least == empty).any():
            rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
            hashed = _mix(shingles[None, :] ^ self.seeds[at : at + len(rounds), None])
            bins = (hashed >> np.uint64(48)) % np.uint64(t)
            np.minimum.at(least, bins.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(48)) | (hashed & _LOW)).ravel())
            at += len(rounds)
        for j in np.flatnonzero(least == empty):
            hashed = _mix(shingles ^ self.seeds[t + j])
            least[j] = (np.uint64(t + j) << np.uint64(48)) | (hashed & _LOW).min()
        return least

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        grid = self.sketch(shingles).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
        return key.view(np.int64)


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, fp (hash of the text), n_shingles, set_id, bands of every row."""

    def run(batches):
        shingles, sketcher = Shingles(words), Sketcher(bands(percent))
        for frame in batches:
            sets = [shingles(t.encode()) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "fp": frame["fp"],
                    "n_shingles": [len(s) for s in sets],
                    "set_id": [_set_id(s) if len(s) else None for s in sets],
                    "bands": [sketcher.band_keys(s) if len(s) else None for s in sets],
                }
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text")).mapInPandas(
        run, "doc_id long, fp long, n_shingles long, set_id binary, bands array<long>"
    )


def _compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), whether their full sets are linked, and b relative to a: the places of
    a's shingles that b has (bits) and b's other shingles (extras)."""
    # Many pairs share a leader a: their rows arrive sorted by a, whose set is kept.
    joined = (
        pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        shingles, last, known = Shingles(words), None, None
        for frame in batches:
            linked, bits, extras, sizes = [], [], [], []
            for a, text_a, text_b in zip(frame["a"], frame["text_a"], frame["text_b"]):
                if a != last:
                    last, known = a, shingles(text_a.encode())
                other = shingles(text_b.encode())
                there = np.isin(known, other, assume_unique=True)
                both = int(there.sum())
                linked.append(_similar(both, len(known), len(other), percent))
                sizes.append(len(other))
                bits.append(np.packbits(there).tobytes())
                extras.append(np.setdiff1d(other, known, assume_unique=True).tobytes())
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": linked, "n": sizes, "bits": bits, "extras": extras})

    return joined.mapInPandas(run, "a binary, b binary, linked boolean, n long, bits binary, extras binary")


def _similar(both, n, m, percent):
    return 100 * both >= percent * (n + m - both)


def _links_between(odd: pd.DataFrame, every: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Linked pairs of two blocks of one leader's members in different components."""
    shared = np.zeros((len(odd), len(every)), dtype=np.float32)
    x, y = (np.unpackbits(np.frombuffer(b"".join(f["bits"]), np.uint8).reshape(len(f), -1), axis=1).astype(np.float32) for f in (odd, every))
    shared += x @ y.T
    left, right = ([np.frombuffer(e, np.uint64) for e in f["extras"]] for f in (odd, every))
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(common), 4096):
        some = common[at : at + 4096]
        grids = []
        for rows in (left, right):
            grid = np.zeros((len(rows), len(some)), dtype=np.float32)
            for k, row in enumerate(rows):
                grid[k, np.isin(some, row, assume_unique=True)] = 1
            grids.append(grid)
        shared += grids[0] @ grids[1].T
    n, m = odd["n"].to_numpy(), every["n"].to_numpy()
    good = _similar(np.rint(shared).astype(np.int64), n[:, None], m[None, :], percent)
    good &= odd["component"].to_numpy()[:, None] != every["component"].to_numpy()[None, :]
    return [(odd["b"].iat[i], every["b"].iat[j]) for i, j in zip(*np.nonzero(good))]


def _links_apart(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between members of one leader that are in different components, in blocks of BLOCK x BLOCK."""
    placed = members.join(found.select(F.col("v").alias("b"), "component"), "b", "left").withColumn(
        "component", F.coalesce("component", "b")
    )
    sizes = placed.groupBy("a", "component").count()
    groups = (
        sizes.groupBy("a")
        .agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("size"))
        .where("size > most")
        .select(
            "a",
            "major",
            F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("odd_blocks"),
        )
    )
    apart = stored(placed.drop("linked").join(groups, "a"), "apart")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    columns = ["a", "i", "j", "odd", "b", "component", "n", "bits", "extras"]
    odd = apart.where("component <> major").withColumn("odd", F.lit(True)).withColumn("i", place("odd_blocks")).withColumn("j", spread("blocks"))
    every = apart.withColumn("odd", F.lit(False)).withColumn("j", place("blocks")).withColumn("i", spread("odd_blocks"))
    partitions = shuffle_partitions(members.sparkSession)
    dealt = odd.select(columns).union(every.select(columns)).repartition(partitions, "a", "i", "j").sortWithinPartitions("a", "i", "j", "odd")

    def run(batches):
        def out(group: pd.DataFrame):
            first = ~group["odd"].to_numpy(dtype=bool)
            every, odd = group[first], group[~first]
            return _links_between(odd, every, percent) if len(odd) and len(every) else []

        held = None
        for frame in batches:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            new = (frame[["a", "i", "j"]] != frame[["a", "i", "j"]].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            links = [x for s, e in zip(starts[:-1], starts[1:]) for x in out(frame.iloc[s:e])]
            held = frame.iloc[starts[-1] :] if len(starts) else None
            yield pd.DataFrame(links, columns=["a", "b"])
        if held is not None and len(held):
            yield pd.DataFrame(out(held), columns=["a", "b"])

    return dealt.mapInPandas(run, "a binary, b binary")


def classes(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, fp, n_shingles, component_id, kept of every row of ``documents``.

    Documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more.
    """
    spark = documents.sparkSession
    rows = stored(sketches(documents, words, percent), "sketches")
    sets = (
        rows.where("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "fp", "n_shingles", "bands")).alias("s"))
    )
    spread = sets.select(
        "set_id", "s.doc_id", "s.fp", F.posexplode("s.bands").alias("band", "key")
    )
    shared = spread.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(spread.join(shared, ["band", "key"]), "members")

    degree = members.groupBy("set_id").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "set_id")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("degree", "set_id")).alias("l"))
    pairs = (
        members.join(leaders, ["band", "key"])
        .where(F.col("l.set_id") != F.col("set_id"))
        .select(F.col("l.set_id").alias("a"), F.col("set_id").alias("b"))
        .distinct()
    )
    involved = members.select("doc_id", "fp", "set_id").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = stored(
        documents.where("doc_id is not null")
        .select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text"))
        .join(involved, ["doc_id", "fp"])
        .groupBy("set_id")
        .agg(F.first("text").alias("text")),
        "texts",
    )
    release(spark)
    compared = stored(_compared(pairs, texts, words, percent), "compared")
    first = compared.where("linked").select("a", "b")
    found = stored(components(first), "components")
    second = stored(_links_apart(compared, found, percent), "links")
    if not second.isEmpty():
        found = stored(components(first.union(second)), "components")

    own = sets.select("set_id", F.col("s.doc_id").alias("least")).join(
        found.withColumnRenamed("v", "set_id"), "set_id", "left"
    ).select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    heads = own.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = own.join(heads, "component").select("set_id", "component_id")
    linked = rows.select("doc_id", "fp", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return linked.join(by_set, "set_id", "left").select(
        "doc_id",
        "fp",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class, with its own columns."""
    removed = classes(documents, words, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    return documents.join(
        removed,
        (documents["doc_id"] == F.col("_id")) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col("_fp")),
        "left_anti",
    )

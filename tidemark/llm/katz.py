"""LM scoring with Katz backoff: Good-Turing discounts, exactly normalised backoff weights.

Tokens are lower-cased words and one end mark a text.  With c the training counts, V words
seen and N tokens:

    P(w)     = d1(c(w)) c(w) / (N + 1)                 if c(w) > 0
             = 1 - sum of these over all seen words    for the one unknown symbol
    P(w | h) = d2(c(h, w)) c(h, w) / (c(h) + 1)        if c(h, w) > 0
             = alpha(h) P(w)                           else; alpha(h) = 1 for an unseen h
    alpha(h) = (1 - sum of P(w | h) over seen pairs) / (1 - sum of P(w) over seen pairs)

The first word of a text has a start mark as its history.  The "+ 1" is one pseudo event
of every history (and of the corpus), so that mass is left even where every count is
above the discounted ones (r > 5).  Discounts are Good-Turing's over smoothed counts of
counts (Simple Good-Turing: a log-linear fit over n1..n6), so one odd count of counts changes
no method.  Only where the fit falls no faster than 1/r (a closed vocabulary seen often, or
hardly any text) it gives no discounts between 0 and 1; absolute ones (n1 / (n1 + 2 n2)) are
used then, and a warning is logged.

How it runs.  Texts are read twice.  A task gathers some million tokens as a block and sends
each bucket one compressed row: distinct words or pairs, with the documents that have
them; so a frequent word or pair is one entry a block.
1. Words, bucketed by word: counts, counts of counts, and for each pair bucket the counts
   of the words it will need.  Stored as a table partitioned by kind.  The number of buckets
   follows from the size of the corpus.
2. Pairs, bucketed by a hash of the history and a hash of the word (a history with a large
   share of all pairs is spread over many buckets), meet those counts: pair counts, the
   parts of alpha(h) by history, and partial sums by document, given out block by block.
   Stored likewise.
3. Backed-off tokens meet alpha(h) by a join; sums by document.
Only N, V and the counts of counts reach the driver.

Words are compared as words.  Histories of backed-off tokens are joined by a 64-bit hash.

Defined cases: null is the empty text (its end mark is its only token); every row is
counted and scored by itself, whatever ids it shares or lacks; without training texts every token is the unknown symbol with
probability 1; an empty table gives an empty result.
"""

import contextlib
import ctypes
import logging
import math
import pickle
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored

_LOG = logging.getLogger(__name__)

END, START = b" ", b"  "
CUT = 5  # counts above it are not discounted
BLOCK_TOKENS = 1_000_000
BUCKET_BYTES = 16 << 20  # bytes of text for each bucket of words and of pairs

_OUT = (
    "kind string, bucket int, data binary, block long, n int, doc_id long, h long, tokens long, known long, "
    "base long, score long, n1 int, n2 int, n3 int, n4 int, n5 int, n6 int, large long, p double"
)
_UNIT = 1e9  # sums by document are kept in billionths: whole numbers add up alike in any order
_COLUMNS = [part.split()[0] for part in _OUT.split(", ")]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _pack(words: list[bytes], **arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps((b"\n".join(words), arrays), protocol=5))


def _unpack(data: bytes) -> tuple[list[bytes], dict[str, np.ndarray]]:
    words, arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return words.split(b"\n") if words else [], arrays


def _ranges(counts: np.ndarray) -> np.ndarray:
    """Positions 0..n-1 within each run."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def _give_back() -> None:
    """Hands memory that is free within the worker back to the system, as workers live long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


class _Block:
    """Tokens of some documents."""

    def __init__(self, number: int):
        self.number = number
        self.ids: defaultdict[bytes, int] = defaultdict(None, {END: 0, START: 1})
        self.ids.default_factory = self.ids.__len__
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, bool]] = []
        self.size = 0

    def add(self, doc_id, text: bytes, learn: bool) -> None:
        tokens = text.lower().split()
        tokens.append(END)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.docs.append((doc_id, learn))
        self.size += len(tokens)

    def close(self, grid: tuple[int, int]):
        self.words = list(self.ids)
        crc = np.array([zlib.crc32(w) for w in self.words], dtype=np.int64)
        self.row, self.column = crc % grid[0], (crc >> 16) % grid[1]
        self.ids.default_factory = None
        sizes = [len(p) for p in self.parts]
        self.w = np.concatenate(self.parts).astype(np.int64)
        self.parts.clear()
        self.d = np.repeat(np.arange(len(self.docs)), sizes)
        self.h = np.empty_like(self.w)
        self.h[1:] = self.w[:-1]
        self.h[np.concatenate([[0], np.flatnonzero(self.d[1:] != self.d[:-1]) + 1])] = 1
        self.bucket = self.row[self.h] * grid[1] + self.column[self.w]
        self.learn = np.array([learn for _, learn in self.docs])
        return self

    def word_rows(self, grid: tuple[int, int], buckets: int):
        """(bucket of words, words with their training counts and the pair buckets that need them)."""
        n, pairs = len(self.words), grid[0] * grid[1]
        count = np.bincount(self.w, weights=self.learn[self.d], minlength=n).astype(np.int64)
        need = np.unique(np.concatenate([self.w, self.h]) * pairs + np.concatenate([self.bucket, self.bucket]))
        need_word, need_bucket = need // pairs, need % pairs
        place = np.array([zlib.crc32(w, 1) % buckets for w in self.words])
        place[1] = place[0]  # the start mark has the count of the end mark
        order = np.argsort(place, kind="stable")
        per_word = np.bincount(need_word, minlength=n)
        first = np.cumsum(per_word) - per_word
        for chosen in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            picked = np.repeat(first[chosen], per_word[chosen]) + _ranges(per_word[chosen])
            yield int(place[chosen[0]]), _pack(
                [self.words[k] for k in chosen], count=_small(count[chosen]), needs=_small(per_word[chosen]), need=_small(need_bucket[picked])
            )

    def pair_rows(self, grid: tuple[int, int]):
        """(pair bucket, distinct pairs with the documents that have them)."""
        n, docs = len(self.words), len(self.docs)
        order = np.argsort(self.bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(self.bucket[order])) + 1):
            code, times = np.unique((self.h[at] * n + self.w[at]) * docs + self.d[at], return_counts=True)
            pair, doc = code // docs, code % docs
            pair, per_pair = np.unique(pair, return_counts=True)
            ended = np.unique(doc[np.repeat(pair % n == 0, per_pair)])  # a document's id goes where its end mark goes
            ids = [self.docs[k][0] for k in ended]
            words, local = np.unique(np.concatenate([pair // n, pair % n]), return_inverse=True)
            there, doc = np.unique(doc, return_inverse=True)
            yield int(self.bucket[at[0]]), _pack(
                [self.words[k] for k in words],
                h=_small(local[: len(pair)]),
                w=_small(local[len(pair) :]),
                per_pair=_small(per_pair),
                doc=_small(doc),
                times=_small(times),
                block=np.array(self.number),
                there=_small(np.diff(there, prepend=0)),
                learn=self.learn[there],
                ended=_small(np.searchsorted(there, ended)),
                ids=np.diff(np.array([0 if i is None else i for i in ids], dtype=np.int64), prepend=0),
                none=np.array([i is None for i in ids], dtype=bool),
            )


def _blocks(documents: DataFrame, learn: Column, grid: tuple[int, int], buckets: int, pairs: bool) -> DataFrame:
    def run(batches):
        def out(block):
            block.close(grid)
            rows = block.pair_rows(grid) if pairs else block.word_rows(grid, buckets)
            return pd.DataFrame(list(rows), columns=["bucket", "data"])

        number = TaskContext.get().partitionId() << 24  # the same if the task runs again
        block = _Block(number)
        for frame in batches:
            none = frame["doc_id"].isna()
            for doc_id, text, learned, null in zip(frame["doc_id"], frame["text"], frame["learn"], none):
                block.add(None if null else int(doc_id), text.encode(), bool(learned))
                if block.size >= BLOCK_TOKENS:
                    done, number = out(block), number + 1
                    block = _Block(number)
                    _give_back()
                    yield done
        if block.size:
            yield out(block)

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn")).mapInPandas(
        run, "bucket int, data binary"
    )


_TYPES = {"kind": object, "data": object, "p": np.float64, "doc_id": "Int64"} | dict.fromkeys(("bucket", "n", "n1", "n2", "n3", "n4", "n5", "n6"), np.int32)


def _frame(pieces: list[dict]) -> pd.DataFrame:
    """Pieces (column: array, or one value for all rows) one after the other; what a piece lacks is 0."""
    sizes = [next(len(v) for v in piece.values() if hasattr(v, "shape") and len(v.shape)) for piece in pieces]
    columns = {}
    for name in _COLUMNS:
        kind = _TYPES.get(name, np.int64)
        blank = "" if name == "kind" else b"" if name == "data" else 0
        if name == "doc_id":
            values = pd.array(np.zeros(sum(sizes), dtype=np.int64), dtype="Int64")
        else:
            values = np.full(sum(sizes), blank, dtype=kind)
        at = 0
        for piece, size in zip(pieces, sizes):
            if name in piece:
                values[at : at + size] = piece[name]
            at += size
        columns[name] = values
    return pd.DataFrame(columns)


def _word_counts(documents: DataFrame, learn: Column, grid: tuple[int, int], buckets: int) -> DataFrame:
    """kind = stat: N (tokens), V (known), n1..n6, large; kind = need: the table of counts, by pair bucket."""
    pairs = grid[0] * grid[1]

    def run(key, frame):
        ids: dict[bytes, int] = {}
        own, counts, need_word, need_bucket = [], [], [], []
        for data in frame["data"]:
            words, x = _unpack(data)
            place = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
            own.append(place)
            counts.append(x["count"])
            need_word.append(np.repeat(place, x["needs"]))
            need_bucket.append(x["need"].astype(np.int64))
        total = np.bincount(np.concatenate(own), weights=np.concatenate(counts), minlength=len(ids)).astype(np.int64)
        if START in ids:
            total[ids[START]] = 0
        known = total[total > 0]
        by = np.bincount(np.minimum(known, CUT + 2), minlength=CUT + 3)
        words = list(ids)
        rows = [
            {"kind": "stat", "tokens": int(known.sum()), "known": len(known), "large": int(known[known > CUT].sum())}
            | {f"n{r}": int(by[r]) for r in range(1, CUT + 2)},
        ]
        if START in ids:
            total[ids[START]] = total[ids[END]]
        need = np.unique(np.concatenate(need_bucket) * len(ids) + np.concatenate(need_word))
        target, word = need // len(ids), need % len(ids)
        for chosen in np.split(np.arange(len(need)), np.flatnonzero(np.diff(target)) + 1) if len(need) else []:
            rows.append(
                {"kind": "need", "bucket": int(target[chosen[0]]), "data": _pack([words[k] for k in word[chosen]], count=_small(total[word[chosen]]))}
            )
        return pd.DataFrame(rows, columns=_COLUMNS)

    blocks = _blocks(documents, learn, grid, buckets, False)
    return stored(blocks.groupBy("bucket").applyInPandas(run, _OUT), "word-counts", "kind")


def slope(n: list[int]) -> float | None:
    """b of the log-linear fit log Z(r) = a + b log r; None where fewer than two counts of counts are known.

    Z(r) spreads n(r) over the unseen counts around r (Simple Good-Turing).
    """
    there = [r for r, count in enumerate(n, 1) if count]
    if len(there) < 2:
        return None
    z = [n[r - 1] / (0.5 * (t - q)) for q, r, t in zip([0, *there], there, [*there[1:], 2 * there[-1] - there[-2]])]
    return float(np.polyfit(np.log(there), np.log(z), 1)[0])


def discounts(n: list[int]) -> list[float]:
    """d(1)..d(CUT) from the counts of counts n1..n(CUT + 1)."""
    b = slope(n)
    if b is not None and b < -1:  # then 0 < d(r) < 1 for every r
        common = (CUT + 1) ** (b + 1)
        return [(((r + 1) / r) ** (b + 1) - common) / (1 - common) for r in range(1, CUT + 1)]
    if any(n):
        _LOG.warning("counts of counts %s don't fall faster than 1/r: absolute discounts", n)
    take = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - take) / r for r in range(1, CUT + 1)]


class Unigrams:
    """P(w) as a function of c(w)."""

    def __init__(self, total: int, n: list[int], large: int):
        self.total, self.d = total, discounts(n)
        self.unknown = 1 - (sum(d * r * c for r, (d, c) in enumerate(zip(self.d, n), 1)) + large) / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        factor = np.array([0.0, *self.d, 1.0])[np.minimum(counts, CUT + 1)]
        return np.where(counts > 0, factor * counts / (self.total + 1), self.unknown)


def _counted(packed: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words (each in one of the packed tables) and their counts."""
    words, counts = [], []
    for data in packed:
        names, x = _unpack(data)
        words.append(pa.array(names, pa.binary()))
        counts.append(x["count"].astype(np.int64))
    return pa.concat_arrays(words), np.concatenate(counts)


def _pair_sums(blocks: DataFrame, need: DataFrame, unigrams: Unigrams, buckets: int) -> DataFrame:
    """kind = doc: sums; hist: parts of alpha; back: tokens to weigh by alpha.

    In ``doc`` n1..n5 count the tokens whose pair was seen r times, as their discount is
    known only when all pairs are counted; n6 of ``hist`` is not used.
    """

    def bucket(needed: list[bytes], held: list[bytes]):
        """Output frames of one bucket out of its packed counts and packed blocks."""
        names, c1 = _counted(needed)
        needed.clear()
        places, parts = [], []
        for data in held:
            words, x = _unpack(data)
            places.append(pa.array(words, pa.binary()))
            parts.append(x)
        held.clear()
        place = np.split(
            pc.index_in(pa.chunked_array(places, pa.binary()), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64),
            np.cumsum([len(p) for p in places])[:-1],
        )
        places.clear()
        size = len(names)
        parts = [(at[x["h"]] * size + at[x["w"]], x) for at, x in zip(place, parts)]
        del place
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        where = where.astype(np.int32)
        starts = np.cumsum([0, *(len(p) for p, _ in parts)])
        parts = [x for _, x in parts]
        c2 = np.zeros(len(pairs), dtype=np.int64)
        for at, x in zip(starts, parts):
            first = np.cumsum(x["per_pair"].astype(np.int64)) - x["per_pair"]
            own = where[at : at + len(x["h"])]  # distinct within a block
            c2[own] += np.add.reduceat(x["times"] * x["learn"][x["doc"]].astype(np.int64), first)
        h, w = pairs // size, pairs % size
        p1 = unigrams(c1)
        log_p1 = np.log10(p1)
        hashed = np.zeros(size, dtype=np.uint64)
        kinds = np.unique(h)
        hashed[kinds] = np.fromiter(
            (xxhash.xxh3_64_intdigest(name.as_py()) for name in names.take(pa.array(kinds))), dtype=np.uint64, count=len(kinds)
        )
        hashed = hashed.view(np.int64)

        seen = c2 > 0
        middle = int(seen.sum())
        if middle:
            kinds, group = np.unique(h[seen], return_inverse=True)
            count = c2[seen]
            sums = {f"n{r}": np.bincount(group, weights=count == r).astype(np.int64) for r in range(1, CUT + 2)}
            sums["large"] = np.bincount(group, weights=np.where(count > CUT, count, 0)).astype(np.int64)
            sums["p"] = np.bincount(group, weights=p1[w[seen]])
            yield _frame([{"kind": "hist", "h": hashed[kinds], **sums}])

        # A pair's share of a document's sums; alpha of a seen history comes later.
        back = ~seen & (c1[h] > 0)
        logs = np.where(seen, np.log10(np.maximum(c2, 1)) - np.log10(c1[h] + 1.0), log_p1[w])
        base = np.log10(c1[w] + 1.0)
        for at, x in zip(starts, parts):
            pair = np.repeat(where[at : at + len(x["h"])], x["per_pair"])
            doc, times, n = x["doc"], x["times"].astype(np.float64), len(x["there"])
            whole = lambda v: np.rint(np.bincount(doc, weights=times * v, minlength=n)).astype(np.int64)
            ids_ = pd.array(np.zeros(n, dtype=np.int64), dtype="Int64")
            ids_[:] = pd.NA
            ids_[x["ended"]] = pd.array(np.where(x["none"], 0, np.cumsum(x["ids"])), dtype="Int64")
            ids_[x["ended"][x["none"]]] = pd.NA
            row, c, block = np.cumsum(x["there"].astype(np.int32), dtype=np.int32), c2[pair], np.int64(x["block"])
            frames = [
                {"kind": "doc", "block": block, "n": row, "doc_id": ids_, "tokens": whole(1.0), "known": whole(c1[w[pair]] > 0), "base": whole(base[pair] * _UNIT), "score": whole(logs[pair] * _UNIT)}
                | {f"n{r}": whole(c == r) for r in range(1, CUT + 1)}
            ]
            off = np.flatnonzero(back[pair])
            if len(off):
                code, group = np.unique(h[pair[off]] * n + doc[off], return_inverse=True)
                frames.append(
                    {"kind": "back", "block": block, "n": row[code % n], "h": hashed[code // n], "tokens": np.rint(np.bincount(group, weights=times[off])).astype(np.int64)}
                )
            yield _frame(frames)

    def run(batches):
        at, needed, held = None, [], []
        for frame in batches:
            for number, first, data in zip(frame["bucket"], frame["first"], frame["data"]):
                if number != at:
                    if held:
                        yield from bucket(needed, held)
                        _give_back()
                    at, needed, held = number, [], []
                (needed if first else held).append(data)
        if held:
            yield from bucket(needed, held)
            _give_back()

    # One partition a bucket; the counts come before the blocks, and a task gives its frames out one by one.
    rows = need.select("bucket", F.lit(True).alias("first"), "data").union(blocks.select("bucket", F.lit(False), "data"))
    ordered = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.desc("first"))
    return stored(ordered.mapInPandas(run, _OUT), "pair-sums", "kind")


def score(documents: DataFrame, learn: Column, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``learn`` is a condition on the rows to learn from.  ``buckets`` follows from the bytes of
    all texts (one for each ``BUCKET_BYTES``), as a bucket is held in memory.
    """
    spark = documents.sparkSession
    if buckets is None:
        size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
    columns = max(1, math.isqrt(buckets) * 2 // 3)
    grid = (-(-buckets // columns), columns)

    words = _word_counts(documents, learn, grid, buckets)
    release(spark)
    n = [f"n{r}" for r in range(1, CUT + 2)]
    stat = words.where("kind = 'stat'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "large", *n)]).first()
    unigrams = Unigrams(stat["tokens"], [stat[c] for c in n], stat["large"])

    sums = _pair_sums(_blocks(documents, learn, grid, buckets, True), words.where("kind = 'need'"), unigrams, grid[0] * grid[1])
    release(spark)
    histories = sums.where("kind = 'hist'")
    pair = histories.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n]).first()
    d2 = discounts([pair[c] for c in n])
    seen = sum((F.lit(r) * F.col(f"n{r}") for r in range(1, CUT + 1)), F.lit(0)) + F.col("large")
    given = sum((F.lit(d * r) * F.col(f"n{r}") for r, d in enumerate(d2, 1)), F.lit(0.0)) + F.col("large")
    alpha = (
        histories.groupBy("h")
        .agg(*[F.sum(c).alias(c) for c in (*n[:CUT], "large", "p")])
        .select("h", F.log10((1 - given / (seen + 1)) / (1 - F.col("p"))).alias("alpha"))
    )
    backed = (
        sums.where("kind = 'back'")
        .select("block", "n", "h", "tokens")
        .join(alpha, "h")
        .groupBy("block", "n")
        .agg(F.sum(F.col("tokens") * F.col("alpha")).alias("score"))
    )
    own = F.col("score") / _UNIT + sum((F.col(f"n{r}") * math.log10(d) for r, d in enumerate(d2, 1)), F.lit(0.0))
    parts = (
        sums.where("kind = 'doc'")
        .groupBy("block", "n")
        .agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score", *n[:CUT])])
        .select("block", "n", "doc_id", "tokens", "known", "base", own.alias("score"))
    )
    floor = math.log10(stat["tokens"] + stat["known"] + 1)
    return parts.join(backed.withColumnRenamed("score", "more"), ["block", "n"], "left").select(
        "doc_id",
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(stat["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") / _UNIT - F.col("tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )

"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of a text with feature vector x is

    sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost one pass over the features (the sum-of-squares
identity).  Three feature groups share one hashed space, each with a fixed length:
hashed words with their shapes, binned structure statistics, and binned metadata
(numeric columns named by the caller).

Fitting is bounded: about ``max_rows`` labelled rows, chosen by a hash of the id, are
gathered on the driver.  Scoring reads every row and needs no shuffle; the model has a
fixed size (``2**bits * (factors + 1)`` floats) whatever the corpus.

Defined cases: null and empty texts are scored from structure and metadata alone; null
metadata has a bin of its own; repeated rows are scored one by one; several labels of
one id are averaged; null labels and labels without a document are ignored; without any
label the model is all zero and every score is 0.5.
"""

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
FACTORS = 8
MAX_ROWS = 12_000
THRESHOLD = 0.7
_STEPS = 1000  # batches at least; never fewer than 4 rounds over the sample
_BATCH = 64
_MEMO = 200_000  # words remembered per task; the memo starts anew beyond that

_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>@~^_=+{}[]\\/"
_STOP = b"!?.,;:"


class Features:
    """Turns a text and its metadata into indices and values of the hashed space."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.memo: dict[bytes, tuple[int, int]] = {}

    def _index(self, name: bytes) -> int:
        return zlib.crc32(name) & self.mask

    def _word(self, word: bytes) -> tuple[int, int]:
        shape = word.translate(_SHAPE)
        short = shape[:1]
        for b in range(1, len(shape)):
            if shape[b] != shape[b - 1]:
                short += shape[b : b + 1]
        return self._index(b"w:" + word.lower()), self._index(b"s:" + short[:12])

    def __call__(self, text: bytes, meta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, n = self.memo, len(tokens)
        pairs = np.empty((n, 2), dtype=np.int64)
        for k, word in enumerate(tokens):
            got = memo.get(word)
            if got is None:
                got = memo[word] = self._word(word)
            pairs[k] = got
        parts, values = [], []
        for column in (0, 1):
            index, count = np.unique(pairs[:, column], return_counts=True)
            value = np.log1p(count)
            parts.append(index)
            values.append(value / max(np.sqrt((value**2).sum()), 1e-12))
        for group, names in ((b"t:", self._structure(text, tokens, pairs[:, 0])), (b"m:", self._metadata(meta))):
            index = np.array([self._index(group + name) for name in names], dtype=np.int64)
            parts.append(index)
            values.append(np.full(len(index), 2 / max(np.sqrt(len(index)), 1.0)))
        return np.concatenate(parts), np.concatenate(values).astype(np.float32)

    @staticmethod
    def _structure(text: bytes, tokens: list[bytes], ids: np.ndarray) -> list[bytes]:
        n, size = max(len(tokens), 1), max(len(text), 1)
        lines = text.split(b"\n")
        ratios = {
            b"same": float((ids[1:] == ids[:-1]).sum()) / n,
            b"kinds": len(np.unique(ids)) / n,
            b"upper": (size - len(text.translate(None, _UPPER))) / size,
            b"digit": (size - len(text.translate(None, _DIGIT))) / size,
            b"symbol": (size - len(text.translate(None, _SYMBOL))) / n,
            b"stop": (size - len(text.translate(None, _STOP))) / n,
            b"shout": text.count(b"!!") / n,
            b"lines": len(set(lines)) / len(lines),
            b"bar": text.count(b" | ") / n,
        }
        names = [b"%s=%d" % (name, int(15.99 * min(1.0, r) ** 0.5)) for name, r in ratios.items()]
        names.append(b"words=%d" % int(np.log2(n) * 2))
        names.append(b"long=%d" % min(30, int(sum(map(len, tokens)) / n * 2)))
        return names

    @staticmethod
    def _metadata(meta: Sequence[float]) -> list[bytes]:
        return [
            b"%d=none" % k if v is None or v != v else b"%d=%d" % (k, int(np.sign(v) * np.log2(1 + abs(v))))
            for k, v in enumerate(meta)
        ]


@dataclass
class FactorisationMachine:
    bits: int
    bias: float
    weights: np.ndarray  # 2**bits
    factors: np.ndarray  # 2**bits x k

    @classmethod
    def zero(cls, bits: int = BITS, factors: int = FACTORS) -> "FactorisationMachine":
        return cls(bits, 0.0, np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32))

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows laid end to end (``starts`` has the first position of each) and sum_i v_i x_i."""
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx**2).sum(axis=1), starts)
        linear = np.add.reduceat(self.weights[index] * value, starts)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares), total

    def fit(self, rows: list[tuple[float, np.ndarray, np.ndarray]], seed: int = 7) -> "FactorisationMachine":
        """AdaGrad on the logistic loss over rows (label, indices, values)."""
        rng = np.random.default_rng(seed)
        self.factors = rng.normal(0, 0.05, self.factors.shape).astype(np.float32)
        share = np.clip(np.mean([y for y, _, _ in rows]), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_w = np.full(self.weights.shape, 1e-3, np.float32)
        seen_v = np.full(self.factors.shape, 1e-3, np.float32)
        for _ in range(max(4, -(-_STEPS * _BATCH // len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), _BATCH):
                batch = [rows[k] for k in order[at : at + _BATCH]]
                label = np.array([y for y, _, _ in batch])
                sizes = np.array([len(i) for _, i, _ in batch])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                index = np.concatenate([i for _, i, _ in batch])
                value = np.concatenate([v for _, _, v in batch])
                logit, total = self.logits(index, value, starts)
                slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label).astype(np.float32)
                per = np.repeat(slope, sizes) * value
                grad_v = per[:, None] * (np.repeat(total, sizes, axis=0) - self.factors[index] * value[:, None])
                by = np.argsort(index, kind="stable")
                kinds, first = np.unique(index[by], return_index=True)
                gw = np.add.reduceat(per[by], first) / len(batch) + 1e-6 * self.weights[kinds]
                gv = np.add.reduceat(grad_v[by], first) / len(batch) + 1e-5 * self.factors[kinds]
                seen_w[kinds] += gw**2
                seen_v[kinds] += gv**2
                self.weights[kinds] -= 0.3 * gw / np.sqrt(seen_w[kinds])
                self.factors[kinds] -= 0.1 * gv / np.sqrt(seen_v[kinds])
                self.bias -= 0.1 * float(slope.mean())
        return self

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, value, starts)[0].astype(float), -30, 30)))


def _metadata_column(names: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{n}`").cast("double") for n in names]) if names else F.array().cast("array<double>")


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    metadata: Sequence[str] = ("n_chars",),
    label: str = "quality",
    max_rows: int = MAX_ROWS,
    bits: int = BITS,
    factors: int = FACTORS,
) -> FactorisationMachine:
    """Fits on labelled documents for which ``learn`` (a condition on doc_id) holds.

    ``max_rows`` bounds the sample (in expectation: rows are taken by a hash of the id).
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.avg(label).alias("y"))
    )
    share = min(1.0, max_rows / max(marked.count(), 1))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = (
        documents.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _metadata_column(metadata).alias("meta"))
        .join(F.broadcast(picked), "doc_id")  # max_rows rows, whatever the corpus
    )

    def extract(batches):
        features = Features(bits)
        for frame in batches:
            out = [features(t.encode(), m) for t, m in zip(frame["text"], frame["meta"])]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "y": frame["y"],
                    "i": [i.astype(np.int32).tobytes() for i, _ in out],
                    "v": [v.tobytes() for _, v in out],
                }
            )

    got = rows.mapInPandas(extract, "doc_id long, y double, i binary, v binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["i"], r["v"]))
    model = FactorisationMachine.zero(bits, factors)
    if not got:
        return model
    return model.fit(
        [(r["y"], np.frombuffer(r["i"], np.int32).astype(np.int64), np.frombuffer(r["v"], np.float32)) for r in got]
    )


def score(documents: DataFrame, model: FactorisationMachine, metadata: Sequence[str] = ("n_chars",)) -> Column:
    """A column with the score of each row of ``documents`` (columns text and ``metadata``)."""
    held = documents.sparkSession.sparkContext.broadcast((model.bits, model.bias, model.weights, model.factors))

    @F.pandas_udf("double")
    def scored(text: pd.Series, meta: pd.Series) -> pd.Series:
        machine = FactorisationMachine(*held.value)
        features = Features(machine.bits)
        out = np.empty(len(text))
        for at in range(0, len(text), 512):
            rows = [features(t.encode(), m) for t, m in zip(text[at : at + 512], meta[at : at + 512])]
            sizes = np.array([len(i) for i, _ in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out[at : at + 512] = machine.score(
                np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts
            )
        return pd.Series(out)

    return scored(F.coalesce(F.col("text"), F.lit("")), _metadata_column(metadata))

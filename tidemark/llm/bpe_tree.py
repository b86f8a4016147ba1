"""Byte-level BPE encoding and decoding as a tree reduction of a monoid.

Text.  A text is cut in halves down to leaves of ``LEAF`` characters; a leaf is split by
the pattern on its own.  Two neighbours are joined by matching again from the start of
the left's first unsafe piece until a match ends where a piece of the right ends: a match
depends only on what follows its start, so from there on the right's pieces are those of
the whole text.  A piece of the left is safe if it ends before the border (its match has
seen what stopped it) and its start is at least ``REACH`` characters before it (no fixed
alternative of the pattern was cut off).

Piece.  A piece is cut in halves down to ``SHORT`` bytes.  Tokens t1..tn are the encoding
of their bytes if, for every neighbouring pair, the encoding of the pair's bytes is the
pair itself (the first merge across a border of the whole would also happen in the pair
alone, as merges within a token don't look beyond it).  So two halves are joined by encoding
a window around the border again, one token wider on each side each time, until both
borders of the window pass that test; outside tokens then can't change.

Decoding concatenates token bytes up the same tree.

Every row is encoded by one task without a shuffle.  Pieces seen before in a task are
looked up in a memo of bounded size.

Defined cases: null is the empty text, which has no tokens; repeated rows are encoded
alike; texts and single pieces of any length are encoded whole; other columns of the input
are not read.
"""

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 1 << 14
SHORT = 64
REACH = 3  # characters of the pattern's longest fixed alternative ('ll)
_MEMO = 200_000


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, short: int = SHORT):
        self.leaf, self.short = leaf, short
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.direct = merges._encode_single_piece  # the merges of one short run of bytes
        self.memo: dict[str, bytes] = {}

    # --- pieces

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.short:
            return self.direct(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def _stable(self, left: Sequence[int], right: Sequence[int]) -> bool:
        """Whether the border between two token lists holds (an empty side has none)."""
        if not left or not right:
            return True
        pair = [left[-1], right[0]]
        return self.direct(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == pair

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 0
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.direct(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))) if width else []
            before, after = left[:a], right[b:]
            if window:
                if self._stable(before, window) and self._stable(window, after):
                    return before + window + after
            elif self._stable(before, after):
                return before + after
            width = width * 2 or 1

    # --- texts

    def pieces(self, text: str) -> list[str]:
        """Pieces of the pattern, by tree reduction over positions."""
        ends = self._ends(text, 0, len(text))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def _ends(self, text: str, start: int, stop: int) -> list[int]:
        """Piece ends of text[start:stop] taken on its own."""
        if stop - start <= self.leaf:
            return [m.end() for m in self.pattern.finditer(text, start, stop)]
        middle = (start + stop) // 2
        left, right = self._ends(text, start, middle), self._ends(text, middle, stop)
        at = middle
        while left and (left[-1] == middle or at + REACH > middle):
            left.pop()
            at = left[-1] if left else start
        found, k = [], 0
        for match in self.pattern.finditer(text, at, stop):
            found.append(match.end())
            k = bisect_left(right, match.end(), k)
            if k < len(right) and right[k] == match.end():
                return left + found + right[k + 1 :]
        return left + found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, out = self.memo, []
        pieces = self.pattern.findall(text) if len(text) <= self.leaf else self.pieces(text)
        for piece in pieces:
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= self.short:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def round_trip(documents: DataFrame, rank_file: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``ids`` also the ids (binary)
    and the decoded text.

    ``rank_file`` is installed on every machine (or shared); it is read once per task.
    """

    def run(batches):
        codec = TreeCodec(read_ranks(rank_file), pattern)
        for frame in batches:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                encoded = [codec.encode(t) for t in part["text"]]
                decoded = [codec.decode(e) for e in encoded]
                out = {
                    "doc_id": part["doc_id"],
                    "n_tokens": [len(e) // 4 for e in encoded],
                    "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                }
                if ids:
                    out |= {"ids": encoded, "decoded": [d.decode() for d in decoded]}
                yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * ids
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)

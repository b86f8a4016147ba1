"""Token files: concatenated ids with Elias-Fano document boundaries.

A file holds the documents of a range of doc_id:

    magic "TDMKTOK1" | ids, 2 or 4 bytes each, little-endian | index | footer | footer length (8 bytes)

The index has two Elias-Fano sequences: the boundaries (n + 1 offsets into the ids, from 0 to
their number) and the doc ids (as distances from the smallest).  The footer is JSON with the
counts and the place of each part.  A sequence of n numbers up to u keeps their lowest
l = log2(u / n) bits packed and the rest as a bit vector with one set bit a number, in all
about n (2 + l) bits; every 256th set bit has its place in a 32-bit directory, so ``select``
reads a directory entry and a few words of bits.  There is no table of 64-bit offsets.

How it runs.  Texts are sorted by doc_id with one range shuffle (ties by the text, so rows
of one id are split too), each task encodes its range and streams the ids to files, rolled
at ``file_tokens`` ids.  A file is written under a temporary name and renamed when whole; a
task that runs again writes the same bytes under the same name.  The manifest is committed
last by Spark's own writer.  The start of a file in the whole sequence is a running sum over
the manifest.  Readers open only files the manifest lists.

A text is cut into chunks where the pre-tokenizer always cuts too: before white space that
follows another character (none of its tokens has white space but at its start or all through)
and between letters and an ASCII character that is none.  The tokenizers library encodes each
distinct chunk, a worker process remembers a bounded number of them from task to task, and the
ids are put together.
Strings that look like special tokens are ordinary text.

Defined cases: null is the empty text (its only id is the end id); rows with a null doc_id
come first, in the order of their texts, and are counted in the footer; repeated ids and rows
all have entries of their own; an empty table gives an empty manifest.
"""

import json
import os
import re
import sys
import uuid
import zlib
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.warc import _filesystem

MAGIC = b"TDMKTOK1"
SAMPLE = 256  # set bits from one directory entry to the next
FILE_TOKENS = 1 << 25
KNOWN = 1 << 20  # chunks a worker remembers
KNOWN_CHARS = 64  # longer ones are not remembered
READ_TOKENS = 1 << 20
_KEPT = "_tidemark_token_encoders"  # the entry of sys.modules that keeps a process's encoders
# A chunk ends before an ASCII blank, or after Latin letters before an ASCII character.  What both libraries
# take for white space never ends one; U+001C to U+001F are white space in Python alone.
_CHUNKS = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\x00-@\[-`{-\x7f])|\s*[^ \t\n\r]*[\S\x1c-\x1f]|\s+$")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")  # one piece to the pre-tokenizer
_CHUNK = 1 << 16  # numbers packed at once, a multiple of 8
_COUNTS = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other."""
    bits = np.arange(width, dtype=np.uint64)
    return b"".join(
        np.packbits(((values[k : k + _CHUNK, None] >> bits) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        for k in range(0, len(values) if width else 0, _CHUNK)
    )


class EliasFano:
    """Numbers in ascending order; ``select`` gives one, ``slice`` some of them."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, directory: np.ndarray):
        self.n, self.width, self.directory = n, width, directory
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = values >> np.uint64(width)
        places = high.astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) // 8 + 1) if n else 0, dtype=np.uint8)
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return cls(n, width, _pack(values, width), bits.tobytes(), places[::SAMPLE].astype(np.uint32))

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.directory.astype("<u4").tobytes()]

    def _low(self, first: int, stop: int) -> np.ndarray:
        if not self.width:
            return np.zeros(stop - first, dtype=np.uint64)
        at = first * self.width
        bits = np.unpackbits(self.low[at >> 3 : (stop * self.width + 7) >> 3], bitorder="little")
        bits = bits[at & 7 :][: (stop - first) * self.width].reshape(-1, self.width)
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _places(self, first: int, stop: int) -> np.ndarray:
        """Places of the set bits first .. stop - 1."""
        at = int(self.directory[first // SAMPLE])
        end = int(self.directory[(stop - 1) // SAMPLE + 1]) if (stop - 1) // SAMPLE + 1 < len(self.directory) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at >> 3 : (end >> 3) + 1], bitorder="little")
        bits[: at & 7] = 0
        return np.flatnonzero(bits)[first % SAMPLE :][: stop - first] + (at & ~7)

    def slice(self, first: int, stop: int) -> np.ndarray:
        if first >= stop:
            return np.zeros(0, dtype=np.uint64)
        high = (self._places(first, stop) - np.arange(first, stop)).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(first, stop)

    def select(self, k: int) -> int:
        """Number k: a directory entry, then bytes of set-bit counts, then one byte."""
        at = int(self.directory[k // SAMPLE])
        left, byte = k % SAMPLE, at >> 3
        mask = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while (there := int(_COUNTS[mask])) <= left:
            left -= there
            byte += 1
            mask = int(self.high[byte])
        for _ in range(left):
            mask &= mask - 1
        place = 8 * byte + (mask & -mask).bit_length() - 1
        return ((place - k) << self.width) | int(self._low(k, k + 1)[0])


def _signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: its own where that can be seen, else one above 255."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


_SIGNS = _signs()


class _Known(dict):
    """Ids of chunks, as bytes; a chunk that isn't there is encoded, and remembered while there is room."""

    def __init__(self, ids, kind: str):
        self.ids, self.kind = ids, kind

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.ids(chunk), dtype=self.kind).tobytes()
        if len(self) < KNOWN and len(chunk) <= KNOWN_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of texts by a file of the tokenizers library; made once a worker process.

    Texts are sequences of chunks; a chunk seen before is not given to the library again.
    A chunk of letters is one piece to the byte-level pre-tokenizer, so it goes to the library's
    model at once; the others take all its steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        cuts = self.tokenizer.pre_tokenizer
        plain = isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        self.model = self.tokenizer.model if plain and self.tokenizer.normalizer is None else None
        self.known = _Known(self._ids, self.kind)

    def _ids(self, chunk: str) -> list[int]:
        if self.model and _WORD.fullmatch(chunk):
            signs = chunk.encode().decode("latin-1").translate(_SIGNS)
            return [token.id for token in self.model.tokenize(signs)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    @classmethod
    def get(cls, path: str) -> "Encoder":
        """The encoder of this process; one for a file that has changed is made again.

        Each task brings its own copy of this folder's code, so what a class or module keeps
        lasts one task; an entry of ``sys.modules`` lasts as long as the process.
        """
        made = vars(sys.modules.setdefault(_KEPT, ModuleType(_KEPT)))
        stat = os.stat(path)
        key, stamp = os.path.abspath(path), (stat.st_mtime_ns, stat.st_size)
        if made.get(key, (None,))[0] != stamp:
            made[key] = stamp, cls(path)
        return made[key][1]

    def encode(self, text: str) -> bytes:
        return b"".join([*map(self.known.__getitem__, _CHUNKS.findall(text))])


class _Writer:
    """Files of one task, one after the other."""

    def __init__(self, folder: str, place: int, kind: str, limit: int):
        self.fs, self.root = _filesystem(folder)
        self.place, self.kind, self.limit, self.part, self.out = place, kind, limit, 0, None
        self.wide = np.dtype(kind).itemsize

    def add(self, doc_id: int | None, ids: bytes) -> dict | None:
        if self.out is None:
            self.name = f"tokens-{self.place:06d}-{self.part:05d}.bin"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.out.write(MAGIC)
            self.starts, self.docs, self.nulls = [0], [], 0
        self.out.write(ids)
        self.starts.append(self.starts[-1] + len(ids) // self.wide)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)
        return self.close() if self.starts[-1] >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        least = self.docs[0] if self.docs else 0
        parts = [EliasFano.of(np.array(self.starts, dtype=np.uint64))]
        parts.append(EliasFano.of((np.array(self.docs, dtype=np.int64).view(np.uint64) - np.array(least, dtype=np.int64).view(np.uint64))))
        at, places = len(MAGIC) + self.starts[-1] * self.wide, []
        for sequence in parts:
            sizes = []
            for data in sequence.parts():
                self.out.write(data)
                sizes.append(len(data))
            places.append({"at": at, "n": sequence.n, "width": sequence.width, "sizes": sizes})
            at += sum(sizes)
        footer = json.dumps({"kind": self.kind, "tokens": self.starts[-1], "nulls": self.nulls, "least": least, "starts": places[0], "docs": places[1]}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        row = {"file": self.name, "place": self.place, "part": self.part, "docs": len(self.starts) - 1, "tokens": self.starts[-1], "index_bytes": at - len(MAGIC) - self.starts[-1] * self.wide}
        self.out, self.part = None, self.part + 1
        return row


class TokenFile:
    """Random access to one file: ``span(k)`` and ``ids(k)`` of its k-th document."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.footer = json.loads(self.file.read_at(length, size - 8 - length))
        self.kind, self.tokens = np.dtype(self.footer["kind"]), self.footer["tokens"]
        self.starts, self._docs = (self._sequence(self.footer[name]) for name in ("starts", "docs"))
        self.n = self.starts.n - 1

    def _sequence(self, place: dict) -> EliasFano:
        low, high, directory = place["sizes"]
        data = self.file.read_at(low + high + directory, place["at"])
        return EliasFano(place["n"], place["width"], data[:low], data[low : low + high], np.frombuffer(data[low + high :], dtype="<u4"))

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        nulls = self.footer["nulls"]
        known = self._docs.slice(max(first - nulls, 0), max(stop - nulls, 0))
        return [None] * (min(stop, nulls) - min(first, nulls)) + [int(v) + self.footer["least"] for v in known]

    def span(self, k: int) -> tuple[int, int]:
        return self.starts.select(k), self.starts.select(k + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        wide = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * wide, len(MAGIC) + start * wide), dtype=self.kind)

    def ids(self, k: int) -> np.ndarray:
        return self.read(*self.span(k))

    def close(self) -> None:
        self.file.close()


_MANIFEST = "file string, place int, part int, docs long, tokens long, index_bytes long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _MANIFEST.split(", ")])


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes doc_id, text as token files; the manifest with the start of each file."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches):
        encoder = Encoder.get(tokenizer)
        writer = _Writer(folder, TaskContext.get().partitionId(), encoder.kind, file_tokens)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if done := writer.add(doc_id, encoder.encode(text.as_py()) + end):
                    yield pa.RecordBatch.from_pylist([done], schema=_ARROW)
        if last := writer.close():
            yield pa.RecordBatch.from_pylist([last], schema=_ARROW)

    ordered.drop("tie").mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    spark = documents.sparkSession
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files in the order of their documents, with ``start``: the ids of all files before."""
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; with ``with_ids`` also the ids."""
    listed = manifest(spark, folder)
    files = listed.repartition(max(1, min(spark.read.parquet(f"{folder}/manifest").count(), 4096)), "file").select("file", "start")

    def run(batches):
        fs, root = _filesystem(folder)
        for frame in batches:
            for name, base in zip(frame["file"], frame["start"]):
                tokens = TokenFile(fs, f"{root}/{name}")
                for first in range(0, tokens.n, SAMPLE):
                    stop = min(first + SAMPLE, tokens.n)
                    starts = tokens.starts.slice(first, stop + 1).astype(np.int64)
                    rows = _documents(tokens, starts, with_ids)
                    out = pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", *["ids"] * with_ids])
                    out.insert(0, "start", int(base) + starts[:-1])
                    out.insert(0, "doc_id", pd.array(tokens.doc_ids(first, stop), dtype="Int64"))
                    yield out
                tokens.close()

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _documents(tokens: TokenFile, starts: np.ndarray, with_ids: bool):
    """(number of ids, their crc32) of neighbouring documents; ids are read about a million at a time."""
    held, first = np.zeros(0, dtype=tokens.kind), 0
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        crc, kept = 0, []
        for at in range(start, stop, READ_TOKENS):
            upto = min(at + READ_TOKENS, stop)
            if upto > first + len(held):
                first, held = at, tokens.read(at, min(max(upto, at + READ_TOKENS), int(starts[-1])))
            ids = held[at - first : upto - first].astype("<u4")
            crc = zlib.crc32(ids.tobytes(), crc)
            if with_ids:
                kept.append(ids)
        yield (stop - start, crc, *([np.concatenate(kept).astype(np.int64)] if with_ids else []))

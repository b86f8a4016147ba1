"""WARC: a deterministic sharded writer and a reader.

Writing.  A lean table (page_id, bytes, digest) is stored first.  Records with equal payloads
of at least ``REVISIT_BYTES`` become revisits of the one with the smallest page_id (an
aggregation and a join on the digest, without the payloads).  Shards are ranges of
page_id of about ``shard_bytes`` each; their borders come from byte counts per range, refined
where one range is too heavy, so they depend on the data alone.  The payloads are shuffled
once, by shard, and sorted; revisit marks travel with them in the same sort, so no join
carries a payload.  A task rolls a new file when the compressed size reaches
``file_bytes``, writes under a temporary name and renames when the file is whole; every
record is a gzip member without a time stamp, and ids are name-based, so a retried or
speculative task writes the same bytes.  The manifest (file, records, bytes, SHA-256) is
committed last by Spark's own writer, and readers open only what it lists.

The folder is one that all executors share (``file:``, ``hdfs:``, ``s3a:`` ... as pyarrow
opens it).

Defined cases: null html is an empty payload; a null url becomes ``about:blank``; control
characters in a url are percent-encoded; payloads under ``REVISIT_BYTES`` are always
responses; rows that repeat the smallest page_id with an equal payload are all responses;
a null page_id sorts first, is never referred to, and revisits if an equal payload has an id;
an empty table gives an empty manifest.
"""

import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

REVISIT_BYTES = 100
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPLIT = 64  # a too heavy range is cut into so many


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\n", *(f"{k}: {v}\r\n" for k, v in headers)]
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n")
    return gzip.compress("".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def _page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, copy: int, date: str) -> bytes:
    target = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _record_id(f"{page_id}:{digest}:{copy}")),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(f"{refers_to}:{digest}:0")), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", headers, http)


class _Roller:
    """Files of one shard."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.fs, self.root = _filesystem(folder)
        self.shard, self.limit, self.date, self.part, self.out = shard, file_bytes, date, 0, None

    def add(self, record: bytes) -> dict | None:
        """Writes a record; the row of a file that this filled, if any."""
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
            self._put(_record("warcinfo", [("WARC-Record-ID", _record_id(self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        return self.close() if self.size >= self.limit else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.out, self.part = None, self.part + 1
        return {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def _shard_starts(lean: DataFrame, shard_bytes: int) -> np.ndarray:
    """First page_id of every shard but the first: cuts of about equal bytes, a function of the data alone."""
    ends = lean.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if ends[0] is None or not ends[2]:
        return np.array([], dtype=np.int64)
    low, high = ends[0], ends[1] + 1
    cuts = max(1024, 4 * -(-ends[2] // shard_bytes))
    starts = np.unique([low + (high - low) * k // cuts for k in range(cuts)])
    while True:
        edges = starts.tolist()
        place = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(np.array(edges), ids.to_numpy(), "right") - 1), "long")
        sizes = dict(lean.where("page_id is not null").groupBy(place("page_id").alias("k")).agg(F.sum("bytes")).collect())
        stops = [*edges[1:], high]
        heavy = [k for k, n in sizes.items() if n > shard_bytes and stops[k] - edges[k] > 1]
        if not heavy:
            break
        more = [edges[k] + (stops[k] - edges[k]) * i // _SPLIT for k in heavy for i in range(1, _SPLIT)]
        starts = np.unique(edges + more)
    chosen, size = [], 0
    for k, start in enumerate(edges):
        if size and size + sizes.get(k, 0) > shard_bytes:
            chosen.append(start)
            size = 0
        size += sizes.get(k, 0)
    return np.array(chosen, dtype=np.int64)


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes page_id, url, html as WARC files; the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    lean = stored(pages.select("page_id", F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest")), "payloads")
    firsts = (
        lean.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 and refers_to is not null")
    )
    marks = (
        lean.join(firsts, "digest")
        .where("page_id is null or page_id > refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    starts = _shard_starts(lean, shard_bytes)
    place = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(starts, ids.fillna(0).to_numpy().astype(np.int64), "right")), "int")
    shard = F.when(F.col("page_id").isNull(), 0).otherwise(place("page_id"))
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = rows.union(marks.select("page_id", F.lit(0), F.lit(None), F.lit(None), "digest", "refers_to")).withColumn("shard", shard)
    ordered = both.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "html")

    def run(batches):
        roller = None
        last, refers, copies = object(), {}, {}
        for frame in batches:
            done = []
            null = frame["page_id"].isna()
            for shard, page_id, none, kind, url, html, digest, refers_to in zip(
                frame["shard"], frame["page_id"], null, frame["kind"], frame["url"], frame["html"], frame["digest"], frame["refers_to"]
            ):
                page_id = None if none else int(page_id)
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        done.append(roller.close())
                    roller = _Roller(folder, int(shard), file_bytes, date)
                if page_id != last:
                    last, refers, copies = page_id, {}, {}
                if kind == 0:
                    refers[digest] = int(refers_to)
                    continue
                data = (html or "").encode()
                own = hashlib.sha256(data).hexdigest()
                copy = copies[own] = copies.get(own, -1) + 1
                done.append(roller.add(_page_record(page_id, url, data, own, refers.get(own), copy, date)))
            yield pd.DataFrame([d for d in done if d], columns=["file", "shard", "records", "bytes", "sha256"])
        if roller is not None and (end := roller.close()):
            yield pd.DataFrame([end])

    manifest = ordered.mapInPandas(run, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.parquet(f"{folder}/manifest")


def _members(stream, chunk: int = 1 << 20):
    """Decompressed gzip members, one at a time."""
    rest = b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            return
        member, parts = zlib.decompressobj(31), []
        while True:
            parts.append(member.decompress(data))
            if member.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the file ends within a record")
        rest = member.unused_data
        yield b"".join(parts)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    return headers, block


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record the
    manifest lists; with ``payloads`` also the payload (null for revisits)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 4096)), "file")

    def run(batches):
        fs, root = _filesystem(folder)
        for frame in batches:
            for name in frame["file"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for record in _members(stream):
                        headers, block = _parse(record)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']}")
                        own, other = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        row = {"page_id": int(own) if own else None, "url": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None}
                        if payloads:
                            row["payload"] = payload if kind == "response" else None
                        rows.append(row)
                        if len(rows) == 256:
                            yield _typed(rows)
                            rows = []
                    if rows:
                        yield _typed(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.mapInPandas(run, schema)


def _typed(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

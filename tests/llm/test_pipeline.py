"""The corpus pipeline and the classifier's query against plain Python, on the whole smallest tables."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import quality_fm, rules
from tidemark.llm.common import held_out
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def scores(spark, documents):
    """Score of each document with the interactions of all pairs of features summed one by one."""
    model = quality_fm.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out(F.col("doc_id"), 4))
    features, out = quality_fm.Features(model.bits), {}
    for row in documents.collect():
        index, value = features((row["text"] or "").encode(), [row["n_chars"]])
        vectors = model.factors[index].astype(float) * value[:, None]
        pairs = sum(float((vectors[k + 1 :] @ vectors[k]).sum()) for k in range(len(index)))
        logit = model.bias + float(model.weights[index].astype(float) @ value) + pairs
        out[row["doc_id"]] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return out


def test_classifier_query_against_all_pairs(spark, scores):
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_fm"](spark, SF).collect()}
    assert got.keys() == scores.keys()
    for doc_id, r in got.items():
        assert r["score"] == pytest.approx(scores[doc_id], abs=1e-4)
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.7)


def passes_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {p for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    stops = sum(w.lower() in rules.STOP_WORDS for w in words)
    return (
        2 <= sum(map(len, words)) / n <= 20
        and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.3
        and (len(lines) - len(set(lines))) / len(lines) <= 0.6
        and stops / n >= 0.02
    )


def least_of_component(rows):
    """Smallest id reachable over links of 0.8 or more of the five-word shingles."""
    sets = {}
    for doc_id, text in rows:
        w = text.encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = defaultdict(set)
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    least = {}
    for a in sorted(ids):
        left = [a]
        while left:
            x = left.pop()
            if x not in least:
                least[x] = a
                left += links[x]
    return least


def poisson(rate, doc_id, text):
    pieces, total = math.ceil(rate / 16), 0
    mean = rate / pieces
    for piece in range(1, pieces + 1):
        key = f"11:{piece}:{doc_id}:{hashlib.md5(text.encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / (1 << 52)
        p = below = math.exp(-mean)
        n = 0
        while u >= below:
            n += 1
            p *= mean / n
            below += p
        total += n
    return total


def test_pipeline_against_plain_python(spark, documents, scores):
    import corpus_pipeline

    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in documents.collect()]
    good = [r for r in rows if scores[r[0]] >= quality_fm.THRESHOLD]
    ruled = [r for r in good if passes_rules(r[1])]
    least = least_of_component([r[:2] for r in ruled])
    unique = [r for r in ruled if least[r[0]] == r[0]]
    assert len(rows) > len(good) > len(ruled) > len(unique) > 20
    sizes = Counter(r[2] for r in unique)
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, source in unique:
        rate = len(unique) * weights[source] / sum(weights.values()) / sizes[source]
        if copies := poisson(rate, doc_id, text):
            ids = plain.encode_ordinary(text)
            digests = (hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            want[doc_id, len(ids), *digests] += copies
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(tuple(r) for r in got) == want

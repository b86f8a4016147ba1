"""Prefix trie, periodic runs and token files against brute force, on odd rows and large groups."""

import hashlib
import os
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from tidemark.llm import periodic_runs, prefix_trie, token_files

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    return (turn is not None, turn or 0, digest), (role, text)


def brute_trie(rows):
    turns = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            turns[row[0]].append(turn_key(row))
    own = {c: [turn for _, turn in sorted(v)] for c, v in turns.items()}
    sequences = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - abs(c) % 5 * (1 if c > 0 else -1)
        sequences[c] = own.get(leader, [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(int), {}, {}
    for c, s in sequences.items():
        for depth in range(len(s) + 1):
            members[tuple(s[:depth])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = []
    for node in sorted(members, key=len, reverse=True):
        m = members[node]
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = sum(saved[k] for k in below[node]) + (len(m) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns(seed, ids, longest, vocabulary):
    r = random.Random(seed)
    rows = [
        (c, t, r.choice(["user", "assistant", None]), r.choice([f"w{r.randrange(vocabulary)}é", None, ""]))
        for c in ids
        for t in range(r.randint(1, longest))
    ]
    r.shuffle(rows)
    return rows


CONVERSATIONS = {
    "bushy": some_turns(1, range(60), 12, 2),
    "deep": some_turns(2, range(25), 70, 1),
    "signed and wide ids": some_turns(3, [*range(-20, 0), *(random.Random(5).randrange(-(2**62), 2**62) for _ in range(20))], 9, 2),
    "ties, nulls, repeats": [(1, None, "a", "x"), (1, None, "a", "x"), (1, 3, "b", "y"), (None, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "a", "z"), (0, 1, "ab", ""), (0, 2, "a", "b")],
    "empty": [],
    "equal": [(c, t, "u", f"t{t}") for c in range(0, 200, 5) for t in range(10)],
    "one holds most rows": [(7, t, "u", f"t{t % 3}") for t in range(700)] + [(5, t, "u", f"t{t % 3}") for t in range(500)] + [(10, 1, "u", "q")],
}


@pytest.mark.parametrize("case", CONVERSATIONS)
def test_trie(spark, case, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "LIST_PIECE", 3)
    rows = CONVERSATIONS[case]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted((tuple(r) for r in prefix_trie.prefixes(frame).select(*NODE).collect()), key=repr)
    assert got == brute_trie(rows)


def test_positions_across_partitions(spark):
    rows = [(k % 3 % 2, v) for k, v in enumerate(range(900))]
    frame = spark.createDataFrame(rows, "k long, v long")
    got = prefix_trie.numbered(frame, "k", ["v"], ["v"], "places").collect()
    for key in (0, 1):
        values = sorted(v for k, v in rows if k == key)
        assert sorted((r["pos"], r["v"]) for r in got if r["k"] == key) == list(enumerate(values))


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            whole = words[start : start + length]
            if length >= max(least, 2 * q) and all(whole[k:] != whole[:-k] for k in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 9), st.integers(0, 30))
def test_runs(words, period, copies):
    words = words + words[-period:] * copies
    for least in (2, 12):
        assert periodic_runs.runs(words, least) == brute_runs(words, least)
    assert periodic_runs.text_runs(np.array(words, dtype=np.int64)) == brute_runs(words)


def test_runs_of_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periodic_runs.runs([7] * 50_000) == [(0, 50_000, 1)]
    assert len(periodic_runs.runs(b)) > 1000
    block = random.Random(1).sample(range(10_000), 3000)
    assert periodic_runs.text_runs(np.array([1, 2, 3] + block * 7, dtype=np.int64)) == [(3, 21_000, 3000)]


def test_run_report(docs):
    lines = ["a b c " * 8 + "d", "x " * 40, "one two", "", None, "p q r s t u v w " * 3 + "p q zz", "é " * 13]
    rows = [(k, t) for k, t in enumerate(lines * 12)] + [(None, lines[0]), (2**60 + 1, lines[1]), (3, lines[1])]
    got = periodic_runs.report(docs(rows), repeat=True).collect()
    want = []
    for doc_id, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        want.append((doc_id, len(found), s, m, q, 1000 * m // q if m else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert periodic_runs.report(docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), min_size=1, max_size=700), st.data())
def test_elias_fano(values, data):
    values = np.sort(np.array(values, dtype=np.uint64))
    made = token_files.EliasFano.of(values)
    low, high, directory = made.parts()
    read = token_files.EliasFano(made.n, made.width, low, high, np.frombuffer(directory, dtype="<u4"))
    first = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(first, len(values)))
    assert (read.slice(first, stop) == values[first:stop]).all()
    k = data.draw(st.integers(0, len(values) - 1))
    assert read.select(k) == int(values[k])
    assert 8 * (len(low) + len(high)) <= len(values) * (made.width + 3) + 24


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def token_rows():
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["the", "naïve", "x1", "日本", "\n\n", "  "]) for _ in range(r.randint(0, 60)))) for k in range(-20, 80)]
    return rows + [(None, "b"), (None, None), (5, "again"), (5, "again"), (5, ""), (2**62, "far " * 40_000), (-(2**62), "<|endoftext|> a"), (7, "y" * 20_000)]


@pytest.mark.parametrize("limit", [50, 1 << 25])
def test_token_files(spark, docs, tmp_path, limit, monkeypatch):
    monkeypatch.setattr(token_files, "READ_TOKENS", 700)
    rows = token_rows()
    folder = f"file://{tmp_path}/tokens"
    listed = token_files.write(docs(rows), folder, TOKENIZER, 2, limit).orderBy("start").collect()
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    ids = lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 2]
    got = sorted(token_files.read(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got[:3]] == [True, True, False]
    known = [r["doc_id"] for r in got[2:]]
    assert known == sorted(i for i, _ in rows if i is not None)
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        start += r["n_tokens"]
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in got))) == sorted(map(repr, ((i, ids(t)) for i, t in rows)))
    assert sum(r["docs"] for r in listed) == len(rows) and listed[-1]["start"] + listed[-1]["tokens"] == start
    fs, root = token_files._filesystem(folder)
    at = 0
    for r in listed:
        one = token_files.TokenFile(fs, f"{root}/{r['file']}")
        for k in range(one.n):
            assert one.ids(k).tolist() == got[at]["ids"] and one.doc_ids(k, k + 1) == [got[at]["doc_id"]]
            at += 1
        one.close()
    assert not (tmp_path / "tokens/_temporary").exists()


def test_no_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write(docs([]), folder, TOKENIZER, 2).count() == 0
    assert token_files.read(spark, folder).count() == 0


def test_a_worker_keeps_its_encoder_from_task_to_task(spark):
    def run(batches):
        encoder = token_files.Encoder.get(TOKENIZER)
        known = "zqxjvk" in encoder.known
        time.sleep(sum(batch.num_rows for batch in batches) * 0.05)
        encoder.encode("zqxjvk.")
        yield pa.RecordBatch.from_pylist([{"worker": os.getpid(), "known": known}])

    cores = spark.sparkContext.defaultParallelism
    tasks = spark.range(0, 4 * cores, 1, 4 * cores).mapInArrow(run, "worker long, known boolean").collect()
    assert len(tasks) == 4 * cores > len({t["worker"] for t in tasks})
    assert sorted(t["worker"] for t in tasks if not t["known"]) == sorted({t["worker"] for t in tasks})


def test_letters_go_to_the_model_at_once_with_the_same_ids(monkeypatch):
    encoder, plain = token_files.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    letters = [c for c in map(chr, range(0x400)) if token_files._WORD.fullmatch(c)]
    assert sorted(token_files._SIGNS.values()) == sorted(pre_tokenizers.ByteLevel.alphabet())
    r = random.Random(4)
    words = [*letters, *(" " + c for c in letters)]
    words += [r.choice(["", " "]) + "".join(r.choice(letters if k % 2 else "etaoinsr") for _ in range(r.randint(2, 12))) for k in range(3000)]
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert all(len(plain.pre_tokenizer.pre_tokenize_str(w)) == 1 for w in words)
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert [encoder._ids(w) for w in words] == want


def test_other_tokenizers_take_all_their_steps(tmp_path):
    file = str(tmp_path / "lower.json")
    other = Tokenizer(models.BPE({"a": 0, "b": 1, "Ġ": 2}, []))
    other.normalizer, other.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(file)
    encoder = token_files.Encoder(file)
    assert encoder.model is None and np.frombuffer(encoder.encode("A bB"), encoder.kind).tolist() == [0, 2, 1, 1]


def test_a_changed_tokenizer_file_is_read_again(tmp_path):
    file = tmp_path / "tokenizer.json"
    made = []
    for vocab in ({"a": 0, "b": 1}, {"a": 5, "b": 1, "c": 2}):
        Tokenizer(models.BPE(vocab, [])).save(str(file))
        made.append(token_files.Encoder.get(str(file)).encode("a"))
        assert token_files.Encoder.get(str(file)) is token_files.Encoder.get(str(file))
    assert made == [b"\x00\x00", b"\x05\x00"]


def test_long_texts_are_cut_where_the_pre_tokenizer_cuts(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 200)
    encoder = token_files.Encoder(TOKENIZER)
    r = random.Random(9)
    signs = ["ab1 .,'s\n\t日é  ", "aB'slltve !?-\r\n ", "aé²3½\u0301ж\x1c\x85\xa0\u2028 .", " \n\t\r\x0b\x0c\x00a'"]
    texts = ["".join(r.choice(signs[k % 4]) for _ in range(r.randint(0, 300))) for k in range(8000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 200

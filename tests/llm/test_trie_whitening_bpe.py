"""Prefix trie, whitening and byte-level BPE against brute force, and their odd input."""

import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lakepress.llm import byte_bpe, prefix_trie, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TURNS = "conv_id bigint, turn bigint, role string, text string"


# ---- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):  # children before parents
        below = [out[k] for k in kids[node]]
        size = len(node[-1][1].encode()) if node else 0
        ends = sorted(c for c in members[node] if len(paths[c]) == len(node))
        out[node] = {
            "conv_id": min(members[node]),
            "depth": len(node),
            "parent_conv_id": min(members[node[:-1]]) if node else None,
            "n_convs": len(members[node]),
            "n_children": len(below),
            "n_leaves": sum(b["n_leaves"] for b in below) or 1,
            "saved_tokens": sum(b["saved_tokens"] for b in below) + (len(members[node]) - 1) * size,
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        }
    return list(out.values())


def same(got, want):
    key = lambda r: (r["depth"], r["conv_id"])
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key)


def test_trie_equals_brute_force_on_odd_turns(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        if c % 7:
            rows += [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "żółć", None, "", "bb" * 30])) for _ in range(rng.randrange(14))]
    rows += rows[:30] + [(None, 1, "user", "lost"), (3, 0, "u", "x" * 300_000)]
    same(prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect(), brute_trie(rows))


def test_trie_of_copies_and_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 190) for t in range(4)]  # most of them equal
    rows += [(c, t, "user", f"turn {t // 3}") for c in (5, 6, 7) for t in range(150)]
    same(prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect(), brute_trie(rows))


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(none).count() == 0
    # a conversation whose only turn goes to an absent head
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    (root,) = prefix_trie.trie(spark.createDataFrame([(c, None, None, None, 1)], TURNS + ", n1 int")).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (c, 0, None, 1, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


# ---- whitening


def brute_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, total = len(fit), fit.sum(0)
    centred = np.array([[v * n - t for v, t in zip(r, total, strict=True)] for r in fit], dtype=float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    deviation = [sum((v * n - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    mine = np.array([[v * n - t for v, t in zip(r, total, strict=True)] for r in x], dtype=float) / n
    return n, deviation, mine @ axes[:, :16] / np.sqrt(e[:16]), e[:16] / e.sum()


def check_whitening(got, ids, vectors):
    n, deviation, w, share = brute_whitening(vectors)
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * len(share)
    out = np.zeros_like(w)
    for r in got:
        k = at[r.vec_id]
        assert r.n == n and r.deviation == deviation[k] and abs(r.identity_error) < 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
        out[k, r.component - 1] = r.whitened
    for j in range(w.shape[1]):
        assert min(np.abs(out[:, j] - w[:, j]).max(), np.abs(out[:, j] + w[:, j]).max()) < 1e-7


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_equals_eigenvectors_of_the_covariance(spark, parts):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(900, 24)) * np.linspace(3, 0.2, 24) + 5).astype("float32")
    x[500:] = x[7]  # copies of one vector count once
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 22), (2003, [math.nan] * 24), (2004, [math.inf] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(parts)
    check_whitening(whitening.whiten(df).collect(), list(range(900)), x)


def test_merged_summaries_lose_nothing():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 900, size=(300, 10))
    parts = [whitening.Summary.of(p) for p in np.split(x, [3, 4, 11, 120, 250])]
    s = parts[0]
    for p in parts[1:]:
        s = s.merged(whitening.Summary.read(p.row(10, 0)))
    c = x - x.mean(0)
    assert s.n == 300 and s.total == x.sum(0).tolist()
    assert np.allclose(s.scaled.T @ s.scaled, c.T @ c, rtol=1e-12, atol=1e-6)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, n int, component string"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], 1, "x"), (1, [0.5, 2.0], 2, "y"), (None, [0.5, 2.0], 2, "y")], schema)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0)] * 4 + [(None, 1, 0, None, 0.0, 0.0)] * 2
    # two dimensions, a direction without variance, and entries beyond any grid
    rows = [(i, [float(i), 1.0, float(i * i % 7)], 0, "") for i in range(20)] + [(50 + i, [float(i % 5), float(i)], 0, "") for i in range(9)] + [(99, [1e308, -1e308, 0.0], 0, "")]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 21 * 3 + 9 * 2 and got[(99, 1)].deviation is None and got[(51, 1)].n == 9
    flat = {r.component: r for r in whitening.whiten(spark.createDataFrame(rows[:20], schema)).where("vec_id = 3").collect()}
    assert flat[3].whitened is None and flat[3].explained < 1e-12 and flat[1].identity_error < 1e-9


def test_exact_deviation_beyond_floats():
    m = whitening.Whitening(whitening.Summary(3, [10**9, 7], np.zeros((1, 2))))
    assert m.deviation(np.array([[10**9 + 1, 5]])) == [(3 * (10**9 + 1) - 10**9) ** 2 + 64]
    assert m.deviation(np.array([[1 << 40, 5]])) == [None]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def whole():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


WILD = "aąbß日本 \n\t'sé🎉🏳️‍🌈\u0085 ​﻿0٣Ⅷ!?—<|endoftext|>\x00\x1c"


def test_ids_equal_the_library(spark, whole):
    rng = random.Random(2)
    texts = [None, "", " ", "hello  world\n\n it's", "w" * 40_000, "ab" * 9000, "日本語" * 3000, WILD] + ["".join(rng.choices(WILD, k=rng.randrange(400))) for _ in range(300)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), " " * 3000 + "x", "ä" * 7001]
    df = spark.createDataFrame([(i, t, i, f"d{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, Token_IDs bigint, extra string").repartition(3)
    coded = byte_bpe.encode(df, RANKS)
    assert coded.columns == ["doc_id", "text", "extra", "token_ids"]
    rows = byte_bpe.decode(coded, RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == texts[r.doc_id] and r.extra == f"d{r.doc_id}"
        assert r.token_ids == (None if r.text is None else whole.encode_ordinary(r.text))
        assert r.decoded == (None if r.text is None else r.text.encode())


def test_digests_of_ids(spark, whole):
    texts = [(1, "some text"), (1, "some text"), (None, "x"), (2, None), (3, "")]
    got = byte_bpe.digests(spark.createDataFrame(texts, "doc_id bigint, text string"), RANKS).collect()
    want = []
    for i, t in texts:
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id bigint, text string"), RANKS).count() == 0


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([([1, 2],), ([1, None],), ([10**6],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded is None for r in byte_bpe.decode(df, RANKS).collect()] == [False, True, True, True, False]


def test_queue_gives_least_rank_then_leftmost():
    rng = random.Random(1)
    queue, held = byte_bpe.RankQueue(5000), []
    for _ in range(4000):
        if rng.random() < 0.6:
            x = (rng.choice([0, 63, 64, 4095, 4096, 4999, rng.randrange(5000)]), rng.randrange(50))
            held.append(x)
            queue.push(*x)
        elif held:
            assert queue.pop() == min(held)
            held.remove(min(held))
    while held:
        assert queue.pop() == min(held)
        held.remove(min(held))
    assert queue.pop() is None and not any(queue.words)


def test_any_order_of_ranks_merges_as_defined(whole):
    """A token may rank above its own parts, so a merge can bring a lesser rank than the last."""
    rng = random.Random(9)
    r = byte_bpe.Ranks.__new__(byte_bpe.Ranks)
    tokens = [bytes([c]) for c in b"abc"]
    seen = set(tokens)
    while len(tokens) < 60:
        t = bytes(rng.choices(b"abc", k=rng.randrange(2, 6)))
        if t not in seen:
            seen.add(t)
            tokens.append(t)
    r.ranks = {t: i for i, t in enumerate(rng.sample(tokens, len(tokens)))}
    r.longest, r.queue, r.single = 5, byte_bpe.RankQueue(60), [r.ranks.get(bytes([b])) for b in range(256)]
    for _ in range(400):
        piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in r.ranks else [piece]
        while True:
            found = min(((r.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in r.ranks), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        assert r.merge(piece) == [r.ranks[p] for p in parts]

"""Near duplicates by blocks of texts: against brute force, and what they write."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakepress.operators import dedupe as D


def cosines(texts):
    """{(i, j): cosine} of all pairs i < j with grams."""
    tf = [D._gram_counts((t or "").lower().split()) for t in texts]
    df = Counter(g for c in tf for g in c)
    raw = [{g: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in c.items()} for c in tf]
    unit = [{g: w / math.sqrt(sum(x * x for x in r.values())) for g, w in r.items()} for r in raw]
    return {(i, j): round(sum(w * unit[j].get(g, 0.0) for g, w in unit[i].items()), 9) for i, j in itertools.combinations(range(len(texts)), 2)}


def headlines(rng, n):
    words = ["storm", "harbour", "日本語の", "minister", "border", "river", "ärger", "signal", "winter", "a", "of"]
    out = []
    for _ in range(n):
        base = [rng.choice(words) + rng.choice(["", str(rng.randrange(9))]) for _ in range(rng.randrange(1, 12))]
        out += [" ".join(base)] * rng.choice([1, 1, 1, 5])
        if rng.random() < 0.6:
            base[rng.randrange(len(base))] += "s"
            out.append("  ".join(base))
    return out


def test_pairs_over_many_blocks_and_lists_of_copies(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    monkeypatch.setattr(D, "COPIES", 2)
    texts = [*headlines(random.Random(7), 70), "", None, "  ", "\n", ""]
    want = {p: c for p, c in cosines(texts).items() if c >= D.SIMILAR}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, headline string")
    got = [((r.a, r.b), r.cosine) for r in D.near_pairs(rows).collect()]
    assert len(got) == len(dict(got)) and set(dict(got)) == set(want) and len(want) > 100
    assert all(abs(c - want[p]) < 1e-8 for p, c in got)
    group = {i: {i} for i in range(len(texts))}
    for i, j in want:
        both = group[i] | group[j]
        for k in both:
            group[k] = both
    assert {r.doc_id: r.component for r in D.near_clusters(rows).collect()} == {i: min(g) for i, g in group.items()}


def test_no_texts_and_no_grams(spark):
    for texts in ([], [None], ["", " "]):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, headline string")
        assert D.near_pairs(rows).count() == 0
        assert {r.doc_id: r.component for r in D.near_clusters(rows).collect()} == {i: i for i in range(len(texts))}


def test_blocks_are_compared_in_small_parts(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 80)
    grams = [np.sort(rng.choice(60, n, replace=False)) for n in sizes]
    for i in range(0, 78, 3):  # a near copy, and one of the rarer half alone
        grams[i + 1], sizes[i + 1] = grams[i][: max(1, len(grams[i]) - 1)], max(1, sizes[i] - 1)
        grams[i + 2], sizes[i + 2] = grams[i][: (len(grams[i]) + 1) // 2], (sizes[i] + 1) // 2
    place, part = np.concatenate(grams), rng.uniform(0.5, 2.0, int(sizes.sum()))
    row = D._block_row(0, pd.Series(range(80)), sizes, place, part, np.arange(60) * 7, np.linspace(3, 1, 60)).iloc[0]
    x = D._unpacked_block(*row[1:])
    full = np.zeros((80, 60))
    full[np.repeat(np.arange(80), sizes), place] = x.w
    for least, postings in itertools.product((0.85, 0.5), (1, 5, 1024)):
        monkeypatch.setattr(D, "POSTINGS", postings)
        want = {(i, j) for i, j in itertools.combinations(range(80), 2) if np.round(full[i] @ full[j], 9) >= least}
        got = [p for f in D._compared(x, x, True, least) for p in zip(f["a"], f["b"], strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
        got = [p for f in D._compared(x, x._replace(keys=x.keys + 100), False, least) for p in zip(f["a"], f["b"] - 100, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want | {(j, i) for i, j in want} | {(i, i) for i in range(80)}


def test_tallies_are_counts_of_grams(monkeypatch):
    monkeypatch.setattr(D, "CHUNK_CHARS", 40)
    rng = random.Random(8)
    texts = ["".join(rng.choices("aB éİΣ\x85\x1c \n日🎉", k=rng.randrange(25))).lower() for _ in range(300)] + ["", " ", "a"]
    import regex

    named, seen = {}, [Counter() for _ in texts]
    for lo, grams, text, place, count in D._tallies(pd.Series(texts)):
        for t, p, n in zip(text, place, count, strict=True):
            seen[lo + t][int(grams[p])] += int(n)
    for t in texts:  # the number of each gram, from texts of that gram's word alone
        for w in regex.split(r"\s+", t):
            for g in D._gram_counts([w]):
                inner = g.strip(" ")
                _, keys = D._gram_keys([inner], D._spaces())
                of = D._gram_counts([inner])
                if len(of) == 1 and g in of:
                    named[g] = int(keys[0])
    want = [D._gram_counts(regex.split(r"\s+", t)) for t in texts]
    assert [sorted(c.values()) for c in seen] == [sorted(c.values()) for c in want]
    assert len({k for c in seen for k in c}) == len({g for c in want for g in c})
    assert named and all(seen[i][k] == want[i][g] for i in range(len(texts)) for g, k in named.items())


def test_writes_follow_the_texts_and_not_their_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(50)]
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, headline string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert D.near_clusters(rows).select(F.countDistinct("doc_id")).first()[0] == 2000
    assert written() - before < 20 * sum(map(len, texts))


def test_near_copies_are_linked_and_not_paired(spark):
    rng = random.Random(2)
    shared = " ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(120))
    rows = [(i, f"{shared} {i}", 1) for i in range(60)]
    blocks, n = D._text_blocks(spark.createDataFrame(rows, "rep bigint, text string, copies bigint"), 60)
    assert D._block_pairs(blocks, n, D.SIMILAR).count() == 60 * 59 // 2
    assert D._block_pairs(blocks, n, D.SIMILAR, links=True).count() == 59

"""Only pairs that come before both pairs beside them wait to be merged."""

from __future__ import annotations

import random

from lakepress.llm import byte_bpe


class Counting(byte_bpe.RankQueue):
    pushed = 0

    def push(self, rank, at):
        self.pushed += 1
        super().push(rank, at)


def test_few_pairs_wait_and_merges_are_as_defined():
    rng = random.Random(4)
    r = byte_bpe.Ranks.__new__(byte_bpe.Ranks)
    tokens = {bytes([c]) for c in b"abcd"} | {bytes([x, y]) for x in b"abcd" for y in b"abcd"}
    while len(tokens) < 120:
        tokens.add(bytes(rng.choices(b"abcd", k=rng.randrange(3, 7))))
    r.ranks = {t: i for i, t in enumerate(rng.sample(sorted(tokens), len(tokens)))}
    r.longest, r.queue, r.single = 6, Counting(120), [r.ranks.get(bytes([b])) for b in range(256)]
    total = 0
    for _ in range(500):
        piece = bytes(rng.choices(b"abcd", k=rng.randrange(7, 60)))
        total += len(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = min(((r.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in r.ranks), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        assert r.merge(piece) == [r.ranks[p] for p in parts]
    # every neighbouring pair waited before, and those that merges made
    assert r.queue.pushed < 0.8 * total

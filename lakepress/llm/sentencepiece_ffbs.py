"""Sampled SentencePiece segmentations and lossless decoding.

Every text is a lattice of vocabulary pieces. Forward filtering sums the
weights of all segmentations up to each position; backward sampling then draws
one segmentation from its exact posterior. Pieces never run across the start
of a word, so the lattice falls apart into words: each worker filters a
distinct word once and keeps, for every position, the cumulative probabilities
of the pieces that may end there. Sampling is one vectorised lookup a piece.

The uniform number of each draw is a hash of the seed, the row's key and the
draw's place in the row, so a row's segmentation does not depend on how rows
are spread over workers. A run of more than ``LONGEST_UNIT`` characters without
a blank is drawn from the same posterior one character at a time, keeping one
number a character instead of the whole lattice. Decoding joins the pieces' bytes and gives back the
text byte for byte, including white space, unknown characters and U+2581.

Defined results for odd input: a null text stays null (no ids); an empty text
has no ids; an empty table gives no rows; repeated rows with equal keys get
equal segmentations; null keys count as key 0; other columns are kept as they
are, whatever their types and names, but for one that is called like the new
column in any case of letters, which the new one replaces.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from lakepress.llm.frames import bounded, objects, quoted, tidy, without

#: flattening of the posterior, 0 uniform, 1 as the vocabulary's ranks say
ALPHA = 1.0
#: characters a batch of texts may hold before its words are drawn
BATCH_CHARS = 2_000_000
#: longer runs are filtered and drawn on their own
LONGEST_UNIT = 512
#: steps of a probability
GRID = float(1 << 24)
_UNITS = re.compile(r"[^ ]+|(?: +[^ ]+)| +")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1


class Lattice(NamedTuple):
    line: np.ndarray
    source: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    size: np.ndarray


def poly(text: str) -> int:
    """The hash of a piece, as filter_forward() rolls it over words."""
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) * int(_MIX)) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """The vocabulary: bytes and log-weights of pieces, and byte pieces for all else."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                # merge ranks stand in for frequencies: Zipf's law
                self.weight[text] = (i, -alpha * math.log(1.0 + max(0.0, -sp.get_score(i))))
                self.bytes[i] = text.encode()
        self.longest = max(map(len, self.weight))
        # per length, the polynomial hashes of what pieces begin with, in order; -1 for what is no piece itself
        self.by_length = []
        for n in range(self.longest + 1):
            heads = {t[:n] for t in self.weight if len(t) >= n > 0}
            got = sorted((poly(t), *self.weight.get(t, (-1, 0.0))) for t in heads)
            self.by_length.append((np.array([g[0] for g in got], dtype=np.uint64), np.array([g[1] for g in got], dtype=np.int64), np.array([g[2] for g in got], dtype=float)))
        self.byte_weight = -alpha * math.log(4.0 * n)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        if not n.sum():
            return b""
        at = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.pool[at].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Pieces:
    return Pieces(path, alpha)


def filter_forward(units: list[str], v: Pieces) -> Lattice:
    """Forward-filter words all at once.

    Node ``first[k] + i`` is position i of word k. The pieces that may end at a
    node follow each other in ``line``, at the node's number plus the running
    sum of their shares of the node's forward weight. A negative piece is the
    byte pieces of one character, minus its code point.
    """
    code = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.array([len(u) for u in units], dtype=np.int64)
    stop_of = np.cumsum(size)
    begin_of = stop_of - size
    unit = np.repeat(np.arange(len(units)), size)
    at = np.arange(len(code))
    room = stop_of[unit] - at  # characters from here to the word's end
    starts, pieces, weights, widths = [], [], [], []
    live, h = at, code * _MIX
    for n in range(1, v.longest + 1):
        if n > 1:
            keep = room[live] >= n
            live, h = live[keep], h[keep]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                h = h * _BASE + code[live + n - 1] * _MIX
        hashes, ids, logs = v.by_length[n]
        hit = live_on = np.zeros(len(live), dtype=bool)
        if len(hashes):
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            live_on = hashes[k] == h
            hit = live_on & (ids[k] >= 0)
            starts.append(live[hit])
            pieces.append(ids[k[hit]])
            weights.append(logs[k[hit]])
            widths.append(np.full(hit.sum(), n))
        if n == 1:
            lone = live[~hit]
            cp = code[lone].astype(np.int64)
            starts.append(lone)
            pieces.append(-cp)
            weights.append(v.byte_weight * (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)))
            widths.append(np.ones(len(lone), dtype=np.int64))
        live, h = live[live_on], h[live_on]
    start, piece, weight = np.concatenate(starts), np.concatenate(pieces), np.concatenate(weights)
    stop = start + np.concatenate(widths)
    of = unit[start]
    place = stop - begin_of[of]
    first = begin_of + np.arange(len(units))
    node, source = first[of] + place, first[of] + start - begin_of[of]
    # stable: a node's pieces keep their order of length whatever else is in the batch
    order = np.argsort(node, kind="stable")
    node, source, piece, weight, place = node[order], source[order], piece[order], weight[order], place[order]
    # by position in the word; small numbers sort by radix
    turn = np.argsort(place.astype(np.uint16), kind="stable")
    to_all, from_all, weight, place = node[turn], source[turn], weight[turn], place[turn]
    total = np.zeros(int(stop_of[-1]) + len(units))
    turned = np.empty(len(node))
    bounds = np.searchsorted(place, np.arange(1, int(size.max()) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        w, to = total[from_all[a:b]] + weight[a:b], to_all[a:b]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        n = np.diff(np.append(head, b - a))
        top = np.maximum.reduceat(w, head)
        e = np.exp(w - np.repeat(top, n))
        s = np.add.reduceat(e, head)
        total[to[head]] = top + np.log(s)
        turned[a:b] = e / np.repeat(s, n)
    share = np.empty(len(node))
    share[turn] = turned
    head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    n = np.diff(np.append(head, len(node)))
    run = share
    for k in range(1, int(n.max())):
        at = head[n > k] + k
        run[at] += run[at - 1]
    # on a grid, so that adding the node's number is exact
    run = np.floor(run * GRID) / GRID
    run[head + n - 1] = 1.0
    return Lattice(node + np.minimum(run, 1.0), source, piece, first, size)


def draw_long(unit: str, v: Pieces, state: int) -> list[int]:
    """One segmentation of a long word, its pieces as in ``filter_forward``; keeps a forward weight for each position alone."""
    weight, longest = v.weight, v.longest

    def ending(stop: int) -> list[tuple[int, int, float]]:
        """(start, piece, log weight up to here) of the pieces that may end at ``stop``."""
        c = unit[stop - 1]
        known = weight.get(c)
        out = [(stop - 1, known[0], total[stop - 1] + known[1])] if known else [(stop - 1, -ord(c), total[stop - 1] + v.byte_weight * len(c.encode()))]
        for start in range(stop - 2, max(-1, stop - 1 - longest), -1):
            if (known := weight.get(unit[start:stop])) is not None:
                out.append((start, known[0], total[start] + known[1]))
        return out

    total, exp, log = [0.0], math.exp, math.log
    for stop in range(1, len(unit) + 1):
        logs = [x[2] for x in ending(stop)]
        top = max(logs)
        total.append(top + log(sum([exp(x - top) for x in logs])))
    pieces, at, draw = [], len(unit), 0
    while at:
        draw += 1
        u = (_mix_one(state + draw) >> 40) / GRID
        edges = ending(at)
        for edge in edges:
            u -= exp(edge[2] - total[at])
            if u < 0:
                break
        at = edge[0]
        pieces.append(edge[1])
    return pieces[::-1]


class Sampler:
    """Draws segmentations; every distinct word of a batch is filtered once."""

    def __init__(self, path: str, seed: int = 0, alpha: float = ALPHA):
        self.v, self.seed = vocabulary(path, alpha), seed

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        known: dict[str, int] = {}
        add, unit_ids, counts = known.setdefault, [], []
        long: list[tuple[int, str]] = []
        for text in texts:
            units = _UNITS.findall(text)
            if len(text) > LONGEST_UNIT and max(map(len, units), default=0) > LONGEST_UNIT:
                long += [(len(unit_ids) + i, u) for i, u in enumerate(units) if len(u) > LONGEST_UNIT]
                unit_ids += [add(u, len(known)) if len(u) <= LONGEST_UNIT else -1 for u in units]
            else:
                unit_ids += [add(u, len(known)) for u in units]
            counts.append(len(units))
        if not unit_ids:
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        unit = np.array(unit_ids, dtype=np.int64)
        n_of = np.array(counts, dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), n_of)
        place = np.arange(len(unit)) - np.repeat(np.concatenate([[0], np.cumsum(n_of)[:-1]]), n_of)
        salt = _mix(np.array([(k ^ self.seed * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF for k in keys], dtype=np.uint64))
        state = _mix(salt[row] + place.astype(np.uint64) * _MIX)
        units, pieces = self._drawn(list(known), unit, state) if known else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if long:
            drawn = [draw_long(u, self.v, int(state[i])) for i, u in long]
            units = np.concatenate([units, np.repeat([i for i, _ in long], [len(d) for d in drawn])])
            pieces = np.concatenate([pieces, np.concatenate(drawn)])
            order = np.argsort(units, kind="stable")
            units, pieces = units[order], pieces[order]
        if (odd := pieces < 0).any():
            spelled = [chr(-p).encode() for p in pieces[odd].tolist()]
            n = np.ones(len(pieces), dtype=np.int64)
            n[odd] = [len(b) for b in spelled]
            units = np.repeat(units, n)
            flat = np.repeat(pieces, n)
            flat[flat < 0] = np.array(self.v.byte_ids)[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
            pieces = flat
        per_row = np.bincount(row[units], minlength=len(texts))
        return np.split(pieces, np.cumsum(per_row)[:-1])

    def _drawn(self, words: list[str], unit: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the unit, piece) in order, of the units that are among ``words``."""
        line, edge_start, edge_piece, first, length = filter_forward(words, self.v)
        # equal words side by side: their draws read the same stretch of the tables
        beside = np.argsort(unit, kind="stable")
        beside = beside[unit[beside] >= 0]
        unit, state = unit[beside], state[beside]
        begin = first[unit]
        node = begin + length[unit]
        live = np.arange(len(unit))
        got_unit, got_piece = [], []
        draw = 0
        while len(live):
            draw += 1
            u = ((_mix(state[live] + np.uint64(draw)) >> np.uint64(40)).astype(np.float64) + 0.5) / GRID
            edge = np.searchsorted(line, node[live] + u, side="right")
            edge = np.minimum(edge, len(line) - 1)
            got_unit.append(beside[live])
            got_piece.append(edge_piece[edge])
            node[live] = edge_start[edge]
            live = live[node[live] > begin[live]]
        units = np.concatenate(got_unit)
        steps = np.repeat(np.arange(draw), [len(g) for g in got_unit])
        pieces = np.concatenate(got_piece)
        order = np.argsort(units * (draw + 1) + (draw - steps))
        units, pieces = units[order], pieces[order]
        return units, pieces


def _mix_one(x: int) -> int:
    """``_mix`` of one number."""
    x = (x + int(_MIX)) & _WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WORD
    return x ^ (x >> 31)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _grouped(texts: list) -> Iterator[slice]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BATCH_CHARS:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _key(k) -> int:
    if k is None or k != k:
        return 0
    return int(k) if isinstance(k, (int, np.integer, float)) else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little")


def encode(docs: DataFrame, model: str, seed: int = 0, alpha: float = ALPHA, key: str = "doc_id", text: str = "text", to: str = "piece_ids") -> DataFrame:
    """``docs`` with ``to``, an array of piece ids. Keys and texts alone go to Python."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        s = Sampler(model, seed, alpha)
        for keys, texts in batches:
            texts, out = list(texts), []
            for part in _grouped(texts):
                ids = s.sample([t or "" for t in texts[part]], [_key(k) for k in keys.iloc[part]])
                out += [None if t is None else x.astype(np.int32) for t, x in zip(texts[part], ids, strict=True)]
            yield objects(out)

    coded = F.pandas_udf(tidy(run), "array<int>", PandasUDFType.SCALAR_ITER)
    return bounded(docs).select(*map(quoted, without(docs, to)), coded(F.col(key), F.col(text)).alias(to))


def decode(coded: DataFrame, model: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``coded`` with ``to``, the text that the ids spell."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(model)
        for lists in batches:
            yield objects([None if x is None else v.decode(np.asarray(x, dtype=np.int64)).decode() for x in lists])

    spelled = F.pandas_udf(run, "string", PandasUDFType.SCALAR_ITER)
    return bounded(coded).select(*map(quoted, without(coded, to)), spelled(F.col(ids)).alias(to))


def digests(docs: DataFrame, model: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the text back, without moving ids out of the worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sampler(model, seed, alpha)
        for f in frames:
            texts = list(f["text"])
            for part in _grouped(texts):
                some = [t or "" for t in texts[part]]
                ids = s.sample(some, [_key(k) for k in f["doc_id"].iloc[part]])
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].iloc[part].astype("Int64").reset_index(drop=True),
                        "n_pieces": np.array([len(x) for x in ids], dtype="int64"),
                        "ids_crc32": np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], dtype="int64"),
                        "lossless": np.array([s.v.decode(x) == t.encode() for t, x in zip(some, ids, strict=True)], dtype=bool),
                    }
                )

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(tidy(run), "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean")

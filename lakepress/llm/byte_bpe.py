"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

A text is split by the tokenizer's pattern, and each match is merged on its
own: of all neighbouring parts whose bytes together are a token, the pair of
the least rank is joined first, of equal ranks the leftmost. Pairs wait in
buckets, one for each merge rank, which hold the positions of their first
parts in a linked list of parts. A bitmap marks the buckets that hold
something, and a bitmap above it marks the words of the lower one that aren't
zero, so finding the first set bit of one number on either level gives the next
rank. Only a pair that comes before both pairs beside it waits, as another one's
turn can't come before theirs; joining two parts makes at most the two pairs on
either side wait. An entry whose pair has changed since is stale and passed over. A
match of n bytes costs O(n log n) whatever its length.

Decoding joins the tokens' bytes, so the bytes of every text come back.

Defined results for odd input: a null text has null ids and decodes to null,
an empty one to no ids and no bytes; an id that is null or not in the
vocabulary makes the whole decoded value null; repeated rows are coded alike;
an empty table gives no rows. Other columns keep their names and values, but
for those of a result's name in any case of letters, which the result
replaces.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lakepress.llm.frames import bounded, quoted, tidy, unused, without

#: matches whose ids a worker remembers, and the longest of them; others are merged anew
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: bits in a word of the bitmap
WORD = 256
#: of a pair that is no token, beyond every rank
NO_RANK = 1 << 62
_BITS = [1 << i for i in range(WORD)]


class RankQueue:
    """(rank, position) pairs, the least rank first and in it the least position."""

    __slots__ = ("buckets", "spots", "top", "words")

    def __init__(self, n_ranks: int):
        self.words = [0] * -(-n_ranks // WORD)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}
        #: of each rank its word, its bit there and the word's bit above
        self.spots = [(r // WORD, _BITS[r % WORD], 1 << r // WORD) for r in range(n_ranks)]

    def push(self, rank: int, at: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = [at]
            word, bit, above = self.spots[rank]
            self.words[word] |= bit
            self.top |= above
        else:
            heappush(held, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        bit = bits & -bits
        rank = word * WORD + bit.bit_length() - 1
        held = self.buckets[rank]
        if len(held) > 1:
            return rank, heappop(held)
        del self.buckets[rank]
        self.words[word] = bits ^ bit
        if bits == bit:
            self.top = top & top - 1
        return rank, held[0]


class Ranks:
    """A vocabulary of ranked tokens and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(max(self.tokens) + 1)
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        ranks, queue, n, longest = self.ranks, self.queue, len(piece), self.longest
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        part = list(map(self.single.__getitem__, piece))  # the id of the part that begins here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank of the pair whose first part begins here
        push, pop, find = queue.push, queue.pop, ranks.get
        pair = [find(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
        pair.append(NO_RANK)
        left = NO_RANK
        for i in range(n - 1):
            rank = pair[i]
            if rank < left and rank <= pair[i + 1]:
                push(rank, i)
            left = rank
        while (top := pop()) is not None:
            rank, i = top
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            was_right, part[i], pair[j] = pair[j], rank, NO_RANK
            right = beyond = left = before_left = was_left = NO_RANK
            if end < n:
                before[end] = i
                beyond = pair[end]
                if (last := after[end]) - i <= longest:
                    right = find(piece[i:last], NO_RANK)
            pair[i] = right
            if (b := before[i]) >= 0:
                was_left = pair[b]
                if end - b <= longest:
                    left = find(piece[b:end], NO_RANK)
                pair[b] = left
                if (c := before[b]) >= 0:
                    before_left = pair[c]
                    if was_left < before_left <= left and before_left < NO_RANK:
                        push(before_left, c)
                if left < before_left and left <= right:
                    push(left, b)
            if right < left and right <= beyond:
                push(right, i)
            if was_right <= beyond < right:
                push(beyond, end)
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """32-bit ids."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: list) -> bytes | None:
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return None


class _Known(dict):
    """Ids of matches, merged when first asked for; of two generations the older is forgotten when the younger is full."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = array("i", self.ranks.merge(match.encode())).tobytes()
        if len(match) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[match] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Ranks:
    """One for each worker."""
    return Ranks(path, pattern)


def _with_result(df: DataFrame, source: str, to: str, kind, run) -> DataFrame:
    """``df`` and a column ``to``, which ``run`` makes of the Arrow column ``source``."""
    kept, read = without(df, to), unused(df, "__source")
    # only what the result is made of and the columns that stay go to Python
    rows = bounded(df).select(*[F.col(quoted(c)) for c in kept], F.col(quoted(source)).alias(read))
    schema = StructType([*rows.schema.fields[:-1], StructField(to, kind)])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            own = b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, run(b.columns[-1])], names=[*kept, to])

    return rows.mapInArrow(tidy(batches), schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` and the ids of each whole text, as an array of int."""

    def run(texts: pa.Array) -> pa.Array:
        ranks = vocabulary(path, pattern)
        coded = [None if t is None else ranks.encode(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *[len(c or b"") // 4 for c in coded]], dtype=np.int64)
        values = pa.array(np.frombuffer(b"".join(c for c in coded if c), dtype="int32"))
        offsets = pa.array(ends.astype("int32"), mask=np.array([*[c is None for c in coded], False]))
        return pa.ListArray.from_arrays(offsets, values)

    return _with_result(docs, text, to, ArrayType(IntegerType()), run)


def decode(coded: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``coded`` and the bytes that each array of ids stands for."""

    def run(lists: pa.Array) -> pa.Array:
        ranks = vocabulary(path, public_tokenizers.PATTERN)
        # flat numbers and offsets: a list of Python lists would take ten times as long to make
        flat = lists.values.to_numpy(zero_copy_only=False) if lists.values.null_count == 0 else lists.values.to_pylist()
        at, there = lists.offsets.to_pylist(), lists.is_valid().to_pylist()
        own = (flat[a:b] if ok else None for a, b, ok in zip(at[:-1], at[1:], there, strict=True))
        return pa.array([None if x is None else ranks.decode(x.tolist() if isinstance(x, np.ndarray) else x) for x in own], pa.binary())

    return _with_result(coded, ids, to, BinaryType(), run)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256; a null text counts as empty."""
    body = docs.select(F.col(quoted(key)).alias("key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    coded = encode(body, path).select("key", "token_ids")
    listed = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    # the ids' digest is taken before they go on to be decoded, and they end there
    told = coded.select("key", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "token_ids")
    return decode(told, path, to="decoded").select(F.col("key").alias(key), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

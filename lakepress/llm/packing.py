"""Harmonic packing of token documents into fixed-length sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity/(k+1), capacity/k], and a bin of class k takes exactly k pieces, so a
worker needs one open bin a class and no search. A document longer than the
capacity yields full pieces first. Its remainder stays whole where a bin of
its class would be filled well; otherwise it is cut once or more at the next
class's exact length. Every task packs its own documents; what is left in its
open bins at the end is put together by first fit.

Defined results for odd input: a null or empty text is a document of the end
token alone; an empty table gives no rows; repeated rows are packed each on
their own; other columns of the input are ignored. A task that is run again
reads the same rows and gives the same sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, tidy

CAPACITY = 2048
END_ID = 1
#: share of a bin that a whole remainder's class must fill
FILL = 0.93
#: classes beyond this share one class size
MAX_CLASS = 64
#: words, and runs of words, whose ids a worker remembers
REMEMBERED = 120_000

#: texts in these characters take the word-wise path; others go to the tokenizer whole
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿŒœ]*+")
#: the vocabulary's own word pattern, for lower-case texts in these characters
_WORDS = re.compile(r"[a-zß-öø-ÿœ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-ÿœ]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of whole texts, remembering the ids of words.

    The vocabulary's pre-tokenizer cuts a normalised text into words that its
    model encodes one by one, so remembered words give the same ids. White
    space never joins words, so ids are remembered by white-space run first.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        got = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(self.words) < REMEMBERED:
            self.words[word] = got
        return got

    def _run(self, run: str) -> bytes:
        known = self.words.get
        got = b"".join([known(w) or self._word(w) for w in _WORDS.findall(run)])
        if len(self.runs) < REMEMBERED:
            self.runs[run] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, fresh = self.runs.get, self._run
        return b"".join([known(r) or fresh(r) for r in text.lower().split()])


def cut(length: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        if k >= MAX_CLASS or k * left >= fill * capacity:
            out.append(left)
            break
        out.append(capacity // (k + 1))
        left -= out[-1]
    return out


class Packer:
    """One open bin a class; a full bin comes out with its number."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = first, capacity, {}

    def add(self, length: int, piece: tuple) -> list[tuple]:
        k = min(MAX_CLASS, self.capacity // length)
        held = self.open.setdefault(k, [])
        held.append((length, piece))
        if len(held) < k:
            return []
        del self.open[k]
        return self._number(held)

    def _number(self, held: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for length, piece in held:
            out.append((*piece, self.next, at))
            at += length
        self.next += 1
        return out

    def close(self) -> list[tuple]:
        """What is left, longest first into the first bin with room."""
        bins: list[list] = []
        for length, piece in sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0]):
            for b in bins:
                if b[0] >= length:
                    b[0] -= length
                    b[1].append((length, piece))
                    break
            else:
                bins.append([self.capacity - length, [(length, piece)]])
        self.open = {}
        return [x for _, held in bins for x in self._number(held)]


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=COLUMNS)
    f["doc_id"] = pd.array(f["doc_id"], dtype="Int64")
    return f.astype({c: "int64" for c in COLUMNS[1:]})


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece. ``sequence_id`` is the task's number times 2**32 plus a count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, packer = WordIds(tokenizer), Packer(TaskContext.get().partitionId() << 32, capacity)
        end = np.array([end_id], dtype="<u4").tobytes()
        for f in frames:
            out = []
            for doc_id, body in zip(f["doc_id"], f["text"], strict=True):
                ids = words.encode(body or "") + end
                total, at = len(ids) // 4, 0
                for length in cut(total, capacity):
                    crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                    out += packer.add(length, (doc_id, at, length, crc, total))
                    at += length
            yield _frame(out)
        yield _frame(packer.close())

    schema = ", ".join(f"{c} bigint" for c in COLUMNS)
    return bounded(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(tidy(run), schema)

"""Toxicity by noisy-channel deobfuscation.

Leetspeak, spaced-out letters and stretched letters are decoded first: each
suspicious token becomes a lattice of the characters it may stand for, and
Viterbi search under a character language model picks the likeliest reading.
The restored words are then scored by a model learnt from labelled documents:
log-odds of words and word beginnings over training documents, summed up
per document and calibrated by a logistic regression.

Only the labels of training rows are ever used. The classifier is fitted on a
bounded sample of labelled rows (``TRAIN_ROWS``), its calibration on a part of
that (``CALIBRATION_ROWS``). The language model is counted on every text, with a
label or without; its size does not grow with the text.

Defined results for odd input: a null text is an empty text and scores near the
base rate's low end; an empty table gives no rows; without labels of both
kinds every score is 0; repeated rows score alike; of labels that contradict
each other for one id, toxic counts; ``score`` ignores other columns of the
input, ``keep_clean`` keeps them all as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from lakepress.llm.frames import bounded, objects, tidy, unused
from lakepress.plans.workdir import spill

THRESHOLD = 0.7
#: labelled rows, by hash order, that are learnt from, and on which the calibration is fitted
TRAIN_ROWS = 30_000
CALIBRATION_ROWS = 4000
#: features kept, by strength
VOCABULARY = 6000
MIN_DOCS = 4
PREFIXES = (4, 5, 6, 7)
#: what a toxic row weighs in the calibration against a clean one
TOXIC_WEIGHT = 2.0

# what a character may stand for besides itself
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
_LETTERS = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTERS}+")
#: characters of a token, and those of them that stand for letters; a token that mixes letters with stand-ins is decoded
_SIGN = re.compile(r"[\w@$!|+*]+")
_STAND_IN = re.compile(r"[013456789@$!|+*]")
_HAS_LETTER = re.compile(_LETTERS)
#: signs that may be a token's punctuation as well as a letter
_CLOSING = "!|+*$"
_TRIPLE = re.compile(rf"({_LETTERS})\1\1")
#: every spaced run holds this: its second and third character
_SINGLE = re.compile(r"[ ._\-*](?:[^\W_]|[@$!|+])[ ._\-*](?:[^\W_]|[@$!|+])(?=[ ._\-*]|[^\w@$]|\Z)")
_SPACED = re.compile(r"(?<![\w@$])(?:[^\W_]|[@$!|+])(?:[ ._\-*](?:[^\W_]|[@$!|+])){2,}(?![\w@$])")
#: characters whose pairs are counted at once
PAIR_CHARS = 400_000
#: tokens whose readings a worker remembers
REMEMBERED = 30_000
#: a longer token is split into words after decoding, as a spaced run is
LONG_WORD = 20
#: log-probability that a word ends inside a run, and adjacent parts that are also read as one word
GAP, JOINED = math.log(0.3), 4


class CharModel:
    """Bigrams of characters inside words; ^ begins a word and $ ends it."""

    def __init__(self, counts: dict[str, int]):
        totals: Counter = Counter()
        for pair, n in counts.items():
            totals[pair[0]] += n
        kinds = max(1, len(totals))
        self.pair = {p: math.log((n + 0.1) / (totals[p[0]] + 0.1 * kinds)) for p, n in counts.items()}
        self.unseen = {a: math.log(0.1 / (n + 0.1 * kinds)) for a, n in totals.items()}
        self.least = math.log(1e-4)

    def step(self, a: str, b: str) -> float:
        return self.pair.get(a + b) or self.unseen.get(a, self.least)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters, with channel log-probabilities."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        heads = [c] if c.isalpha() else []
        heads += list(LEET.get(c, ""))
        reads = [(h * m, math.log(0.9 / len(heads)) if m == min(n, 2) or n > 2 and m == 1 else math.log(0.1)) for h in heads for m in ((1, 2) if n >= 2 else (1,))]
        out.append(reads or [("", math.log(0.01))])
        i = j
    return out


def decode(token: str, model: CharModel, gap: float | None = None) -> str:
    """The likeliest word that the token may stand for; with ``gap``, its likeliest words with blanks between."""
    scores, layers = {"^": 0.0}, []
    for reads in lattice(token):
        new: dict[str, float] = {}
        back: dict[str, tuple[str, str]] = {}
        for last, score in scores.items():
            for text, channel in reads:
                s, a, shown = score + channel, last, text
                if text and gap is not None and last != "^":
                    apart, inside = model.step(last, "$") + gap + model.step("^", text[0]), model.step(last, text[0])
                    if apart > inside:
                        s, a, shown = s + apart - model.step("^", text[0]), "^", " " + text
                for b in text:
                    s += model.step(a, b)
                    a = b
                if a not in new or s > new[a]:
                    new[a], back[a] = s, (last, shown)
        scores = new
        layers.append(back)
    at = max(scores, key=lambda a: scores[a] + model.step(a, "$"))
    parts = []
    for back in reversed(layers):
        at, shown = back[at]
        parts.append(shown)
    return "".join(reversed(parts))


def readings(token: str, model: CharModel, split: bool) -> tuple[str, ...]:
    """The token as one word; with ``split`` also the words that the character model finds in it, alone and joined with those after them."""
    out = [decode(token, model)]
    if split:
        parts = decode(token, model, GAP).split()
        out += ["".join(parts[i : i + n]) for n in range(1, JOINED + 1) for i in range(len(parts) - n + 1)]
    return tuple(out)


def mixed(text: str) -> Iterator[str]:
    """Tokens of ``text`` that hold letters and stand-ins, found from the stand-ins, as most texts have few."""
    end = 0
    for m in _STAND_IN.finditer(text):
        start = m.start()
        if start < end:
            continue
        end = _SIGN.match(text, start).end()
        while start and _SIGN.match(text[start - 1]):
            start -= 1
        if end - start > 1 and _HAS_LETTER.search(text, start, end):
            yield text[start:end]


def stretched(text: str) -> bool:
    """Whether a letter stands three times in a row."""
    return any(c * 3 in text and _HAS_LETTER.match(c) for c in set(text))


def restored(text: str, model: CharModel, known: dict) -> set[str]:
    """Distinct words of a lower-case text, with the readings of what looks obfuscated."""
    words = set(_WORD.findall(text))
    odd = set()
    for token in mixed(text):
        odd.add((token, len(token) > LONG_WORD))
        bare = token.rstrip(_CLOSING)
        if bare != token and not bare.isalpha():
            odd.add((bare, len(bare) > LONG_WORD))
    for m in _SPACED.finditer(text) if _SINGLE.search(text) else ():
        run = re.sub(r"[ ._\-*]", "", m.group())
        if any(c.isalpha() for c in run):
            odd.add((run, True))
            bare = run.rstrip(_CLOSING)
            if bare != run:
                odd.add((bare, True))
    if stretched(text):
        odd.update([(w, len(w) > LONG_WORD) for w in words if _TRIPLE.search(w)])
    for item in odd:
        if (got := known.get(item)) is None:
            got = readings(item[0], model, item[1])
            if len(known) < REMEMBERED:
                known[item] = got
        words.update(got)
    return words


def features(words: set[str]) -> set[str]:
    out = {w for w in words if len(w) > 2}
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


# ---- learning -----------------------------------------------------------------


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether ``_WORD`` takes it."""
    return np.array([chr(i).isalnum() and not chr(i).isdecimal() for i in range(0x110000)])


def count_pairs(texts: list[str], total: Counter) -> None:
    """Add the pairs of neighbouring characters of all words, with ^ before and $ after each."""
    code = np.frombuffer(" ".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(code):
        return
    letter = _letters()[code]
    seen = np.zeros(0x110000, dtype=bool)
    seen[code[letter]] = True
    kinds = np.flatnonzero(seen)
    small = np.zeros(0x110000, dtype=np.int64)
    small[kinds] = np.arange(1, len(kinds) + 1)
    at = np.where(letter, small[code], 0)
    left, right = np.concatenate([[0], at]), np.concatenate([at, [0]])
    pair, n = np.unique(left * (len(kinds) + 1) + right, return_counts=True) if len(kinds) > 2000 else (None, np.bincount(left * (len(kinds) + 1) + right))
    if pair is None:
        pair = np.flatnonzero(n)
        n = n[pair]
    names = [chr(k) for k in kinds]
    for p, k in zip(pair.tolist(), n.tolist(), strict=True):
        a, b = divmod(p, len(kinds) + 1)
        if p:
            total[(names[a - 1] if a else "^") + (names[b - 1] if b else "$")] += k


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for f in frames:
        held, size = [], 0
        for t in f["text"]:
            held.append(t or "")
            size += len(held[-1])
            if size > PAIR_CHARS:
                count_pairs(held, total)
                held, size = [], 0
        count_pairs(held, total)
    yield pd.DataFrame({"pair": objects(list(total)), "n": np.array(list(total.values()), dtype="int64")})


def char_model(docs: DataFrame, kinds: int = 20_000) -> CharModel:
    """From all texts of ``docs``; at most ``kinds`` pairs of characters, the most frequent."""
    got = bounded(docs).select("text").mapInPandas(tidy(_pairs), "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return CharModel({r.pair: r.n for r in got.orderBy(F.desc("n"), "pair").limit(kinds).collect()})


def _counter(model: CharModel) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for f in frames:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                counts[int(toxic)].update(features(restored((text or "").lower(), model, known)))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"feature": objects(keys), "bad": np.array([counts[1][k] for k in keys], dtype="int64"), "good": np.array([counts[0][k] for k in keys], dtype="int64")})

    return run


class ToxicityModel:
    """Weights of features and the calibration of their sums."""

    def __init__(self, chars: CharModel, weights: dict[str, float], beta: np.ndarray | None = None):
        self.chars, self.weights, self.beta = chars, weights, beta
        self.heads = frozenset(f.rstrip("*")[: PREFIXES[0]] for f in weights)

    def summary(self, text: str, known: dict) -> list[float]:
        """Constant, strongest weight, sum of the five strongest, hits a feature, all squashed."""
        heads, n = self.heads, PREFIXES[0]
        words = features({w for w in restored(text.lower(), self.chars, known) if w[:n] in heads})
        got = sorted((self.weights[w] for w in words if w in self.weights), reverse=True)
        return [1.0, (got[0] if got else 0.0) / 4, sum(got[:5]) / 20, math.log1p(len(got))]

    def scores(self, texts: list[str], known: dict) -> np.ndarray:
        if self.beta is None or not texts:
            return np.zeros(len(texts))
        x = np.array([self.summary(t or "", known) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _summaries(model: ToxicityModel) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for f in frames:
            yield pd.DataFrame({"toxic": f["toxic"].astype("int32"), "x": objects([model.summary(t or "", known) for t in f["text"]])})

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    keep = ridge * len(y) * np.array([0.0, *[1.0] * (x.shape[1] - 1)])
    keep = keep / 20
    w = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> ToxicityModel:
    """Learn from labelled rows that are not held out, at most ``TRAIN_ROWS`` of them by hash order."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).where(~F.coalesce(held_out(key), F.lit(False)))
    # at most TRAIN_ROWS small rows, so the join can send them to every task and leave texts where they are
    marked = usable.groupBy(key).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS)
    rows = spill(docs.select(key, "text").join(F.broadcast(marked), key).select(key, "text", "toxic"), "train")
    chars = char_model(docs)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad_n, good_n = totals.get(1, 0), totals.get(0, 0)
    if not bad_n or not good_n:
        return ToxicityModel(chars, {})
    counts = rows.select("text", "toxic").mapInPandas(tidy(_counter(chars)), "feature string, bad bigint, good bigint")
    odds = F.log((F.col("bad") + 0.5) / (bad_n + 1.0)) - F.log((F.col("good") + 0.5) / (good_n + 1.0))
    least = min(MIN_DOCS, max(1, bad_n // 8))
    kept = (
        counts.groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= least)
        .withColumn("odds", odds)
        .where("odds > 1.5")
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "feature")
        .limit(VOCABULARY)
    )
    model = ToxicityModel(chars, {r.feature: r.odds for r in kept.collect()})
    # both kinds in their own share, the first by hash order, so that file order doesn't matter
    per = CALIBRATION_ROWS // 2
    keys = rows.select(key, "toxic")
    some = [keys.where(F.col("toxic") == c).orderBy(F.xxhash64(key), key).limit(per) for c in (1, 0)]
    picked = rows.join(F.broadcast(some[0].unionByName(some[1]).select(key).distinct()), key, "left_semi")
    seen = picked.select("text", "toxic").mapInPandas(_summaries(model), "toxic int, x array<double>").collect()
    # at most CALIBRATION_ROWS; in one order, so that sums don't depend on the order of arrival
    seen.sort(key=lambda r: (r.toxic, r.x))
    model.beta = _fit(np.array([r.x for r in seen]), np.array([float(r.toxic) for r in seen]))
    return model


def _scorer(model: ToxicityModel) -> Callable:
    """The score of a text column; a text's score depends on nothing else."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            yield pd.Series(model.scores(list(texts), known))

    return F.pandas_udf(tidy(run), "double", PandasUDFType.SCALAR_ITER)


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = bounded(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), _scorer(model)(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose score is below the threshold. Texts alone go to Python."""
    name = unused(docs, "score")
    return bounded(docs).withColumn(name, _scorer(model)(F.col(text))).where(F.col(name) < THRESHOLD).drop(name)

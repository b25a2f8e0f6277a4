"""Personal data by weak supervision.

Four patterns give the base spans, which always stay. Further candidates
(written-out addresses, long IP forms, numbers without a country code, digit
groups that look like cards, names after a title, a given name or a cue) are
judged by labelers that may vote yes, no or abstain: a regular expression for
the whole shape, gazetteers (given names, domain endings, card issuers), the
words around the span in four languages, and check digits. Base spans are
voted on too, as anchors, and so are look-alikes that fail a base pattern's
check (part over 255, wrong check digit, wrong number of digits), which are
known to be false and never come out. Counts of vote patterns over the whole
corpus feed expectation-maximisation, which estimates each labeler's
reliability and each kind's share of true candidates; no label is used.

The posteriors are the targets of a final logistic span classifier. It does
not see the votes: its features are the span's own characters (shape of its
groups, length, check digits) and the words beside it, hashed into
``FEATURES`` weights, so it also judges what no labeler knows. It is fitted on
at most ``SAMPLE_SPANS`` spans, chosen by hash, in which both outcomes of every
kind weigh alike. It decides on candidates of the kinds of which the corpus has
``LEAST_EACH`` at least on either side; with fewer there is nothing to learn
their looks from, and the posterior decides. Accepted candidates are added.
Only counts of vote patterns, a few hundred whatever the input, and that sample
reach the driver. Written-out addresses have at most 64 characters before the
at and 63 in a label, as addresses do.

Defined results for odd input: a null text is an empty text without spans; an
empty table gives no rows; repeated rows are scanned each on their own; other
columns of the input are ignored, whatever their names. Offsets count code
points, ends are exclusive; added spans overlap neither base spans nor each
other.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy
from lakepress.plans.workdir import spill

KINDS = ("email", "ip", "card", "phone", "name")

# The base patterns. Each is the contract's pattern with look-behinds that keep
# its leftmost matches and spare the engine repeated starts within one run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- candidates and labelers -------------------------------------------------

_SPELLED = re.compile(
    r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63}\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}| dot )\s?[A-Za-z0-9-]{1,63})+", re.I
)
_AT, _DOT = ("(at)", "[at]", "{at}", " at "), ("(dot)", "[dot]", "{dot}", " dot ")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.\w-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20]|00[1-9][0-9]{0,2}[-.\x20]?[0-9]{2,4}[-.\x20]?)[0-9]{3}[-.\x20]?[0-9]{4}(?![0-9\w])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)"
_TITLED = re.compile(rf"\b{_TITLE}\.?\x20{_CAPITAL}(?:\x20{_CAPITAL})?")
_CALLED = re.compile(rf"(?:name is|m'appelle|me llamo|ich heiße|signed by)\x20({_CAPITAL}(?:\x20{_CAPITAL})?)")
_TWO = re.compile(rf"\b{_CAPITAL}\x20{_CAPITAL}\b")
#: the shape labeler says yes to these whole forms
_SHAPES = {
    0: re.compile(r"[\w.-]{2,}\s?(?:\(at\)|\[at\]|\{at\}).*(?:\(dot\)|\[dot\]|\{dot\}).{2,}|[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", re.I | re.S),
    1: re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    2: re.compile(r"[3-6].*", re.S),
    3: re.compile(r"\(?[2-9][0-9]{2}.*[2-9][0-9]{2}[-.\x20]?[0-9]{4}|00[1-9].*|\+.*", re.S),
    4: re.compile(rf"(?:{_TITLE}\.?\x20)?(?!{_TITLE}\b){_CAPITAL}\x20{_CAPITAL}"),
}
#: what the gazetteer labeler knows: domain endings, given names and, as a rule, card issuers' first digits
TLDS = frozenset("com org net edu gov mil int info biz name de fr es uk eu io at ch it nl be pt pl se no fi dk us ca au jp br mx ar cl co in".split())
GIVEN = frozenset(
    "anna john mary peter maria james robert linda michael laura david sarah thomas julia paul emma lucas marie hans jean jose carlos william elizabeth richard susan joseph jessica charles karen "
    "daniel nancy matthew lisa anthony betty mark margaret donald sandra steven ashley andrew emily joshua donna kevin michelle brian carol george amanda edward melissa ronald deborah timothy stephanie jason rebecca "
    "jeffrey sharon ryan cynthia jacob kathleen klaus ursula jürgen monika wolfgang petra stefan sabine andreas karin martin birgit christian heike pierre françoise michel monique philippe nathalie alain isabelle nicolas sylvie "
    "antonio carmen manuel josefa francisco isabel javier dolores miguel pilar rafael teresa pedro ana luis lucía".split()
)
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])")
CUES = re.compile(
    r"(?:call|phone|tel|mobile|fax|contact|e-?mail|mail|write to|reach|name|card|visa|account|signed|dear|address|server|host|anruf|telefon|handy|konto|karte|heiße|adresse|appel|téléphone|courriel|carte|compte|appelle|llama|teléfono|correo|tarjeta|cuenta|llamo)[^.\n]{0,12}\Z",
    re.I,
)
COUNTER = re.compile(r"(?:order|invoice|version|isbn|part|serial|page|figure|no|nr|id|bestellung|rechnung|seite|commande|facture|pedido|factura|número)[\x20.:#]{0,3}\Z", re.I)
AROUND = 30
LABELERS = ("shape", "gazetteer", "context", "checksum")
#: weights of the span classifier, and spans that it is fitted on
FEATURES, SAMPLE_SPANS = 1024, 20_000
#: candidates of a kind on either side from which on the classifier decides on them
LEAST_EACH = 50
#: spans that all kinds' reliabilities weigh against a kind's own
SHARED = 20.0


def _gazetteer(kind: int, word: str) -> str:
    if kind == 0:
        return "1" if re.split(r"[^A-Za-z0-9-]+", word.lower().rstrip(")]}"))[-1] in TLDS else "0"
    if kind == 2:
        return "1" if _ISSUER.match(word) else "0"
    if kind == 4:
        return "1" if any(w in GIVEN for w in re.findall(r"\w+", word.lower())) else "-"
    return "-"


def _checksum(kind: int, word: str) -> str:
    digits = _NOT_DIGIT.sub("", word)
    if kind == 2:
        return "1" if luhn(digits) else "0"
    if kind == 3:
        return "0" if len(set(digits)) < 3 else "-"
    return "-"


def vote(kind: int, text: str, start: int, stop: int) -> str:
    """One character a labeler: 1 yes, 0 no, - abstains."""
    word, before = text[start:stop], text[max(0, start - AROUND) : start]
    shape = "1" if _SHAPES[kind].fullmatch(word) else "0"
    if kind == 0 and shape == "0" and (CUES.search(before) or re.match(r"\S*[0-9._]", word)):
        shape = "-"  # at and dot as plain words: an address where something else speaks for it
    context = "1" if CUES.search(before) else "0" if COUNTER.search(before) else "-"
    return shape + _gazetteer(kind, word) + context + _checksum(kind, word)


_GROUP = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_BESIDE = re.compile(r"\w+")


def _outline(word: str) -> str:
    """The span's groups: digits by number, words by case, other characters as they are."""
    out = []
    for g in _GROUP.findall(word):
        out.append(f"9{len(g)}" if g[0].isdigit() else (("A" if g[0].isupper() else "a") + ("a" if g[1:].islower() else "A" if g[1:] else "")) if g[0].isalpha() else " " if g.isspace() else g)
    return "".join(out)


def span_features(kind: int, text: str, start: int, stop: int) -> list[int]:
    """Hashed features of a span: its characters and its neighbours, never the votes."""
    word = text[start:stop]
    digits = _NOT_DIGIT.sub("", word)
    before, after = _BESIDE.findall(text[max(0, start - AROUND) : start].lower())[-2:], _BESIDE.findall(text[stop : stop + AROUND].lower())[:1]
    outline = _outline(word)
    own = ["kind", f"outline {outline}", f"head {outline[:3]}", f"tail {outline[-3:]}", f"digits {len(digits)}", f"length {min(9, (stop - start) // 6)}", f"first {word[:1]}"]
    own += [f"luhn {luhn(digits)}"] if len(digits) > 11 else []
    own += [f"varied {len(set(digits)) > 2}"] if digits else []
    own += [f"last {re.split(r'[^A-Za-z0-9]+', word.lower().rstrip(')]}'))[-1]}"] if kind == 0 else []
    own += [f"word {w}" for w in re.findall(r"\w+", word.lower())[:3]] if kind == 4 else []
    own += [f"before {w}" for w in before] + [f"after {w}" for w in after]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % FEATURES for x in own})


def decoys(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of what looks like a base span and fails its check."""
    out = []
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and not luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if not 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, votes) of what the base patterns leave; no two overlap."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    # each test is for what the pattern cannot do without, in any case of letters
    if any(x in low for x in _AT) and any(x in low for x in _DOT):
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if ":" in text:
        found += [(1, *m.span()) for m in _LONG_IP.finditer(text)]
    if _FOUR.search(text):
        found += [(2, *m.span()) for m in _LOOSE_CARD.finditer(text)]
        found += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    found += [(4, *m.span()) for m in _TITLED.finditer(text)]
    found += [(4, *m.span(1)) for m in _CALLED.finditer(text)]
    found += [(4, *m.span()) for m in _TWO.finditer(text) if m.group().split(" ")[0].lower() in GIVEN]
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for kind, a, b in found:
        at = bisect_left(taken, (a, a))
        if (at == len(taken) or b <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= a):
            taken.insert(at, (a, b))
            out.append((kind, a, b, vote(kind, text, a, b)))
    return out


_FOUR = re.compile(r"[0-9]{4}")


#: what a scanned span is: of a base pattern, a candidate, or a look-alike known to be false
BASE, ADDED, FALSE = 0, 1, 2


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
            text = text or ""
            base = base_spans(text)
            more = candidates(text, base)
            listed = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
            n = [sum(1 for k, _, _ in base if k == i) for i in range(4)]
            judged = [(BASE, k, a, b, vote(k, text, a, b) + "=") for k, a, b in base] + [(ADDED, *c) for c in more]
            judged += [(FALSE, k, a, b, vote(k, text, a, b) + "!") for k, a, b in decoys(text)]
            spans = [{"kind": k, "start": a, "stop": b, "state": state, "votes": f"{k}{v}", "features": span_features(k, text, a, b)} for state, k, a, b, v in judged]
            rows.append((doc_id, *n, hashlib.sha256(",".join(listed).encode()).hexdigest(), spans))
        yield pd.DataFrame(
            {
                "doc_id": pd.array([r[0] for r in rows], dtype="Int64"),
                **{f"n_{k}": np.array([r[1 + i] for r in rows], dtype="int64") for i, k in enumerate(KINDS[:4])},
                "base_sha256": objects([r[5] for r in rows]),
                "spans": objects([r[6] for r in rows]),
            }
        )


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over pattern counts: (posterior of each pattern, reliability [labeler, truth, vote]).

    A pattern is the kind's number and a vote of each labeler, then ``=`` for a
    base span and ``!`` for what is known to be false. A kind's reliabilities
    are drawn to those of all kinds by ``SHARED`` spans' weight; those of all
    are returned, of votes alone and so 1 for abstaining. The share of true
    ones is a kind's own.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 3)
    code = {"0": 0, "1": 1, "-": 2}
    votes = np.array([[code[c] for c in k[1 : 1 + len(LABELERS)]] for k in keys])
    kind = np.array([int(k[0]) for k in keys])
    weight = np.array([patterns[k] for k in keys], dtype=float)
    # a start from the votes: each yes raises, each no lowers
    score = (votes == 1).sum(1) - 1.5 * (votes == 0).sum(1)
    free = np.array([not k.endswith("!") for k in keys])
    post = free / (1 + np.exp(-score))
    # candidates have a share of true ones of their own, whatever base spans have
    group = kind * 2 + np.array([k.endswith("=") for k in keys])
    for _ in range(rounds):
        rel, own = np.empty((len(LABELERS), 2, 3)), np.empty((len(KINDS), len(LABELERS), 2, 3))
        for j in range(len(LABELERS)):
            for truth in (0, 1):
                share = weight * (post if truth else 1 - post)
                counts = np.array([[share[(votes[:, j] == v) & (kind == k)].sum() for v in range(3)] for k in range(len(KINDS))])
                # prior counts: a labeler that votes is right nine times in ten; one that abstains says nothing
                voted = counts[:, :2].sum(0) + np.array([1.0 + 8 * (truth == 0), 1.0 + 8 * (truth == 1)])
                rel[j, truth, :2], rel[j, truth, 2] = voted / voted.sum(), 1.0
                own[:, j, truth, :2] = (counts[:, :2] + SHARED * rel[j, truth, :2]) / (counts[:, :2].sum(1)[:, None] + SHARED)
                own[:, j, truth, 2] = 1.0
        # the share among those that aren't known to be false
        prior = np.array([((weight * post)[group == g].sum() + LEAST_EACH / 2) / ((weight * free)[group == g].sum() + LEAST_EACH) for g in range(2 * len(KINDS))])[group]
        log1 = np.log(prior) + sum(np.log(own[kind, j, 1, votes[:, j]]) for j in range(len(LABELERS)))
        log0 = np.log(1 - prior) + sum(np.log(own[kind, j, 0, votes[:, j]]) for j in range(len(LABELERS)))
        post = free / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
    return dict(zip(keys, post.tolist(), strict=True)), rel


def span_classifier(features: list[list[int]], target: list[float], weight: list[float] | None = None, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by gradient steps scaled to each feature's weighted frequency."""
    if not features:
        return np.zeros(FEATURES)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, dtype=np.int64) for f in features])
    y, beta, share = np.array(target), np.zeros(FEATURES), np.ones(len(features)) if weight is None else np.array(weight)
    often = np.bincount(col, share[row], FEATURES) + 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, beta[col], len(features))))
        beta += 0.4 * (np.bincount(col, (share * (y - p))[row], FEATURES) / often - ridge * beta)
    return beta


def find_pii(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, and ``found``: an array of (kind, start, stop) by kind, then start."""
    span = "struct<kind:int,start:int,stop:int,state:int,votes:string,features:array<int>>"
    schema = f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans array<{span}>"
    scanned = spill(bounded(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(tidy(_scan), schema), "pii")
    each = scanned.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counted = each.groupBy("votes", "state").count().collect()
    patterns: dict[str, int] = {}
    for r in counted:
        patterns[r.votes] = patterns.get(r.votes, 0) + r["count"]
    post, _ = reliabilities(patterns)
    sides = np.zeros((len(KINDS), 2))
    for r in counted:
        if r.state == ADDED:
            sides[int(r.votes[0]), int(post[r.votes] >= 0.5)] += r["count"]
    learned = [k for k in range(len(KINDS)) if sides[k].min() >= LEAST_EACH]
    turn = F.xxhash64("doc_id", "kind", "start", "votes")
    sample = each.orderBy(turn, "votes", "features").select("kind", "votes", "features").limit(SAMPLE_SPANS).collect() if learned else []
    share = np.zeros((len(KINDS), 2))
    for r in sample:
        share[r.kind, int(post[r.votes] >= 0.5)] += 1
    even = [len(sample) / (2 * len(KINDS) * share[r.kind, int(post[r.votes] >= 0.5)]) for r in sample]
    beta = span_classifier([r.features for r in sample], [post[r.votes] for r in sample], even)
    weights = F.split(F.lit(",".join(f"{x:.9g}" for x in beta)), ",").cast("array<double>")
    logit = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda acc, k: acc + F.element_at(weights, k + 1))
    least = math.log(threshold / (1 - threshold))
    likely = F.array(*[F.lit(v) for v, p in sorted(post.items()) if p >= threshold]).cast("array<string>")
    judged = lambda s: F.when(s["kind"].isin(learned), logit(s) >= least).otherwise(F.array_contains(likely, s["votes"])) if learned else F.array_contains(likely, s["votes"])
    taken = F.filter("spans", lambda s: (s["state"] == BASE) | ((s["state"] == ADDED) & judged(s)))
    plain = F.transform(taken, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return scanned.withColumn("found", F.sort_array(plain)).drop("spans")


def span_text(column: str = "found"):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

"""Secret spans in whole texts, with DataFrame functions only.

Three patterns give the base spans. Further spans come from a log-likelihood
ratio: two character Markov models, one of random strings and one of ordinary
identifiers, judge tokens, and one that is likelier under the first, by a
margin a character and by ``LEAST_NATS`` as a whole, is reported as kind
``random``. Judged are all tokens of 16 characters or more, and shorter ones
from eight on that hold letters and digits; what has fewer than
``KINDS_LEAST`` different characters (a ruler, a run of one digit) is never
taken for random, so nothing shorter can be.

The models are fitted on labelled samples. Random: values that the base
patterns find in a bounded sample of the documents (``SAMPLE_ROWS``, by hash of
the text), and strings drawn in six alphabets. Ordinary: tokens of the same
documents that hold no digit or fall into few groups of letters and digits;
identifiers put together from their words and from programmers' words; names
with versions, dates, product and article numbers, platforms, encodings, paths;
and numbers. A fifth of the samples, by hash, is held out for the margin,
which is never negative: an ordinary string weighs ``ORDINARY_WEIGHT`` times as
much there, as they are that much more frequent. Another fifth takes no part in
either, and precision and recall on it come with the model.

Defined results for odd input: a null text is an empty text and has no spans;
an empty table gives no rows; repeated rows are scanned each on their own;
other columns pass through untouched, whatever their names, but for one called
secret_spans in any case of letters, which the result's own replaces. Offsets
count code points, ends are exclusive. A text of very many matches costs its
length times the logarithm of their number.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.llm.frames import quoted, without
from lakepress.plans.workdir import spill

# fixed values: the base patterns
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6

#: tokens that the models judge, and the different characters that a random one holds at least
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]{16,}|(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{8,15})(?![A-Za-z0-9+/_=-])"
KINDS_LEAST = 8
#: by how much a token must be likelier under the random model, in nats
LEAST_NATS = 6.0
KINDS = ("assign", "access", "hex", "random")

FIRST, SPAN = 32, 95
#: documents that samples come from, words and strings of each source taken at most
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_STRINGS = 2000, 3000, 4000
#: what an ordinary string weighs on the held-out part against a random one
ORDINARY_WEIGHT = 50
#: margins that are tried, in nats a character
MARGINS = tuple(round(0.05 * k, 2) for k in range(41))
#: letters and digits of a token that a group of either must have on average, for it to be structured and so ordinary
GROUPED = 3.5
#: matches that are located in one go
BLOCK = 256

# programmers' words for the sample of ordinary identifiers, joined in five styles
VERBS = "get set load read write parse build make find create update remove merge split check count render fetch send open close start stop sort filter".split()
NOUNS = "user account document session message customer order invoice product category article comment setting network database connection response request header template language country address payment number version".split()
TAILS = "name list index value table count status handler factory manager config buffer length offset result context service client server size type map key path file".split()


def _joined(parts: list[Column], style: Column) -> Column:
    cap = [F.initcap(p) for p in parts]
    snake = F.concat_ws("_", *parts)
    return (
        F.when(style == 0, snake)
        .when(style == 1, F.upper(snake))
        .when(style == 2, F.concat_ws("-", *parts))
        .when(style == 3, F.concat(parts[0], *cap[1:]))
        .otherwise(F.concat(*cap))
    )


def _pick(words: list[str], salt: int) -> Column:
    listed = F.split(F.lit(" ".join(words)), " ")
    return F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def drawn_strings(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """(label, s): ``n`` random strings of 10 to 43 characters in six alphabets."""
    i = F.col("id")
    raw = F.concat(F.sha2(F.concat(F.lit("sample-"), i.cast("string")), 256), F.sha2(F.concat(F.lit("again-"), i.cast("string")), 256))
    drawn = F.base64(F.unhex(raw))
    bare = F.regexp_replace(drawn, "[+/=]", "")
    random = (
        F.when(i % 6 == 0, raw)
        .when(i % 6 == 1, F.translate(drawn, "=", ""))
        .when(i % 6 == 2, bare)
        .when(i % 6 == 3, F.upper(bare))
        .when(i % 6 == 4, F.translate(drawn, "+/=", "-_"))
        .otherwise(F.lower(bare))
    )
    return spark.range(0, n, 1, 1).select(F.lit(1).alias("label"), F.substr(random, F.lit(1), (10 + F.pmod(i * 7, F.lit(34))).cast("int")).alias("s"))


def ordinary_strings(spark: SparkSession, words: list[str], n: int = SAMPLE_STRINGS) -> DataFrame:
    """(label, s): identifiers of programmers' words and of ``words``, a quarter as many numbers."""
    i = F.col("id")
    parts = [_pick(VERBS, 1), _pick(NOUNS, 2), _pick(TAILS, 3)]
    number = F.when(i % 7 == 0, (i % 40).cast("string")).otherwise(F.lit(""))
    style = F.pmod(F.xxhash64(i, F.lit(4)), F.lit(5))
    base = spark.range(0, n, 1, 1)
    out = base.select(F.lit(0).alias("label"), F.concat(_joined(parts, style), number).alias("s"))
    if words:
        own = [_pick(words, k) for k in (5, 6, 7)]
        out = out.unionByName(base.select(F.lit(0).alias("label"), F.concat(_joined(own, style), number).alias("s")))
    for vocabulary in ([], words) if words else ([],):
        out = out.unionByName(base.select(F.lit(0).alias("label"), _structured(vocabulary).alias("s")))
    digits = F.translate(F.sha2(F.concat(F.lit("number-"), i.cast("string")), 256), "abcdef", "")
    return out.unionByName(spark.range(0, n // 4, 1, 1).select(F.lit(0).alias("label"), F.substr(digits, F.lit(1), (16 + i % 5).cast("int")).alias("s")))


def _digits(k: int, salt: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**k)).cast("string"), k, "0")


def _structured(words: list[str]) -> Column:
    """What people write with digits in it: versions, dates, product numbers, platforms, encodings, paths."""
    w = [_pick(words or [*VERBS, *NOUNS, *TAILS], salt) for salt in (11, 12, 13)]
    sep = F.element_at(F.array(F.lit("-"), F.lit("_"), F.lit("/"), F.lit("-")), (F.pmod(F.xxhash64("id", F.lit(14)), F.lit(4)) + 1).cast("int"))
    version = lambda at: F.concat(_digits(1, at), sep, _digits(2, at + 1), sep, _digits(1, at + 2))
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(20)), F.lit(12000)).cast("int")), "yyyy-MM-dd")
    clock = F.concat(F.lit("T"), _digits(2, 21), F.lit("-"), _digits(2, 22), F.lit("-"), _digits(2, 23), F.lit("Z"))
    two = F.substr(w[2], F.lit(1), F.lit(2))
    made = [
        F.concat(w[0], _digits(1, 24), sep, w[1], sep, w[2]),
        F.concat(w[0], sep, w[1], sep, version(25), sep, w[2]),
        F.concat(day, clock, sep, w[0]),
        F.concat(w[0], sep, F.translate(day, "-", ""), sep, _digits(6, 28)),
        F.concat(F.upper(F.substr(w[0], F.lit(1), F.lit(4))), F.lit("-"), _digits(3, 29), F.lit("-"), _digits(1, 30), F.lit("-"), _digits(2, 31), F.lit("-"), _digits(6, 32), F.lit("-"), _digits(1, 33)),
        F.concat(F.upper(F.substr(w[0], F.lit(1), F.lit(3))), sep, _digits(4, 34), sep, F.upper(two), sep, F.upper(w[1]), sep, _digits(4, 35)),
        F.concat(F.substr(w[0], F.lit(1), F.lit(1)), _digits(2, 36), F.lit("_"), _digits(2, 37), F.lit("-"), w[1], F.lit("-"), w[2], F.lit("-"), F.substr(w[0], F.lit(1), F.lit(3))),
        F.concat(F.substr(w[0], F.lit(1), F.lit(3)), _digits(1, 38), two, _digits(1, 39), F.lit("_"), w[1], F.lit("_"), _digits(3, 40), F.lit("_"), two),
        F.concat(w[0], F.lit("/"), F.upper(F.substr(w[1], F.lit(1), F.lit(4))), F.lit("-"), _digits(4, 41), F.lit("-"), w[2], F.lit("-"), w[1]),
        F.concat(F.initcap(w[0]), F.initcap(w[1]), _digits(2, 42), F.initcap(w[2]), F.lit("V"), _digits(1, 43)),
    ]
    turn = F.pmod(F.xxhash64("id", F.lit(44)), F.lit(len(made)))
    return F.coalesce(*[F.when(turn == k, m) for k, m in enumerate(made)])


def corpus_strings(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """((label, s) of sampled documents, their words): base values are random, tokens without digits or of few groups are ordinary."""
    n = docs.count()
    grid = 1 << 20
    share = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * grid) + 1
    # equal texts count once, so a sample of copies stays small
    some = docs.select(F.col(text).alias("body")).where(F.pmod(F.xxhash64("body"), F.lit(grid)) < share).where("body is not null").groupBy(F.xxhash64("body").alias("h")).agg(F.first("body").alias("body"))
    some = spill(some, "secret-sample")

    def strings(label: int, pattern: str, group: int, keep: Column) -> DataFrame:
        found = some.select(F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(group))).alias("s")).where(keep).distinct()
        return found.orderBy(F.xxhash64("s"), "s").limit(SAMPLE_STRINGS).select(F.lit(label).alias("label"), "s")

    long = F.length("s") >= 16
    groups = F.regexp_count("s", F.lit("[A-Z]*[a-z]+|[A-Z]+|[0-9]+"))
    based = F.col("s").rlike(HEX) | F.col("s").rlike(ACCESS)
    plain = ~based & (~F.col("s").rlike("[0-9]") | (groups * GROUPED <= F.length(F.regexp_replace("s", "[^A-Za-z0-9]", ""))))
    labelled = strings(1, ASSIGN, 2, long & F.col("s").rlike("[0-9]")).unionByName(strings(1, HEX, 0, long)).unionByName(strings(1, ACCESS, 0, long)).unionByName(strings(0, TOKEN, 0, plain))
    words = some.select(F.explode(F.regexp_extract_all("body", F.lit("[A-Za-z]{3,12}"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS)
    return labelled, sorted(r.w for r in words.collect())


def train_ratio(strings: DataFrame, smooth: float = 0.2) -> list[float]:
    """log P_random(b | a) - log P_ordinary(b | a) for each pair of printable characters a, b, in row order.

    The table has 95 x 95 entries whatever the input; only pair counts reach the driver.
    """
    at = F.sequence(F.lit(1), F.length("s") - 1)
    pairs = strings.where(F.length("s") > 1).select("label", F.explode(F.transform(at, lambda k: F.substr(F.col("s"), k, F.lit(2)))).alias("p"))
    counts = pairs.groupBy("label", "p").count().collect()
    table = [[smooth] * (SPAN * SPAN) for _ in range(2)]
    for r in counts:
        a, b = (ord(c) - FIRST for c in r.p)
        if 0 <= a < SPAN and 0 <= b < SPAN:
            table[r.label][a * SPAN + b] += r["count"]
    out = []
    for a in range(SPAN):
        rows = [t[a * SPAN : (a + 1) * SPAN] for t in table]
        sums = [sum(r) for r in rows]
        out += [math.log(x / sums[1]) - math.log(y / sums[0]) for y, x in zip(*rows, strict=True)]
    return out


class SecretModel(NamedTuple):
    """Log-ratios of character pairs, the margin, and what it gives on samples that neither was chosen by."""

    ratio: list[float]
    margin: float
    precision: float
    recall: float


def train(docs: DataFrame, text: str = "text") -> SecretModel:
    """Both Markov models and the margin, from labelled samples of ``docs`` and drawn strings."""
    spark = docs.sparkSession
    own, words = corpus_strings(docs, text)
    strings = spill(own.unionByName(drawn_strings(spark)).unionByName(ordinary_strings(spark, words)).dropDuplicates(["s"]), "secret-strings")
    part = F.pmod(F.xxhash64("s", F.lit(1)), F.lit(5))
    ratio = train_ratio(strings.where(part > 1))
    total = total_ratio(F.col("s"), ratio)
    judged = strings.where((part < 2) & varied(F.col("s"))).select("label", part.alias("part"), F.when(total >= LEAST_NATS, total / (F.length("s") - 1)).otherwise(-1.0).alias("score"))
    counts = judged.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") > m).alias(f"m{k}") for k, m in enumerate(MARGINS)]).collect()
    by = {(r.part, r.label): r for r in counts}
    if len(by) < 4:
        return SecretModel(ratio, MARGINS[-1], 0.0, 0.0)
    tries = []
    for k in range(len(MARGINS)):
        hit, wrong = by[0, 1][f"m{k}"], by[0, 0][f"m{k}"]
        tries.append((2 * hit / (hit + by[0, 1].n + ORDINARY_WEIGHT * wrong) if hit else 0.0, k))
    best = max(tries)[1]
    hit, wrong = by[1, 1][f"m{best}"], by[1, 0][f"m{best}"]
    return SecretModel(ratio, MARGINS[best], hit / (hit + wrong) if hit else 0.0, hit / by[1, 1].n)


def varied(token: Column) -> Column:
    return F.size(F.array_distinct(F.split(token, ""))) >= KINDS_LEAST


def total_ratio(token: Column, ratio: list[float]) -> Column:
    """The token's log-likelihood ratio."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratio)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, acc["last"] * SPAN + c + 1))
        return F.struct(c.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.filter(codes, lambda c: c >= 0), start, step)["sum"]


def is_random(token: Column, model: SecretModel) -> Column:
    total = total_ratio(token, model.ratio)
    return (total >= LEAST_NATS) & (total > model.margin * (F.length(token) - 1))


def _meets(span: Column, others: Column) -> Column:
    """Whether ``span`` overlaps one of ``others``, which lie in order and apart: the last that starts before its end is found by halving."""
    halved = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + 1.0)).cast("int")),
        F.struct(F.lit(0).alias("low"), F.size(others).alias("high")),
        lambda at, _: F.when(
            at["low"] < at["high"],
            F.when(F.get(others, F.shiftright(at["low"] + at["high"], 1))["start"] < span["stop"], F.struct((F.shiftright(at["low"] + at["high"], 1) + 1).alias("low"), at["high"].alias("high"))).otherwise(
                F.struct(at["low"].alias("low"), F.shiftright(at["low"] + at["high"], 1).alias("high"))
            ),
        ).otherwise(at),
    )
    return F.when(F.size(others) > 0, F.coalesce(F.get(others, halved["low"] - 1)["stop"] > span["start"], F.lit(False))).otherwise(F.lit(False))


def _located(kind: int, found: Column, between: Column, keep: Column | None = None) -> Column:
    """Spans of successive matches from the matches and the pieces between them.

    Spans are appended within blocks of ``BLOCK`` matches, so that a text of very many matches costs no copy of all before each.
    """
    none = F.array().cast(f"array<{SPAN_TYPE}>")

    def step(acc: Column, k: Column) -> Column:
        word = F.get(found, k)
        at = acc["at"] + F.length(F.get(between, k))
        stop = at + F.length(word)
        take = F.array_append(acc["spans"], F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), word.alias("word")))
        if keep is not None:
            take = F.when(F.length(F.get(keep, k)) >= ASSIGN_MIN, take).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), take.alias("spans"))

    def block(acc: Column, first: Column) -> Column:
        some = F.sequence(first, F.least(first + (BLOCK - 1), F.size(found) - 1))
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.struct(done["at"].alias("at"), F.array_append(acc["blocks"], done["spans"]).alias("blocks"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN_TYPE}>>").alias("blocks"))
    walked = F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK)), start, block)["blocks"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


SPAN_TYPE = "struct<start:int,kind:int,stop:int,word:string>"


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with secret_spans, an array of (start, kind, stop) by start, then kind as in ``KINDS``."""
    model = model or train(docs, text)
    # the input's columns travel inside one, so names of the steps below meet none of theirs
    own = without(docs, "secret_spans")
    df = docs.select(F.struct(*map(quoted, own)).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
    for k, p in patterns.items():
        df = df.withColumn(f"m_{k}", F.regexp_extract_all("body", F.lit(p), F.lit(0)))
    df = df.withColumn("values", F.when(F.size("m_assign") > 0, F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(2))))
    empty = F.array().cast("array<string>")
    for k, p in patterns.items():
        df = df.withColumn(f"p_{k}", F.when(F.size(f"m_{k}") > 0, F.split("body", p, -1)).otherwise(empty))
    for i, k in enumerate(KINDS[:3]):
        df = df.withColumn(f"b_{k}", _located(i, F.col(f"m_{k}"), F.col(f"p_{k}"), F.col("values") if k == "assign" else None))
    bases = [F.col(f"b_{k}") for k in KINDS[:3]]
    df = df.withColumn("tokens", _located(3, F.col("m_random"), F.col("p_random")))
    fresh = F.filter(
        "tokens",
        lambda s: varied(s["word"]) & is_random(s["word"], model) & ~(_meets(s, bases[0]) | _meets(s, bases[1]) | _meets(s, bases[2])),
    )
    spans = F.concat(*bases, F.when(F.size("tokens") > 0, fresh).otherwise(F.col("tokens")))
    df = df.withColumn("spans", spans)
    plain = F.transform(F.sort_array("spans"), lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    found = F.when(F.size("spans") > 0, plain).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    return df.select(*[F.col(f"own.{quoted(c)}").alias(c) for c in own], found.alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    walked = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(walked["out"], F.substr(text, walked["at"] + 1, F.length(text)))).otherwise(text)

"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from lakepress.llm import ann, line_chunks, media, ngram_join, packing, pii, secret_scan, sentencepiece_ffbs, sharding, toxicity

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
#: columns whose names the operators use inside or give to results, in other cases of letters too
CLASHING = ("row", "Kept", "repeats", "own", "Body", "spans", "tokens", "score", "SCORE_", "__Row", "before", "shard_", "Sig", "component", "text_hash", "m_hex", "vals", "N_Removed", "Piece_IDS", "Decoded", "Secret_Spans")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potent magic for the frozen king of winter "
ROWS = [(1, None), (2, ""), (3, "short text"), (3, "short text"), (None, "no id token = abcdef123456"), (None, None), (4, PROSE * 9000), (5, "  \n\t \n"), (6, "żółć ▁   日本 🎉"), (7, PROSE), (8, PROSE.upper())]


@pytest.fixture(scope="module")
def clash(spark):
    day = dt.datetime(2024, 1, 2, 3)
    rows = [(i, t, {"k": [n]}, day, *[f"{c}-{n}" for c in CLASHING]) for n, (i, t) in enumerate(ROWS)]
    schema = "doc_id bigint, text string, extra map<string,array<int>>, at timestamp, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).cache()


def kept_as_they_are(out, *replaced):
    """Every column but the replaced ones has its values, and no two names differ in case alone."""
    low = [c.lower() for c in out.columns]
    assert len(set(low)) == len(low)
    rows = sorted(out.collect(), key=lambda r: r["at"].isoformat() + r["extra"]["k"][0].__format__("04d"))
    assert len(rows) == len(ROWS)
    for n, r in enumerate(rows):
        assert r["doc_id"] == ROWS[n][0] and r["extra"] == {"k": [n]} and r["at"] == dt.datetime(2024, 1, 2, 3)
        for c in CLASHING:
            if c.lower() not in replaced:
                assert r[c] == f"{c}-{n}", c
    return rows


def test_pieces_keep_other_columns(clash):
    coded = sentencepiece_ffbs.encode(clash, PIECES)
    rows = kept_as_they_are(coded, "piece_ids")
    assert [r.piece_ids is None for r in rows] == [t is None for _, t in ROWS] and rows[1].piece_ids == []
    assert rows[2].piece_ids == rows[3].piece_ids
    back = kept_as_they_are(sentencepiece_ffbs.decode(coded, PIECES), "piece_ids", "decoded")
    assert [r.decoded for r in back] == [t for _, t in ROWS]


def test_lines_keep_other_columns(clash):
    rows = kept_as_they_are(line_chunks.dedup_lines(clash), "n_removed")
    for n, r in enumerate(rows):
        if ROWS[n][1] is None:
            assert r.text is None and r.n_lines is None and r.n_removed is None
    assert rows[1].text == "" and rows[2].text == rows[3].text == "short text" and rows[4].text == ROWS[4][1]
    assert rows[5].n_lines is None and rows[8].text == ROWS[8][1]


def test_secrets_keep_other_columns(clash):
    rows = kept_as_they_are(secret_scan.scan_secrets(clash), "secret_spans")
    assert all(r.secret_spans == [] for n, r in enumerate(rows) if n != 4)
    assert [tuple(s) for s in rows[4].secret_spans] == [(6, 0, 6 + len("token = abcdef123456"))]


def test_toxicity_keeps_other_columns(clash):
    model = toxicity.ToxicityModel(toxicity.char_model(clash), {"wizards": 5.0}, np.array([-4.0, 8.0, 8.0, 4.0]))
    rows = toxicity.keep_clean(clash, model).collect()
    assert len(rows) == len(ROWS) - 3 and toxicity.keep_clean(clash, model).columns == clash.columns
    scores = toxicity.score(clash, model).collect()
    assert len(scores) == len(ROWS) and sum(r.predicted for r in scores) == 3 and {r.score for r in scores if r.doc_id in (1, 2)} == {scores[0].score}


def test_other_operators_ignore_other_columns(clash):
    n = len(ROWS)
    assert pii.find_pii(clash).count() == n
    got = media.chunked_media(clash).collect()
    assert Counter(r.n_bytes for r in got) == Counter(len((t or "").encode()) for _, t in ROWS)
    shards = sharding.shard_documents(clash).collect()
    assert len(shards) == n and Counter(r["size"] for r in shards) == Counter(len((t or "").encode()) + 8 for _, t in ROWS)
    sets = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_duplicates(clash).collect()}
    # the long text repeats one sentence, so 17 of its 21 shingles are the sentence's
    assert sets[(1, 0)] == 1 and sets[(2, 0)] == 2 and sets[(3, 1)] == 3 and sets[(4, 21)] == sets[(7, 17)] == sets[(8, 17)] == 4
    packed = defaultdict(int)
    for r in packing.pack(clash, WORDS).collect():
        packed[(r.doc_id, r.doc_tokens)] += r.length
    assert {i for i, _ in packed} == {i for i, _ in ROWS} and packed[(1, 1)] == packed[(2, 1)] == 1
    assert all(n == total * (1 + (i == 3)) for (i, total), n in packed.items())


# ---- 1: long runs


def test_long_runs_are_drawn_whole():
    v = sentencepiece_ffbs.vocabulary(PIECES)
    word = "there"
    exact = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if all(p in v.weight for p in parts):
            exact[tuple(v.weight[p][0] for p in parts)] = math.exp(sum(v.weight[p][1] for p in parts))
    n = 20_000
    seen = Counter(tuple(sentencepiece_ffbs.draw_long(word, v, sentencepiece_ffbs._mix_one(i))) for i in range(n))
    assert set(seen) <= set(exact)
    for k, w in exact.items():
        assert seen[k] / n == pytest.approx(w / sum(exact.values()), abs=0.015)
    s = sentencepiece_ffbs.Sampler(PIECES, 3)
    texts = ["x" * 700 + " then more " + "日本" * 400, "", "plain", "abc" * 600]
    ids = s.sample(texts, [1, 2, 3, 4])
    assert [s.v.decode(x).decode() for x in ids] == texts
    again = s.sample(texts[::-1], [4, 3, 2, 1])[::-1]
    assert all((a == b).all() for a, b in zip(ids, again, strict=True))
    # a piece may stand across any place of a long run
    ends = set()
    for k in range(60):
        ends.update(np.cumsum(s.v.lengths[s.sample(["the" * 400], [k])[0]]).tolist())
    assert 512 in ends and any(512 not in np.cumsum(s.v.lengths[s.sample(["the" * 400], [k])[0]]).tolist() for k in range(60))


# ---- 2: precision and recall


def labelled_texts(rng, n):
    """(text, true spans by kind) with as many decoys of the same looks."""
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9)))
    filler = lambda k: " ".join(word() for _ in range(k))
    names = [x.capitalize() for x in sorted(pii.GIVEN) if x.isascii()]
    out = []
    for _ in range(n):
        kind, true = rng.choice([0, 2, 3, 4]), rng.random() < 0.5
        if kind == 0:
            span = f"{word()}.{word()} (at) {word()} (dot) {rng.choice(['com', 'org', 'de'])}" if true else f"{word()} at {word()} dot {word()}"
            text = f"{filler(6)} {rng.choice(['email', 'contact', 'write to']) if true else word()} {span}, {filler(4)}"
        elif kind == 2:
            digits = f"{rng.choice('45')}{rng.randrange(10**14):014d}" if true else f"{rng.choice('12789')}{rng.randrange(10**14):014d}"
            digits += next(c for c in "0123456789" if pii.luhn(digits + c) == true)
            span = ".".join(digits[i : i + 4] for i in range(0, 16, 4))
            text = f"{filler(6)} {rng.choice(['card', 'visa']) if true else rng.choice(['order', 'serial'])} {span} {filler(4)}"
        elif kind == 3:
            span = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}" if true else f"{rng.randint(100, 199)}-{rng.randint(0, 199):03d}-{rng.choice([1111, 1112, 1000])}"
            text = f"{filler(6)} {rng.choice(['call', 'phone', 'tel']) if true else rng.choice(['part', 'invoice'])} {span} {filler(4)}"
        else:
            span = f"Dr. {rng.choice(names)} {word().capitalize()}" if true else f"Mr {word().capitalize()}"
            text = f"{filler(6)} {rng.choice(['signed', 'contact']) if true else rng.choice(['page', 'version'])} {span} {filler(4)}"
        a = text.index(span)
        out.append((text, kind, a, a + len(span), true))
    return out


def test_added_spans_are_right_and_most_are_found(spark):
    rows = labelled_texts(random.Random(4), 1200)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find_pii(docs).collect()}
    for kind in (0, 2, 3, 4):
        hit = sum(1 for i, r in enumerate(rows) if r[1] == kind and r[4] and r[1:4] in found[i])
        wrong = sum(1 for i, r in enumerate(rows) if r[1] == kind and not r[4] and any(s[0] == kind for s in found[i]))
        true = sum(1 for r in rows if r[1] == kind and r[4])
        assert hit / true >= 0.9, (pii.KINDS[kind], hit, true)
        assert hit / (hit + wrong) >= 0.9, (pii.KINDS[kind], hit, wrong)


def test_candidates_overlap_nothing():
    text = "Dr. Anna Smith, my name is Anna Smith; call 212-555-0199 at 4111.1111.1111.1111 or 1:2:3:4:5:6:7:8 jo (at) mail (dot) com 10.0.0.1"
    base = pii.base_spans(text)
    spans = sorted([(a, b) for _, a, b in base] + [(a, b) for _, a, b, _ in pii.candidates(text, base)])
    assert len(spans) >= 6 and all(x[1] <= y[0] for x, y in itertools.pairwise(spans))


# ---- 3: repeated ids, dimensions, ties


def test_neighbours_of_repeated_ids_and_odd_dimensions(spark):
    schema = "vec_id bigint, embedding array<double>, row int, a string"
    rows = [(0, [1.0, 0.0], 1, "x"), (0, [1.0, 0.1], 2, "y"), (1, [1.0, 0.05], 3, "z"), (3, [0.0, 1.0], 4, None), (None, [1.0, 0.0], 5, None)]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, schema)).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0), (0, 3, 3), (0, 3, 3)]
    one = [(0, [2.0], 1, ""), (50, [-3.0], 1, ""), (7, [5.0], 1, ""), (100, [1.0, 1.0], 1, ""), (101, [0.0, 2.0], 1, ""), (150, [], 1, ""), (200, [0.0], 1, "")]
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(one, schema)).collect()}
    assert got == {(0, 1): (7, 1.0), (0, 2): (50, -1.0), (50, 1): (0, -1.0), (50, 2): (7, -1.0), (100, 1): (101, round(2**-0.5, 6))}
    same = [(i, [3.0, 4.0], 0, None) for i in range(60)] * 2
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(same, schema)).collect()]
    assert sorted(got) == sorted([(0, k + 1, v) for k, v in enumerate([0, 1, 1, 2, 2])] * 2 + [(50, k + 1, v) for k, v in enumerate([0, 0, 1, 1, 2])] * 2)
    assert ann.search(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) + 3 * rng.normal(size=(30, 12))[rng.integers(0, 30, 900)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, every=10, candidates=900).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == ann.brute_force(np.arange(900), x, np.arange(0, 900, 10))


# ---- 4: against a version without hashes and joins


def brute_lines(rows):
    """Units by their bytes in one dictionary; every later one goes, with the equal lines around it."""
    places, text = defaultdict(list), {}
    for i, t in rows:
        text[i] = t.encode()
        bounds, units = line_chunks.units(text[i])
        for a, b in units:
            places[text[i][bounds[a] : bounds[b]]].append((i, a, b))
    repeats = defaultdict(list)
    for body, found in places.items():
        (i, a, b), later = min(found), sorted(found)[1:]
        bounds = line_chunks.line_bounds(text[i])
        context = (line_chunks._context(text[i], bounds, a - 1, -1), line_chunks._context(text[i], bounds, b, 1))
        for j, at, _ in later:
            repeats[j].append({"lines": [at], "before": context[0], "body": body, "after": context[1]})
    return {i: line_chunks.strip(t, repeats[i])[0] for i, t in rows}


def test_lines_equal_brute_force_with_hot_units(spark, monkeypatch):
    for name, value in (("SPLIT_ROWS", 5), ("SAMPLE", 4), ("HOT_SEEN", 6), ("SALTS", 3)):
        monkeypatch.setattr(line_chunks, name, value)
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["ka", "lo", "mi", "re", "su", "to"]) + str(rng.randrange(60)) for _ in range(n)) + rng.choice(["\n", "\n\n", ". "])
    pool = ["".join(line(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 9))) for _ in range(8)]
    rows = [(i, "".join([line(5), pool[0], *[rng.choice([rng.choice(pool), line(rng.randrange(1, 20))]) for _ in range(rng.randrange(0, 8))]])) for i in range(150)]
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    want = brute_lines(rows)
    assert [i for i in want if got[i] != want[i]] == []
    listed = spark.createDataFrame([(i, i * 7919, t) for i, t in rows], "doc_id bigint, row bigint, text string")
    assert line_chunks.hot_units(listed)
    assert sum(map(len, got.values())) < 0.6 * sum(len(t) for _, t in rows)


# ---- 5: Viterbi against all readings


def test_viterbi_finds_the_likeliest_reading():
    counts = Counter()
    for w in "hello world bottle little silly total level apple".split():
        for a, b in zip("^" + w, w + "$", strict=True):
            counts[a + b] += 3
    model = toxicity.CharModel(counts)

    def score(reads):
        s, a = sum(c for _, c in reads), "^"
        for b in "".join(t for t, _ in reads):
            s, a = s + model.step(a, b), b
        return s + model.step(a, "$")

    for token in ("h3ll0", "w0r1d", "b0tt1e", "l1tt|3", "si11y", "t0t4l", "aaapp1e", "l3v3l", "1111", "*e**o", "zz9@"):
        every = list(itertools.product(*toxicity.lattice(token)))
        best = max(map(score, every))
        assert any("".join(t for t, _ in r) == toxicity.decode(token, model) and score(r) >= best - 1e-9 for r in every), token


def test_pairs_are_counted_as_by_hand():
    texts = ["Straße ÉTÉ x2y a_b", "", "naïve 12 日本語 ab " + "z" * 40]
    got, want = Counter(), Counter()
    toxicity.count_pairs(texts, got)
    for t in texts:
        for w in toxicity._WORD.findall(t.lower()):
            want.update(a + b for a, b in zip("^" + w, w + "$", strict=True))
    assert got == want


# ---- 6: hot texts in the dictionary's sample


def test_media_of_one_hot_text(spark):
    rows = [(i, PROSE * 30) for i in range(300)] + [(1000 + i, "".join(random.Random(i).choices(string.ascii_letters + " ", k=9000))) for i in range(60)]
    got = {r.doc_id: r for r in media.chunked_media(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows[::37]:
        assert got[i].payload_sha256 == hashlib.sha256(media.payload(t)).hexdigest() and got[i].media_sha256 == hashlib.sha256(media.to_wave(media.payload(t))).hexdigest()


# ---- 7: precision and recall on strings the models have not seen


def test_random_strings_are_told_from_ordinary_ones(spark):
    rng = random.Random(11)
    syllables = ["tion", "er", "lich", "the", "ment", "ing", "keit", "eau", "ado", "que", "ver", "ston", "land", "berg", "ville"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(60)) + " " + "".join(rng.choices(syllables, k=7))) for i in range(300)]
    model = secret_scan.train(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert model.precision >= 0.98 and model.recall >= 0.9
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters, "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "-_"]
    secrets = ["".join(rng.choices(a, k=rng.randint(20, 40))) for a in alphabets for _ in range(60)]
    ordinary = [
        *["_".join(word() for _ in range(4)) for _ in range(80)], *["".join(word().capitalize() for _ in range(4)) for _ in range(80)], *["/" + "/".join(word() for _ in range(4)) for _ in range(60)],
        *[str(rng.randrange(10**15, 10**19)) for _ in range(60)], "-" * 40, "=" * 30, "w" * 500, "2024-01-02-2024-01-03",
    ]
    tokens = [t for t in secrets + ordinary if len(t) >= 16]
    rows = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "doc_id bigint, text string")
    hit = {r.doc_id for r in secret_scan.scan_secrets(rows, model).collect() if any(s.kind == 3 for s in r.secret_spans)}
    is_secret = [t in set(secrets) for t in tokens]
    found = sum(1 for i in hit if is_secret[i])
    assert found >= 0.9 * sum(is_secret) and found >= 0.97 * len(hit), (found, sum(is_secret), len(hit))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abc{i:06d}" for i in range(3000))
    r = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert [tuple(s) for s in r.secret_spans if s.kind == 0] == want


# ---- the pipeline's stages

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stage_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(40)]
    texts += texts[:5] + [t + " tail" for t in texts[5:15] if len(t.split()) > 30] + [f"{texts[0]} token = abcdef0123456789 AKIA{'Q7' * 9}", None, "", "\n", "deadbeef" * 6]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_input(spark, stage_rows, name):
    stage = dict(P.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(*r, "z", "Z") for r in stage_rows], COLUMNS + ", Row string, own string")
    out, none = stage(spark, docs, sf), stage(spark, spark.createDataFrame([], COLUMNS), sf)
    assert none.count() == 0
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {r[0] for r in stage_rows}
    else:
        assert out.columns == list(P.COLUMNS) and none.columns == list(P.COLUMNS)


def test_toxicity_stage_equals_scores_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    want = {r.doc_id for r in docs.collect() if model.scores([r.text], {})[0] < toxicity.THRESHOLD}
    assert {r.doc_id for r in P.drop_toxic(spark, docs, "/root/testdata/sf0.001").collect()} == want


def test_line_stage_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i: t for (i, old), t in zip(rows, (brute_lines(rows)[i] for i, _ in rows), strict=True) if t == old or t.strip(" \n\t\r")}
    got = {r.doc_id: r for r in P.dedup_lines(spark, docs, "").collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_copy_stage_equals_brute_force(spark, stage_rows):
    from tests.llm.test_llm import brute_classes

    rows = [r for r in dict.fromkeys(stage_rows) if r[0] is not None]
    classes = brute_classes([(r[0], r[1]) for r in rows])
    got = P.drop_near_copies(spark, spark.createDataFrame(stage_rows, COLUMNS), "").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in stage_rows if r[0] is None or classes[r[0]][1] == r[0])


def test_secret_stage_equals_brute_force(spark, stage_rows):
    from tests.llm.test_llm import brute_secrets

    def redacted(t):
        out, at = "", 0
        for a, _, b in brute_secrets(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    got = {r.doc_id: r for r in P.redact_secrets(spark, spark.createDataFrame(stage_rows, COLUMNS), "").where("doc_id is not null").collect()}
    assert {i: r.text for i, r in got.items()} == {r[0]: None if r[1] is None else redacted(r[1]) for r in stage_rows if r[0] is not None}


def test_nothing_else_needs_this_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "lakepress").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lakepress.llm" not in p.read_text(), p

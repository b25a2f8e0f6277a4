"""The training-data operators against brute force, round trips and odd input."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakepress.llm import ann, line_chunks, media, ngram_join, packing, pii, secret_scan, sentencepiece_ffbs, sharding, toxicity

SCHEMA = "doc_id bigint, text string, extra string"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "x"), (2, "", None), (3, "a b c", "y"), (None, "no id here", "z"), (3, "a b c", "y"), (5, "w" * 30_000, "q"), (6, "żółć ▁ \t\n <|endoftext|> 日本", "r")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 sampled segmentations


def test_sampling_is_lossless_and_repeats(spark, odd, none):
    coded = sentencepiece_ffbs.encode(odd, PIECES, seed=4)
    back = sentencepiece_ffbs.decode(coded, PIECES).collect()
    assert len(back) == len(ODD) and all(r.decoded == r.text for r in back)
    assert {c for c in coded.columns} == {"doc_id", "text", "extra", "piece_ids"}
    again = sentencepiece_ffbs.encode(odd.repartition(3), PIECES, seed=4)
    assert sorted((str(r.doc_id), str(r.piece_ids)) for r in again.collect()) == sorted((str(r.doc_id), str(r.piece_ids)) for r in coded.collect())
    assert sentencepiece_ffbs.encode(none, PIECES).count() == 0
    assert sentencepiece_ffbs.digests(odd, PIECES).where("not lossless").count() == 0


def test_sampling_follows_the_exact_posterior():
    v = sentencepiece_ffbs.vocabulary(PIECES)
    word = "the"
    exact = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if all(p in v.weight for p in parts):
            exact[tuple(v.weight[p][0] for p in parts)] = np.exp(sum(v.weight[p][1] for p in parts))
    total = sum(exact.values())
    n = 30_000
    got = sentencepiece_ffbs.Sampler(PIECES, 1).sample([word] * n, list(range(n)))
    seen = {}
    for g in got:
        seen[tuple(g.tolist())] = seen.get(tuple(g.tolist()), 0) + 1
    assert set(seen) <= set(exact)
    for k, w in exact.items():
        assert seen.get(k, 0) / n == pytest.approx(w / total, abs=0.01)


# ---- 2 personal data


def brute_base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("ab1234567890@@..-+ () ")
    texts = ["".join(rng.choice(alphabet, 400)) for _ in range(300)] + ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111x", "+1 (555) 123-4567", "300.1.1.1 010.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t)


def test_pii_query_columns(spark, odd, none):
    text = "call 212-555-0199 or write to jo at mail dot com; card 4111 1111 1111 1111, jo@x.org"
    rows = pii.find_pii(odd.unionByName(spark.createDataFrame([(9, text, None)], SCHEMA))).withColumn("spans", pii.span_text()).collect()
    assert len(rows) == len(ODD) + 1
    r = next(x for x in rows if x.doc_id == 9)
    base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_base(text)]
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(r.spans.split(","))
    assert next(x for x in rows if x.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(none).count() == 0


def test_spelled_addresses_in_any_form_are_candidates():
    for at in ("(at)", "[AT]", " {At} ", " at ", " AT "):
        for dot in ("(dot)", "[DOT]", " {Dot} ", " dot ", " DOT "):
            text = f"write to JOHN{at}EXAMPLE{dot}COM, please"
            assert [text[a:b] for k, a, b, _ in pii.candidates(text, [])] == [f"JOHN{at}EXAMPLE{dot}COM"], text


def test_reliabilities_find_the_good_labeler():
    patterns = {"31111": 80, "3000-0"[:6]: 60, "31-1-0": 40, "30-0-0": 40, "31-0-0": 5}
    post, rel = pii.reliabilities({k[:5] + "0": n for k, n in patterns.items()})
    assert post["31111" + "0"] > 0.9 and rel[0, 1, 1] > rel[0, 0, 1]


# ---- 3 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(float)
    x[10:200] = x[10]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = ann.brute_force(np.arange(1500), x, np.arange(0, 1500, 50))
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & set(w)) / len(w) for q, w in want.items()]) >= 0.9
    assert [v for v, _ in got[50]] == [10, 11, 12, 13, 14]  # ties go to smaller ids
    assert ann.search(df.where("vec_id < 0")).count() == 0
    two = ann.search(df.where("vec_id in (0, 1)")).collect()
    assert [(r.query_id, r.vec_id) for r in two] == [(0, 1)]


# ---- 4 lines


def test_repeated_passages_go_and_first_copies_stay(spark, odd, none):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    line = lambda: " ".join(rng.choice(words, 12)) + ".\n"
    passage = "".join(line() for _ in range(8))
    docs = [(i, "".join(line() for _ in range(6)) + (passage if i % 3 == 0 else "") + "".join(line() for _ in range(4)), "e") for i in range(12)]
    docs.append((100, docs[1][1], "copy"))
    got = {r.doc_id: r for r in line_chunks.dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    text = {i: t for i, t, _ in docs}
    for i in range(12):
        if i % 3 == 0 and i:
            assert got[i].text == text[i].replace(passage, "")
        else:
            assert got[i].text == text[i]
    assert got[100].text == "" and got[100].extra == "copy"
    left = line_chunks.dedup_lines(odd).collect()
    assert sorted(str(r.text) for r in left) == sorted(str(t) for _, t, _ in ODD)
    assert line_chunks.dedup_lines(none).count() == 0


def test_every_repeated_passage_of_over_fifty_words_goes(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(9000)]
    line = lambda n: " ".join(rng.choice(words, n)) + "\n"
    docs, wants = [], {}
    for k in range(140):
        n = 1 + k % 7
        sizes = [51 // n + 1 + int(rng.integers(0, 4)) for _ in range(n)]
        # short and wrapped lines, blank lines between some
        passage = ("\n" if k % 2 and n > 1 else "").join(line(s) if k % 3 else line(s).replace(" w1", ". w1") for s in sizes)
        for copy in range(2):
            head, tail = ("".join(line(int(rng.integers(3, 15))) for _ in range(rng.integers(0, 5))) for _ in range(2))
            docs.append((2 * k + copy, head + passage + tail, None))
            wants[2 * k + copy] = head + tail if copy else head + passage + tail
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert [i for i in wants if got[i] != wants[i]] == []
    # equal lines throughout: the first window stays whole
    same = "one line of ten words that comes again and again\n"
    left = line_chunks.dedup_lines(spark.createDataFrame([(1, same * 400, None), (2, "lead\n" + same * 9, None)], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in left} == {1: same * 3, 2: "lead\n"}


# ---- 5 toxicity


def test_deobfuscation_and_held_out_scores(spark, none):
    rng = np.random.default_rng(2)
    clean = [f"{a}{b}" for a in ("ran", "tor", "bel", "mis", "lan") for b in ("der", "ing", "ton", "ela", "ost", "ive")]
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(clean, 30))
        bad = i % 5 == 0
        if bad:
            words[3], words[9] = "grumbler", "nastiest"
        docs.append((i, " ".join(words), None))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    out = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in out)
    for text in ("you grumbl3r", "so g r u m b l e r", "nastiessssst of all", "n@stie5t"):
        assert model.scores([text], {})[0] > model.scores(["rander"], {})[0], text
    odd = toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(none, toxicity.train(none, lab)).count() == 0
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == 720


def test_obfuscated_words_are_read_wherever_the_stand_ins_are():
    words = "worthless useless asshole lame stupid nasty bad scum you are a so the of grumbler".split()
    counts = {}
    for w in words:
        for a, b in zip("^" + w, w + "$", strict=True):
            counts[a + b] = counts.get(a + b, 0) + 50
    model = toxicity.CharModel(counts)
    for text, word in (
        ("w0rthl3$$", "worthless"), ("us3l3s5", "useless"), ("4$$h0l3", "asshole"), ("l4m3", "lame"), ("stup1d!", "stupid"), ("so b a d", "bad"), ("$ c u m", "scum"),
        ("x " + " ".join("worthless" * 6), "worthless"), ("n@sty", "nasty"), ("you are lame!", "lame"), ("s t u p 1 d !", "stupid"),
    ):
        assert word in toxicity.restored(text, model, {}), text
    assert list(toxicity.mixed("n4st1")) == ["n4st1"] and toxicity.restored("n4st1", model, {}) & {"nasti", "nastl"}
    # a word across what was a cut after 40 characters, in a run of several words
    for before in ("useless" * 5, "useless" * 4 + "youare", "so" + "useless" * 5, "you" + "useless" * 5, "useless" * 5 + "a"):
        run = " ".join(before + "grumbler")
        found = toxicity.features(toxicity.restored(run, model, {}))
        assert "grumbler" in found or "grum*" in found, before


def test_language_model_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 20)
    docs = [(i, "plain text here" if i < 60 else "qzqz xvxv", None) for i in range(120)]
    model = toxicity.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int"))
    # rows 60 on have no label, and most labelled rows are past the bound
    assert {"qz", "xv", "z$"} <= set(model.chars.pair)
    assert model.chars.pair == toxicity.char_model(spark.createDataFrame(docs, SCHEMA)).pair


# ---- 6 media


def test_media_round_trip(spark, odd, none):
    rows = media.chunked_media(odd).collect()
    assert len(rows) == len(ODD)
    for r, t in ((r, t) for r in rows for i, t, _ in ODD if i == r.doc_id):
        p = media.payload(t)
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p)) and r.payload_bytes % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_sha256 == hashlib.sha256(media.to_wave(p)).hexdigest() and r.media_bytes == len(media.to_wave(p))
    assert media.chunked_media(none).count() == 0


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    data = rng.bytes(200_000)
    a, b = set(media.chunks(data)), set(media.chunks(b"xyz" + data))
    assert b"".join(media.chunks(data)) == data
    assert len(a & b) > 0.8 * len(a)


# ---- 7 secrets


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets(spark, odd, none):
    rng = np.random.default_rng(7)
    bits = ["token", "=", "Secret", ":", " ", '"', "AKIA", "ABCD1234EFGH5678", "abcdef0123456789abcdef01", "pass", "word", "é", "api_key", "xyz123", "\n"]
    texts = ["".join(rng.choice(bits, 60)) for _ in range(120)] + ["token:token:abcdef"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    for r in secret_scan.scan_secrets(df).collect():
        assert [tuple(s) for s in r.secret_spans if s.kind < 3] == brute_secrets(r.text)
    key = "zX9kQ27vLp0Rt5YbW1mN8cJ4"
    text = f"see getUserAccountIndexCount2 and {key} here"
    r = secret_scan.scan_secrets(spark.createDataFrame([(1, text, None)], SCHEMA)).first()
    assert [tuple(s) for s in r.secret_spans] == [(text.index(key), 3, text.index(key) + len(key))]
    red = secret_scan.scan_secrets(spark.createDataFrame([(1, 'a token = "abcdef0123456789abcdef0123" b', None)], SCHEMA)).select(secret_scan.redact(F.col("text"), F.col("secret_spans")).alias("t")).first()
    assert red.t == 'a [SECRET]" b'
    got = secret_scan.scan_secrets(odd)
    assert got.count() == len(ODD) and "extra" in got.columns and secret_scan.scan_secrets(none).count() == 0


# ---- 8 packing


def test_packing_covers_every_id_once(spark, odd, none):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    more = [(100 + i, " ".join(rng.choice(["alpha", "Beta's", "γ", "x1y", "über"], int(n))), None) for i, n in enumerate(rng.integers(1, 4000, 40))]
    rows = [x for x in ODD if x[0] != 3] + more
    tk = Tokenizer.from_file(WORDS)
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), WORDS).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[i][at : at + r.length], dtype="<u4")
            assert r.start == at and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none, WORDS).count() == 0
    assert packing.pack(odd, WORDS).select("doc_id").distinct().count() == 6


def test_cuts_waste_little():
    for n in range(1, 9000, 7):
        parts = packing.cut(n)
        assert sum(parts) == n and max(parts) <= 2048


# ---- 9 n-gram join


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = sorted((find(a), find(b)))
            root[s] = r
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_equals_brute_force(spark, none):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(300)]
    hot = list(rng.choice(vocab, 60))
    rows = []
    for i in range(120):
        words = list(rng.choice(vocab, int(rng.integers(1, 120)))) if i % 3 else hot + list(rng.choice(vocab, int(rng.integers(0, 25))))
        rows.append((len(rows), " ".join(words), None))
        for _ in range(int(rng.integers(0, 4))):
            near = list(words)
            for _ in range(int(rng.integers(0, 3))):
                near[int(rng.integers(0, len(near)))] = str(rng.choice(vocab))
            rows.append((len(rows), "  ".join(near).upper(), None))
    rows += [(9000, None, None), (9001, "", None), (9002, " \n\t ", None), (9003, "One two", None), (9004, "one  TWO", None), (9005, "É a", None), (9006, "é a", None), (9007, "x " * 30_000, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute_classes(rows)
    assert ngram_join.near_duplicates(none).count() == 0


# ---- 10 sharding


def best_capacity(sizes, k):
    def shards(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= k)


def test_sharding_is_minimax(spark, odd, none):
    rng = np.random.default_rng(8)
    rows = [(i, "t" * int(rng.integers(0, 60)) + str(i if i % 3 else 7), None) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), n_shards=7).collect()
    assert len(got) == 400
    groups, load, slots = {}, {}, {}
    for r in got:
        t = rows[r.doc_id][1]
        assert r["size"] == len(t) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        groups.setdefault(r.digest, [0, set()])
        groups[r.digest][0] += r["size"]
        groups[r.digest][1].add(r.shard)
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for _, s in groups.values())
    order = [groups[d][0] for d in sorted(groups)]
    assert max(load.values()) == best_capacity(order, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd).count() == len(ODD) and sharding.shard_documents(none).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline as p

    got = p.run(spark, "/root/testdata/sf0.001")
    assert got.columns == list(packing.COLUMNS) and got.count() > 0

"""What the span models decide on texts that are like a corpus: true cases are rare, and none comes from the models' own lists."""

import os
import random

import numpy as np
import pytest

from lakepress.llm import ann, pii, secret_scan

SF = "/root/testdata/sf0.01"
PROBES = [
    ("call 212-555-0199 today", "212-555-0199"), ("reach 212-555-0199", "212-555-0199"), ("my name is Olena Kovalenko", "Olena Kovalenko"), ("Dr. Olena Kovalenko spoke", "Dr. Olena Kovalenko"),
    ("pay with 4111.1111.1111.1111 now", "4111.1111.1111.1111"), ("write to priya.nair (at) lumen (dot) org", "priya.nair (at) lumen (dot) org"), ("contact priya at lumen dot org", "priya at lumen dot org"),
    ("server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("serial 1234.5678.9012.3456", None), ("invoice 4111.1111.1111.1112", None), ("we met at noon dot com was young", None), ("order 212-555-0199 shipped", None), ("part 1111-222", None),
    ("version 300.1.2.3 of it", None), ("see page 4111 1111 1111 1112", None), ("an empty line", None), ("the number 1234567890123456 is long", None),
]
ORDINARY = (
    "python3-setuptools-scm x86_64-unknown-linux-gnu ISBN-978-3-16-148410-0 linux-image-5-15-0-91-generic 2024-01-15T10-30-00Z-backup utf8mb4_unicode_520_ci aarch64-apple-darwin22 node_modules/react-dom "
    "getUserById2Handler SKU-48213-XL-BLUE en_US_POSIX_UTF-8 20240115-103000-report Q3-2024-revenue-summary invoice_2023_11_000482 COVID-19-vaccination-rate RFC-2616-section-14 IMG_20230814_174523 "
    "kubernetes-v1-28-4-release ubuntu-22-04-lts-server Windows-10-Pro-22H2 com/example/myapp/MainActivity sha256WithRSAEncryption ECDHE-RSA-AES128-GCM-SHA256 iso8859-15-transliteration"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_rare_personal_data_in_a_corpus(spark, docs):
    probes = spark.createDataFrame([(10**9 + i, t) for i, (t, _) in enumerate(PROBES)], "doc_id bigint, text string")
    found = {r.doc_id - 10**9: [tuple(s) for s in r.found] for r in pii.find_pii(docs.unionByName(probes)).where(f"doc_id >= {10**9}").collect()}
    for i, (text, want) in enumerate(PROBES):
        assert [text[a:b] for _, a, b in found[i]] == ([want] if want else []), text


def test_ordinary_tokens_are_no_secrets(spark, docs):
    model = secret_scan.train(docs)
    assert model.margin >= 0 and model.precision >= 0.99 and model.recall >= 0.95
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choices(alphabet, k=n)) for n in (16, 20, 24, 40) for _ in range(40)] + ["Zx9Qw7Lp2Vn4Rt8"]
    rows = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(ORDINARY + drawn)], "doc_id bigint, text string")
    hit = {r.doc_id for r in secret_scan.scan_secrets(rows, model).where("size(secret_spans) > 0").collect()}
    assert [t for i, t in enumerate(ORDINARY) if i in hit] == []
    assert len(hit) >= 0.95 * len(drawn) and len(ORDINARY) + len(drawn) - 1 in hit


def test_tokens_beside_and_within_base_spans(spark):
    key, hexed = "zX9kQ27vLp0Rt5YbW1mN8cJ4", "0123456789abcdef01234567"
    model = secret_scan.SecretModel([1.0] * secret_scan.SPAN**2, 0.0, 1.0, 1.0)
    cases = [(f"{key} {hexed} {key}", 3), (f"x{key}{hexed}", 1), (f"token={key}", 1), (f"my_{key}_password = {key}", 1), (" ".join([hexed, key] * 300), 600)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    for r in secret_scan.scan_secrets(rows, model).collect():
        spans = [tuple(s) for s in r.secret_spans]
        assert len(spans) == cases[r.doc_id][1] and spans == sorted(spans)
        base = [(a, b) for a, k, b in spans if k < 3]
        assert not any(k == 3 and a < y and x < b for a, k, b in spans for x, y in base)


@pytest.mark.parametrize("size", [1e-300, 1e-170, 1.0, 1e200, 1e307])
def test_neighbours_at_any_magnitude(spark, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    own = x * rng.uniform(0.1, 1, size=(300, 1)) * size
    rows = [(i, v.tolist()) for i, v in enumerate(own)] + [(None, own[0].tolist())]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for q in range(0, 300, 50):
        cosines = unit @ unit[q]
        assert len(got[q]) == 5 and all(abs(s - cosines[v]) < 1e-12 for v, s in got[q])
    want = ann.brute_force(np.arange(300), own, np.arange(0, 300, 50))
    assert np.mean([len({v for v, _ in got[q]} & set(w)) / 5 for q, w in want.items()]) >= 0.9

"""Media columns kept as content-defined chunks.

A payload is stored as an 8-bit PCM WAVE file. The file is cut where a rolling
gear hash of its last 32 bytes falls into a residue, so equal stretches of
different files end up in equal chunks. Chunks are deduplicated corpus-wide by
digest, each media value is the ordered list of its chunk digests, and a Spark
join of those lists with the chunk table rebuilds the file, which is verified
against its digest before anything is read from it.

Chunks travel compressed with a dictionary trained on a bounded sample: of
``DICTIONARY_ROWS`` distinct texts about, taken by a threshold on their hash,
the ``SAMPLE_CHUNKS`` chunks of the smallest digests. A media value of many
rows is rebuilt once.

Defined results for odd input: a null text is an empty text (64 zero samples);
an empty table gives no rows; equal texts give equal values, repeated rows
included; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy

BLOCK = 64
RATE = 8000
MEAN_BITS = 13
SHORTEST, LONGEST = 2048, 32768
#: texts and chunks that the compression dictionary is trained on, and its bytes
DICTIONARY_ROWS, SAMPLE_CHUNKS, DICTIONARY_BYTES = 3000, 4000, 112 * 1024
LEVEL = 19
#: bytes of a chunk digest and of a media key
DIGEST = 16


def _gear() -> np.ndarray:
    """256 odd-looking words from splitmix64."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def to_wave(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wave(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for n in (1, 2, 4, 8, 16):
        if len(h) > n:
            h[n:] += h[:-n] << np.uint32(n)
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, last, n = [], 0, len(data)
    for m in [*marks.tolist(), n]:
        while m - last > LONGEST:
            last += LONGEST
            out.append(last)
        if (m - last >= SHORTEST and n - m >= SHORTEST) or (m == n and last < n):
            out.append(m)
            last = m
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def features(samples: bytes) -> str:
    """Length in blocks, mean, root mean square around 128, zero crossings and peak, as text."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    energy = int((x * x).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(x) // BLOCK};mean={x.sum() / len(x):.6f};rms={(energy / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def _dictionary(texts: DataFrame) -> bytes:
    import zstandard

    grid, n = 1 << 20, texts.count()
    share = int(min(1.0, DICTIONARY_ROWS / max(n, 1)) * grid) + 1
    # a text's copies count once, so a hot text doesn't swell the sample
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(grid)) < share).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [c for t in f["text"] for c in chunks(to_wave(payload(t)))]
            yield pd.DataFrame({"digest": objects([digest(c) for c in found]), "chunk": objects(found)})

    sample = some.select("text").mapInPandas(run, "digest binary, chunk binary").dropDuplicates(["digest"]).orderBy("digest").limit(SAMPLE_CHUNKS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.chunk for r in sample]).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def _packer(dictionary: bytes) -> Callable[[bytes], bytes]:
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_dict_id=False).compress


def _unpacker(dictionary: bytes) -> Callable[..., bytes]:
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def media_key(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()[:DIGEST]


def chunk_table(texts: DataFrame, dictionary: bytes, remembered: int = 100_000) -> DataFrame:
    """(digest, packed): each distinct chunk once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, seen = _packer(dictionary), set()
        for f in frames:
            digests, packed = [], []
            for text in f["text"]:
                for c in chunks(to_wave(payload(text))):
                    d = digest(c)
                    if d not in seen:
                        if len(seen) < remembered:
                            seen.add(d)
                        digests.append(d)
                        packed.append(pack(c))
            yield pd.DataFrame({"digest": objects(digests), "packed": objects(packed)})

    return texts.mapInPandas(tidy(run), "digest binary, packed binary").dropDuplicates(["digest"])


def recipes(texts: DataFrame) -> DataFrame:
    """(media, stored, digests): each distinct text's key, its file's SHA-256 and its chunk digests in order, joined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for f in frames:
            keys, lists, stored = [], [], []
            for text in f["text"]:
                key = media_key(text)
                if key in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(key)
                data = to_wave(payload(text))
                keys.append(key)
                stored.append(hashlib.sha256(data).digest())
                lists.append(b"".join(map(digest, chunks(data))))
            yield pd.DataFrame({"media": objects(keys), "stored": objects(stored), "digests": objects(lists)})

    return texts.mapInPandas(tidy(run), "media binary, stored binary, digests binary").dropDuplicates(["media"])


def _rebuild(dictionary: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = _unpacker(dictionary)
        for f in frames:
            rows = []
            for media, stored, parts in zip(f["media"], f["stored"], f["parts"], strict=True):
                data = b"".join(unpack(p["packed"], max_output_size=LONGEST) for p in sorted(parts, key=lambda p: p["pos"]))
                found = hashlib.sha256(data).digest()
                if found != bytes(stored):
                    raise ValueError(f"media {bytes(media).hex()} was not rebuilt from its chunks")
                samples = from_wave(data)
                rows.append((media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), found.hex(), features(samples), len(parts)))
            names = ("media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
            out = pd.DataFrame({n: objects([r[i] for r in rows]) for i, n in enumerate(names)})
            yield out.astype({n: "int64" for n in ("payload_bytes", "tail_crc32", "media_bytes", "n_chunks")})

    return run


REBUILT = "media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks bigint"


def chunked_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, rebuilds it from the chunk table and returns what was read back."""
    texts = bounded(docs).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = _dictionary(texts)
    at = F.sequence(F.lit(0), (F.octet_length("digests") / DIGEST).cast("int") - 1)
    parts = F.transform(at, lambda i: F.substr(F.col("digests"), i * DIGEST + 1, F.lit(DIGEST)))
    lists = recipes(texts).select("media", "stored", F.posexplode(parts).alias("pos", "digest"))
    # the file's digest goes with its first chunk alone
    lists = lists.withColumn("stored", F.when(F.col("pos") == 0, F.col("stored")))
    parts = lists.join(chunk_table(texts, dictionary), "digest")
    whole = parts.groupBy("media").agg(F.first("stored", True).alias("stored"), F.collect_list(F.struct("pos", "packed")).alias("parts"))
    rebuilt = whole.mapInPandas(tidy(_rebuild(dictionary)), REBUILT)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.substr(F.unhex(F.sha2(body.cast("binary"), 256)), F.lit(1), F.lit(DIGEST)).alias("media"),
    )
    return rows.join(rebuilt, "media").drop("media")

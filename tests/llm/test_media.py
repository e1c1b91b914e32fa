import hashlib
import math
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bucketwise.llm import media as m


def check(rows, facts):
    got = sorted(((r.media_key, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in facts), key=str)
    want = []
    for key, text in rows:
        data = (text or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want.append((key, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want, key=str)


def stored(text):
    """(media_bytes, media_sha256, feature), byte by byte."""
    data = m.payload(text)
    ends, last, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(m.GEAR[byte])) % 2**32  # what is older than 32 bytes has been shifted out
        if i + 1 - last == 16384 or (i + 1 - last >= 1024 and h >> 20 == 0):
            last = i + 1
            ends.append(last)
    if last < len(data):
        ends.append(len(data))
    chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
    frames = [zstandard.ZstdCompressor(level=3).compress(c) for c in chunks]
    head = b"CDM1" + len(chunks).to_bytes(4, "little")
    for c, f in zip(chunks, frames):
        head += len(c).to_bytes(4, "little") + len(f).to_bytes(4, "little") + hashlib.blake2b(c, digest_size=16).digest()
    form = head + b"".join(frames)
    mean = sum(data) / len(data)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in data) / len(data))
    crossings = sum((x >= 128) != (y >= 128) for x, y in zip(data, data[1:]))
    shares = [sum(k * 32 <= x < k * 32 + 32 for x in data) / len(data) for k in range(8)]
    feature = ",".join([f"{mean:.4f}", f"{deviation:.4f}", str(crossings), *(f"{s:.4f}" for s in shares)])
    return len(form), hashlib.sha256(form).hexdigest(), feature


def test_stored_form_and_features(spark, tables):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/odd/documents.parquet").collect()}
    for r in m.op6_media_columns(spark, f"{tables}/odd").collect():
        assert (r.media_bytes, r.media_sha256, r.feature) == stored(rows[r.doc_id])


def test_odd_rows(spark, odd, empty):
    store = m.write_media(odd)
    facts = m.media_facts(store).collect()
    check([(r.doc_id, r.text) for r in odd.collect()], facts)
    assert store.chunks.count() > 0 and store.recipes.where("n_missing > 0").count() > 1
    assert store.chunks.select("digest").distinct().count() == store.chunks.count()
    by_payload = {}
    for r in facts:
        assert by_payload.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert m.media_facts(m.write_media(empty)).count() == 0


def test_a_filter_that_passes_all(spark, odd, monkeypatch):
    # the words of the filter are broadcast, so the workers' filters pass all keys too
    full = lambda keys: m.BlockedBloom(np.full(512 * 8, 2**64 - 1, np.uint64))
    monkeypatch.setattr(m.BlockedBloom, "build", full)
    store = m.write_media(odd)
    assert store.recipes.where("n_missing < size(lengths)").count() == 0
    check([(r.doc_id, r.text) for r in odd.collect()], m.media_facts(store).collect())


def test_damage_is_noticed(spark, odd):
    store = m.write_media(odd)
    broken = m.MediaStore(store.recipes, store.chunks.where("false"))
    with pytest.raises(Exception, match="is missing"):
        m.media_facts(broken).collect()
    parts = [b"a" * 2000]
    frame = zstandard.ZstdCompressor().compress(b"b" * 2000)
    with pytest.raises(ValueError, match="damaged"):
        m.rebuild(m.digest(parts[0]), [2000], [frame])
    with pytest.raises(ValueError, match="missing"):
        m.rebuild(m.digest(parts[0]), [2000], [None])


@given(st.lists(st.binary(max_size=60_000), max_size=4))
@settings(deadline=None, max_examples=25)
def test_cuts(blobs):
    blobs = [b for b in blobs if b]
    for b, ends in zip(blobs, m.cut(blobs) if blobs else []):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(b) and (sizes <= m.MOST).all() and (sizes[:-1] >= m.LEAST).all()
        assert ends == m.cut([b])[0]


def test_cuts_follow_contents():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    chunks = lambda b: set(m._chunks(b, m.cut([b])[0]))
    assert len(chunks(data) & chunks(b"inserted" + data)) > 0.9 * len(chunks(data))


def test_gear_hash_is_the_plain_sum():
    data = np.random.default_rng(2).integers(0, 256, 100, dtype=np.uint8)
    want = [sum(int(m.GEAR[data[i - j]]) << j for j in range(min(i + 1, 32))) % 2**32 for i in range(100)]
    assert m.gear_hash(data).tolist() == want


def test_same_files_after_a_second_open(spark, odd, tmp_path):
    path = f"file://{tmp_path}/media"
    a = m.media_facts(m.write_media(odd, path=path)).orderBy("media_key", "payload_sha256")
    b = m.media_facts(m.open_media(spark, path)).orderBy("media_key", "payload_sha256")
    assert a.select(*map(F.col, a.columns)).collect() == b.collect()

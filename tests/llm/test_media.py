import hashlib
import io
import wave
import zlib

from cases import SMALL, empty, given, odd, odd_rows, pairs

from apexline.llm import media
from apexline.llm.queries import QUERIES


def padded(text):
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def wav(payload):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
        f.writeframes(payload)
    return out.getvalue()


def test_round_trip_of_the_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op4_media"](spark, SMALL).collect()}
    rows = pairs(given("documents", columns="doc_id, text"))
    assert len(got) == len(rows)
    features = {}
    for doc, text in rows:
        payload, r = padded(text), got[doc]
        stored = wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(text.encode()), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert features.setdefault(text, r.feature) == r.feature
    # Texts of some length differ in their features.
    assert len(set(features.values())) > 0.9 * len(features)


def test_odd_rows(spark):
    got = media.fingerprints(media.to_media(odd(spark))).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert len(r.payload) % 64 == 0 and media.samples_of(bytes(r.media)) == bytes(r.payload)
        assert len(r.times) == len(r.codes) and r.times == sorted(r.times)
    assert media.fingerprints(media.to_media(empty(spark))).count() == 0


def test_fingerprints_follow_a_shifted_passage():
    import numpy as np

    draw = np.random.default_rng(3)
    tone = lambda n: draw.integers(0, 256, n, dtype=np.uint8).tobytes()
    passage = tone(4096)
    a = media.peak_pairs(passage + tone(640))
    b = media.peak_pairs(tone(64 * 20) + passage)
    here, there = set(zip(a[0].tolist(), a[1].tolist())), set(zip((b[0] - 20).tolist(), b[1].tolist()))
    assert len(here & there) > 0.8 * (4096 // media.HOP)

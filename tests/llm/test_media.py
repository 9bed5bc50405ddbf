import hashlib
import zlib

import numpy as np

from lapsight.llm import media as m


def test_round_trip(docs, rows, empty):
    out = m.media_column(docs, keep=("doc_id", "text")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = m.payload((r["text"] or "").encode())
        assert len(want) % 192 == 0 and len(want) > 0
        assert m.from_wav(bytes(r["media"])) == want and r["payload_bytes"] == len(want)
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-16:])
        assert len(r["frame"]) == len(r["code"]) and all(0 <= t < r["n_frames"] for t in r["frame"])
    by_text = {}
    for r in out:
        by_text.setdefault(r["text"] or "", set()).add((tuple(r["frame"]), tuple(r["code"]), bytes(r["media"])))
    assert all(len(x) == 1 for x in by_text.values())
    assert m.media_column(empty).count() == 0


def test_peaks_of_a_tone():
    t = np.arange(m.FRAME * 40)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / m.FRAME) * (1 + 0.5 * np.sin(2 * np.pi * t / 4000))).astype(np.uint8).tobytes()
    frame, bin_, _ = m.spectral_peaks(tone)
    assert len(frame) and set(bin_[np.isin(bin_, range(10, 24))]) <= {19, 20, 21}


def test_chunks_do_not_matter(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    whole = m.fingerprint(data)
    monkeypatch.setattr(m, "CHUNK", 17)
    parts = m.fingerprint(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_far_pairs_keep_their_distance():
    """Two tones with more than 32767 silent frames between them."""
    t = np.arange(m.FRAME * 8)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / m.FRAME) * np.hanning(len(t))).astype(np.uint8).tobytes()
    still = lambda n: bytes([128]) * n
    gaps = []
    for n in (40_000, 50_000):
        frame, code, _ = m.fingerprint(tone + still(m.HOP * n) + tone)
        gaps.append(int((code & 0xFFFFFFFF).max()))
        assert ((code >> 40) < 256).all()
    assert gaps[1] - gaps[0] > 9_000 and gaps[0] > 39_000


def test_feature_equals_brute_force():
    """Every pair of a peak with its next three, one by one."""
    data = np.random.default_rng(2).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    frame, bin_, n = m.spectral_peaks(data)
    want = sorted((int(frame[i]), (int(bin_[i]) << 40) | (int(bin_[j]) << 32) | int(frame[j] - frame[i])) for i in range(len(frame)) for j in range(i + 1, min(i + 4, len(frame))))
    t, c, k = m.fingerprint(data)
    assert k == n and list(zip(t.tolist(), c.tolist(), strict=True)) == want

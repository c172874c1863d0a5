from __future__ import annotations

import wave
from io import BytesIO

import numpy as np
import pytest

from quillspan.llm import telephony as T


def test_tables_have_known_values():
    assert T.EXPAND[T.MULAW][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert T.EXPAND[T.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in T.EXPAND.values():
        assert (np.sort(table[:128]) == np.sort(-table[128:].astype(int))).all()


@pytest.mark.parametrize("codec", [None, T.MULAW, T.ALAW, T.ADPCM])
def test_payload_comes_back(make, tidy, codec):
    stored = T.store(make(tidy), codec)
    rows = T.decode(stored, outputs=("codec", "payload", "pcm", "feature")).collect()
    texts = sorted((r[1] or "").encode() for r in tidy)
    got = sorted(bytes(r["payload"]) for r in rows)
    assert got == sorted(t + b" " * (-len(t) % 192 if t else 192) for t in texts)
    by_media = {}
    for r in rows:
        assert by_media.setdefault(bytes(r["media"]), (r["feature"], r["codec"])) == (r["feature"], r["codec"])
        assert len(r["pcm"]) % 2 == 0 and r["feature"].startswith(f"n={len(r['pcm']) // 2};")
    assert T.decode(T.store(make([]))).count() == 0


def brute_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + int(T.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (5, 60)).astype(np.uint8)
    assert T.decode_adpcm(blocks).tolist() == [brute_adpcm(bytes(b)) for b in blocks]


def test_adpcm_keeps_a_tone():
    tone = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = T.decode_adpcm(T.encode_adpcm(tone)).ravel()[:len(tone)]
    assert np.abs(back[200:].astype(int) - tone[200:]).mean() < 200


def test_pcm_wav_and_broken_media(spark):
    buffer = BytesIO()
    with wave.open(buffer, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(8000)
        file.writeframes(np.array([0, 100, 200], "<i2").tobytes())
    rows = [(1, bytearray(buffer.getvalue())), (2, None), (3, bytearray(b"RIFF")), (4, bytearray(b"x" * 50))]
    frame = spark.createDataFrame(rows, "k int, media binary")
    got = {r["k"]: r for r in T.decode(frame).collect()}
    assert np.frombuffer(bytes(got[1]["pcm"]), "<i2").tolist() == [0, 50, 100, 150, 200, 200] and got[1]["codec"] == "pcm"
    assert all(got[k]["pcm"] is None and got[k]["feature"] is None for k in (2, 3, 4))


def test_resampling_both_ways():
    assert T.resample(np.array([0, 10, 20, 30], np.int16), 16000, 8000).tolist() == [0, 20]
    assert T.resample(np.empty(0, np.int16), 8000, 16000).tolist() == []

"""Telephony audio columns: mu-law, A-law and ADPCM in WAV, expanded and resampled to PCM."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.common import id_and_text, small, utf8

# Format tags of WAV, the step sizes and the index moves of IMA ADPCM.
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
RATE, TARGET_RATE = 8000, 16000
#: A payload is padded with blanks to a positive multiple of this; also the data bytes of an ADPCM block.
UNIT = 192
BLOCK = UNIT + 4
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm", PCM: "pcm"}


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: complement; sign, three bits of exponent, four of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted; the sign bit means positive."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """(difference, next step index) by step index * 16 + code."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), index.astype(np.int32).ravel()


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}
DIFFERENCE, NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (block x sample, int16) of ADPCM blocks (block x byte), all blocks one step at a time.

    A block holds its first sample (16 bits), its first step index and a spare byte, then two codes a byte, low one first.
    """
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        at = (index << 4) + code
        value = np.clip(value + DIFFERENCE[at], -32768, 32767)
        index = NEXT[at]
        out[k + 1] = value
    return out.T


def encode_adpcm(samples: np.ndarray, data_bytes: int = UNIT) -> np.ndarray:
    """ADPCM blocks of PCM samples (the last block is filled with its last value); blocks side by side, nearest codes."""
    per_block = 2 * data_bytes + 1
    n = max(1, -(-len(samples) // per_block))
    grid = np.resize(samples[-1:] if len(samples) else np.zeros(1, np.int16), n * per_block).astype(np.int32)
    grid[:len(samples)] = samples
    grid = grid.reshape(n, per_block)
    blocks = np.zeros((n, data_bytes + 4), dtype=np.uint8)
    blocks[:, :2] = grid[:, :1].astype("<i2").view(np.uint8)
    value, index = grid[:, 0].copy(), np.zeros(n, dtype=np.int32)
    for k in range(1, per_block):
        reached = np.clip(value[:, None] + DIFFERENCE[(index[:, None] << 4) + np.arange(16)], -32768, 32767)
        code = np.abs(reached - grid[:, k:k + 1]).argmin(axis=1)
        value, index = reached[np.arange(n), code], NEXT[(index << 4) + code]
        blocks[:, 4 + (k - 1) // 2] |= (code << 4 * ((k - 1) % 2)).astype(np.uint8)
    return blocks


def wav(codec: int, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of coded ``data``."""
    align, bits = (BLOCK, 4) if codec == ADPCM else (2, 16) if codec == PCM else (1, 8)
    per_block = 2 * (BLOCK - 4) + 1 if codec == ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * align // per_block, align, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(data) // align * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block size, data) of a WAV file; raises ValueError on anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8:at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("WAV file without format or data")
    return form[0], form[2], form[4], data


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == target or not len(samples):
        return samples
    place = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    left, part = place // target, (place % target).astype(np.int32)
    right = np.minimum(left + 1, len(samples) - 1)
    a, b = samples[left].astype(np.int32), samples[right].astype(np.int32)
    return (a + (b - a) * (part / target)).round().astype(np.int16)


def payload_of(text: bytes) -> bytes:
    """Text bytes, padded with blanks to a positive multiple of ``UNIT``."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def store(docs: DataFrame, codec: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text as the coded samples of a WAV file, without loss.

    A byte is one mu-law or A-law sample, or two ADPCM codes; a checksum of the payload picks the codec unless one is
    given, so equal texts have equal media.  Null texts are empty and give one unit of blanks.  Null ids and repeated rows
    keep rows of their own; an empty table gives an empty table; columns besides the two are not read.
    """
    def pack(payload: bytes) -> bytes:
        chosen = CODECS[zlib.crc32(payload) % len(CODECS)] if codec is None else codec
        if chosen != ADPCM:
            return wav(chosen, payload)
        blocks = np.zeros((len(payload) // UNIT, BLOCK), dtype=np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        return wav(chosen, blocks.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()),
                pa.array([pack(payload_of(t)) for t in texts], pa.binary()),
            ], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def features(samples: np.ndarray) -> str:
    """Length, peak, root mean square and zero crossings of PCM samples."""
    wide = samples.astype(np.int64)
    square = int((wide * wide).sum())
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    rms = round((square / max(1, len(samples))) ** 0.5, 3)
    return f"n={len(samples)};peak={int(np.abs(wide).max(initial=0))};rms={rms};crossings={crossings}"


def decode(
    media: DataFrame, target: int = TARGET_RATE, media_col: str = "media", outputs: tuple[str, ...] = ("codec", "pcm", "feature")
) -> DataFrame:
    """``media`` with ``outputs`` appended: codec (name), payload (coded bytes without block heads), pcm (16-bit samples at
    ``target`` Hz, little-endian), feature (of the pcm).

    All ADPCM blocks of a batch of rows are decoded together.  Null or broken media give nulls.  Columns of ``media`` with
    the name of an output are replaced.
    """
    kinds = {"codec": "string", "payload": "binary", "pcm": "binary", "feature": "string"}
    kept = [f for f in media.schema.fields if f.name not in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows: list[dict | None] = []
            grouped: dict[int, list[int]] = {}
            for k, raw in enumerate(batch.column(media_col).to_pylist()):
                try:
                    codec, rate, align, data = parse_wav(raw or b"")
                    if codec not in NAMES or codec == ADPCM and (align < 5 or len(data) % align) or codec == PCM and len(data) % 2:
                        raise ValueError("unknown coding")
                except (ValueError, struct.error):
                    rows.append(None)
                    continue
                rows.append({"codec": codec, "rate": rate, "payload": data})
                if codec == ADPCM:
                    grouped.setdefault(align, []).append(k)
                else:
                    coded = np.frombuffer(data, np.uint8 if codec != PCM else "<i2")
                    rows[k]["samples"] = EXPAND[codec][coded] if codec != PCM else coded
            for align, members in grouped.items():
                blocks = np.frombuffer(b"".join(rows[k]["payload"] for k in members), np.uint8).reshape(-1, align)
                samples, at = decode_adpcm(blocks), 0
                for k in members:
                    n = len(rows[k]["payload"]) // align
                    rows[k]["samples"] = samples[at:at + n].ravel()
                    rows[k]["payload"] = blocks[at:at + n, 4:].tobytes()
                    at += n
            for row in filter(None, rows):
                pcm = resample(row.pop("samples"), row["rate"], target)
                row |= {"codec": NAMES[row["codec"]], "feature": features(pcm), "pcm": pcm.astype("<i2").tobytes() if "pcm" in outputs else None}
            made = [
                pa.array([r and r[name] for r in rows], pa.binary() if kinds[name] == "binary" else pa.string()) for name in outputs
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], [*(f.name for f in kept), *outputs])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{o} {kinds[o]}" for o in outputs)])
    return media.mapInArrow(run, schema)

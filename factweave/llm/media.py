"""Telephony audio in media columns.

WAVE files with mu-law, A-law or IMA ADPCM samples are decoded to 16-bit PCM, resampled and stored as
PCM WAVE files. The companding laws are lookup tables made from their rules; ADPCM is decoded with
numpy across the blocks of a file, one step for each sample of a block.

Defined results: a null text is an empty one; an empty file decodes to no samples; an unknown or cut
file, or one of a rate beyond MOST_RATE, has a null result and its error in the `error` column; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_batches, tidy

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, STORED_RATE, UNIT = 8_000, 16_000, 64
#: The highest rate of a file, and the samples resampled at once.
MOST_RATE, SEGMENT = 192_000, 1 << 18
#: Bytes of the texts or files handled at once.
BYTES = 4 << 20

# Fixed values of the IMA ADPCM format.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
    1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: inverted bits of sign, three of exponent, four of mantissa."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: every other bit inverted."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks of `block` bytes; the last may be shorter."""
    whole = len(data) // block
    parts = [np.frombuffer(data[: whole * block], np.uint8).reshape(whole, block)] if whole else []
    if (rest := data[whole * block :]) and len(rest) >= 4:
        parts.append(np.frombuffer(rest, np.uint8).reshape(1, -1))
    return np.concatenate([decode_blocks(p).ravel() for p in parts]) if parts else np.empty(0, np.int16)


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    steps, moves = np.array(STEPS, np.int32), np.array(MOVES, np.int32)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1).astype(np.int32)
    out = np.empty((len(blocks), 1 + nibbles.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], steps[index]
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def kernel(up: int, down: int, reach: int = 8) -> np.ndarray:
    """A windowed-sinc low pass at the lower of the two rates."""
    cut = max(up, down)
    x = np.arange(-reach * cut, reach * cut + 1)
    return up / cut * np.sinc(x / cut) * (0.54 + 0.46 * np.cos(np.pi * x / (reach * cut)))


def resample(pcm: np.ndarray, rate: int, to: int, segment: int = SEGMENT) -> np.ndarray:
    """pcm at another rate, by a polyphase filter of which only the phases that are kept are computed,
    a segment of the input at a time."""
    if rate == to or not len(pcm):
        return pcm
    if not (0 < rate <= MOST_RATE and 0 < to <= MOST_RATE):
        raise ValueError(f"a rate of {rate} or {to}")
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    taps = kernel(up, down)
    middle = len(taps) // 2
    reach = middle // up + 1
    out = []
    for a in range(0, len(pcm), segment):
        b = min(a + segment, len(pcm))
        low, high = max(0, a - 2 * reach), min(len(pcm), b + 2 * reach)
        x = np.pad(pcm[low:high].astype(np.float64), (2 * reach - (a - low), 2 * reach - (high - b)))  # x[0] is input a - 2 reach
        j0, j1 = -(-a * up // down), -(-b * up // down)  # outputs whose place lies in the segment
        y = np.empty(j1 - j0)
        for r in range(min(up, j1 - j0)):
            q, p = divmod((j0 + r) * down, up)
            own = taps[(p + middle) % up :: up]
            at = q + (p + middle) // up - a + 2 * reach - len(own) + 1  # the first sample that output meets
            n = len(y[r::up])
            if down == 1:
                y[r::up] = np.convolve(x[at : at + n + len(own) - 1], own, "valid")
            else:
                y[r::up] = np.lib.stride_tricks.sliding_window_view(x, len(own))[at : at + (n - 1) * down + 1 : down] @ own[::-1]
        out.append(np.clip(np.rint(y), -32768, 32767).astype(np.int16))
    return np.concatenate(out)


def wave(data: bytes, kind: int, rate: int, bits: int, block: int = 0, samples: int = 0) -> bytes:
    """A mono WAVE file."""
    block = block or bits // 8
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block if kind != ADPCM else rate * block // max(samples, 1), block, bits)
    fmt += b"" if kind == PCM else struct.pack("<HH", 2, samples) if kind == ADPCM else struct.pack("<H", 0)
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(data) * 8 // bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(media: bytes) -> dict[bytes, bytes]:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    found, at = {}, 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("cut short")
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not {b"fmt ", b"data"} <= {*found}:
        raise ValueError("no format or no data")
    return found


def decode(media: bytes) -> tuple[np.ndarray, int, bytes]:
    """16-bit samples, their rate, and the stored bytes of a WAVE file."""
    parts = chunks(media)
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    data = parts[b"data"]
    if channels != 1:
        raise ValueError("more than one channel")
    if kind in (MULAW, ALAW):
        return (MULAW_PCM if kind == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)], rate, data
    if kind == ADPCM and block > 4:
        return decode_adpcm(data, block), rate, data
    if kind == PCM and bits == 16:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate, data
    raise ValueError(f"format {kind} of {bits} bits")


def to_pcm(rows: DataFrame, to: int = STORED_RATE) -> DataFrame:
    """rows (id, media) as (id, media, n_samples, error): media is a 16-bit PCM WAVE file at rate to."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 256, BYTES)):
            out = []
            for media in batch.column(1).to_pylist():
                try:
                    pcm, rate, _ = decode(media or b"")
                    pcm = resample(pcm, rate, to)
                    out.append((wave(pcm.astype("<i2").tobytes(), PCM, to, 16), len(pcm), None))
                except (ValueError, struct.error) as e:
                    out.append((None, None, str(e)))
            cols = [*zip(*out, strict=True)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "media", "n_samples", "error"])
        tidy()

    small_batches(rows.sparkSession)
    return rows.select(F.col("id").cast("long"), F.col("media").cast("binary")).mapInArrow(convert, "id long, media binary, n_samples long, error string")


def feature(pcm: np.ndarray, rate: int) -> str:
    """Energy, zero crossings and peak of the samples and the checksum of their resampled PCM."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    stored = zlib.crc32(resample(pcm, rate, STORED_RATE).astype("<i2").tobytes())
    return f"energy={int((x * x).sum()) // max(1, len(x))} crossings={crossings} peak={int(np.abs(x).max(initial=0))} pcm={stored:08x}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(documents: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded to a positive multiple of unit, as the
    samples of a mu-law file."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 256, BYTES)):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            media = [wave(t + b"\0" * (-len(t) % unit if t else unit), MULAW, RATE, 8) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
        tidy()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(make, "doc_id long, n_bytes long, media binary")


def measured(stored: DataFrame, unit: int = UNIT) -> DataFrame:
    """What is read back from a media column."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, 256, BYTES)):
            out = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pcm, rate, back = decode(media)
                out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-unit:]), len(media), hashlib.sha256(media).hexdigest(), feature(pcm, rate)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        tidy()

    return stored.mapInArrow(read, FEATURES)


def text_media(documents: DataFrame, unit: int = UNIT) -> DataFrame:
    """Each text as a mu-law file of its padded bytes, written as a column of a table, and what is
    read back from that."""
    return measured(save(media_column(documents, unit), "media"), unit)

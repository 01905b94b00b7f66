"""Headers of MPEG frames and WAVE files, and samples of WAVE files."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the MPEG audio standard, layer III: kbit/s by index for version 1 and for 2 and 2.5, sampling rates of version 1.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES_1 = (44100, 48000, 32000)
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def riff_chunks(raw: bytes) -> dict[bytes, bytes]:
    """Chunks of a RIFF WAVE file by name; the first of each name, cut off where the file ends."""
    found, at = {}, 12
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        found.setdefault(name, raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def wav_format(chunks: dict[bytes, bytes]) -> tuple[int, int, int, int] | None:
    """(kind, channels, rate, bits) of a WAVE file's format chunk; None if it doesn't hold together."""
    head = chunks.get(b"fmt ", b"")
    if len(head) < 16 or b"data" not in chunks:
        return None
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
    if kind == EXTENSIBLE and len(head) >= 26:
        (kind,) = struct.unpack_from("<H", head, 24)
    return (kind, channels, rate, bits) if channels and rate and bits and bits % 8 == 0 else None


def mp3_frame(raw: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(bytes, samples, rate, bits a second) of the layer III frame at ``at``; None if there is none."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE6 != 0xE2:
        return None
    version, kbit, rate = raw[at + 1] >> 3 & 3, raw[at + 2] >> 4, raw[at + 2] >> 2 & 3
    if version == 1 or kbit in (0, 15) or rate == 3:
        return None
    first = version == 3
    hertz = RATES_1[rate] >> {3: 0, 2: 1, 0: 2}[version]
    bits, samples = (KBITS_1 if first else KBITS_2)[kbit] * 1000, 1152 if first else 576
    return samples // 8 * bits // hertz + (raw[at + 2] >> 1 & 1), samples, hertz, bits


def waveform(raw: bytes) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples from -1 to 1) of a WAVE file of integers or floats; None if it can't be read."""
    chunks = riff_chunks(raw) if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" else {}
    found = wav_format(chunks)
    if not found:
        return None
    kind, channels, rate, bits = found
    data = chunks[b"data"]
    data = data[: len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if kind == FLOAT and bits in (32, 64):
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif kind == PCM and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif kind == PCM and bits in (16, 32):
        x = np.frombuffer(data, f"<i{bits // 8}") / float(1 << (bits - 1))
    elif kind == PCM and bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / float(1 << 31)
    else:
        return None
    return rate, x.reshape(-1, channels).mean(axis=1).astype(np.float32)

"""Lengths of audio files from ranges of their bytes: headers, and where a format needs it the last page.

``probe`` takes a reader ``at(offset, n) -> bytes`` and the file's size and reads at most some 200 KB of any file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from tilth.functions.audio import mp3_frame, wav_format

Reader = Callable[[int, int], bytes]
#: Bytes of frames that are walked, and of an Ogg file's end, whose last page has at most 65,307.
WALKED, TAIL = 1 << 16, 1 << 16
#: Chunks, boxes and metadata blocks that are skipped before a header counts as broken.
HOPS = 256
# Fixed values of the AAC standard: sampling rates by index; samples of a frame.
AAC_RATES, AAC_FRAME = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350), 1024

Found = tuple[bool, float | None, int | None]
BROKEN: Found = (True, None, None)


def _rated(seconds: float | None, size: int) -> Found:
    return (True, seconds, round(size * 8 / seconds) if seconds else 0) if seconds is not None else BROKEN


def wav(at: Reader, size: int) -> Found:
    chunks, spot = {}, 12
    for _ in range(HOPS):
        head = at(spot, 8)
        if len(head) < 8:
            break
        name, n = struct.unpack("<4sI", head)
        if name == b"fmt " and name not in chunks:
            chunks[name] = at(spot + 8, min(n, 40))
        elif name == b"data" and name not in chunks:
            chunks[name] = b""
            data = max(0, min(n, size - spot - 8))
        if len(chunks) == 2:
            break
        spot += 8 + n + n % 2
    found = wav_format(chunks)
    if not found:
        return BROKEN
    _, channels, rate, bits = found
    return True, data / (channels * rate * bits // 8), channels * rate * bits


def _walk(raw: bytes, frame, base: int) -> tuple[float, int, bool]:
    """(seconds, bytes, whether all of ``raw`` is frames) from ``base`` on; ``frame(raw, at)`` -> (bytes, seconds) or None."""
    seconds, at = 0.0, base
    while at < len(raw) and (f := frame(raw, at)):
        seconds, at = seconds + f[1], at + f[0]
    return seconds, at - base, at >= len(raw)


def _framed(at: Reader, size: int, start: int, frame) -> Found:
    """By walking the first frames and as many more as the rest of the file has room for at their mean size."""
    end = size - 128 if size - start > 128 and at(size - 128, 3) == b"TAG" else size
    raw = at(start, min(WALKED, end - start))
    first = next((i for i in range(len(raw)) if (f := frame(raw, i)) and (i + f[0] >= len(raw) or frame(raw, i + f[0]))), None)
    if first is None:
        return BROKEN
    seconds, used, _ = _walk(raw, frame, first)
    whole = start + len(raw) >= end
    return _rated(seconds if whole else seconds * (end - start - first) / used, used if whole else end - start - first)


def mp3(at: Reader, size: int) -> Found:
    start, head = 0, at(0, 10)
    if head[:3] == b"ID3" and len(head) == 10:
        start = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(head[6:10]))

    def frame(raw, i):
        f = mp3_frame(raw, i)
        return (f[0], f[1] / f[2]) if f else None

    raw = at(start, 4096)
    first = next((i for i in range(max(0, len(raw) - 4)) if (f := mp3_frame(raw, i)) and (i + f[0] >= len(raw) or mp3_frame(raw, i + f[0]))), None)
    if first is not None:
        n, samples, rate, _ = mp3_frame(raw, first)
        body = raw[first : first + n]
        for mark, place in ((b"Xing", 8), (b"Info", 8), (b"VBRI", 14)):
            spot = body.find(mark, 4, 64)
            if spot >= 0 and (mark == b"VBRI" or body[spot + 7] & 1) and len(body) >= spot + place + 4:
                (frames,) = struct.unpack_from(">I", body, spot + place)
                if frames:
                    return _rated(frames * samples / rate, size - start - first)
    return _framed(at, size, start, frame)


def adts(at: Reader, size: int) -> Found:
    def frame(raw, i):
        if i + 7 > len(raw) or raw[i] != 0xFF or raw[i + 1] & 0xF6 != 0xF0:
            return None
        rate, n = raw[i + 2] >> 2 & 15, (raw[i + 3] & 3) << 11 | raw[i + 4] << 3 | raw[i + 5] >> 5
        return (n, AAC_FRAME * (1 + (raw[i + 6] & 3)) / AAC_RATES[rate]) if rate < len(AAC_RATES) and n >= 7 else None

    return _framed(at, size, 0, frame)


def flac(at: Reader, size: int) -> Found:
    """A stream that doesn't say how long it is has length 0."""
    head = at(4, 38)
    if len(head) < 38 or head[0] & 0x7F or int.from_bytes(head[1:4], "big") < 34:
        return BROKEN
    packed = int.from_bytes(head[4 + 10 : 4 + 18], "big")
    rate, samples = packed >> 44, packed & (1 << 36) - 1
    return _rated(samples / rate, size) if rate else BROKEN


def ogg(at: Reader, size: int) -> Found:
    head = at(0, 27 + 255 + 64)
    if len(head) < 28:
        return BROKEN
    serial, packet = head[14:18], head[27 + head[26] :]
    skip = 0
    if packet[:7] == b"\x01vorbis" and len(packet) >= 16:
        (rate,) = struct.unpack_from("<I", packet, 12)
    elif packet[:8] == b"OpusHead" and len(packet) >= 12:
        rate, (skip,) = 48_000, struct.unpack_from("<H", packet, 10)
    elif packet[:5] == b"\x7fFLAC" and len(packet) >= 9 + 4 + 4 + 14:
        rate = int.from_bytes(packet[27:30], "big") >> 4
    else:
        return BROKEN
    tail = at(max(0, size - TAIL), min(TAIL, size))
    spot = tail.rfind(b"OggS")
    while spot >= 0 and (len(tail) < spot + 18 or tail[spot + 14 : spot + 18] != serial or tail[spot + 6 : spot + 14] == b"\xff" * 8):
        spot = tail.rfind(b"OggS", 0, spot)
    if spot < 0 or not rate:
        return BROKEN
    (samples,) = struct.unpack_from("<q", tail, spot + 6)
    return _rated(max(0, samples - skip) / rate, size)


def mp4(at: Reader, size: int) -> Found:
    spot, end, wanted = 0, size, [b"moov", b"mvhd"]
    for _ in range(HOPS):
        head = at(spot, 16)
        if len(head) < 8 or spot >= end:
            return BROKEN
        n, name = struct.unpack_from(">I4s", head)
        body = 8
        if n == 1 and len(head) == 16:
            (n,), body = struct.unpack_from(">Q", head, 8), 16
        n = n or end - spot
        if n < body:
            return BROKEN
        if name != wanted[0]:
            spot += n
        elif len(wanted) == 2:
            wanted, end, spot = wanted[1:], min(end, spot + n), spot + body
        else:
            raw = at(spot + body, 32)
            wide = raw[:1] == b"\x01"
            if len(raw) < (32 if wide else 20):
                return BROKEN
            scale, long = struct.unpack_from(">IQ" if wide else ">II", raw, 20 if wide else 12)
            return _rated(long / scale, size) if scale else BROKEN
    return BROKEN


def probe(at: Reader, size: int) -> Found:
    """(known container, duration in seconds, bits a second); no duration: the header doesn't hold together."""
    head = at(0, 12)
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return wav(at, size)
    if head[:4] == b"fLaC":
        return flac(at, size)
    if head[:4] == b"OggS":
        return ogg(at, size)
    if head[4:8] in (b"ftyp", b"moov"):
        return mp4(at, size)
    if head[:1] == b"\xff" and len(head) > 1 and head[1] & 0xF6 == 0xF0:
        return adts(at, size)
    if head[:3] == b"ID3" or head[:1] == b"\xff":
        return mp3(at, size)
    return False, None, None

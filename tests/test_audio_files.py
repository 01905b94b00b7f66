"""Audio headers from ranges of bytes, over real files of each container."""

import struct

import pytest
from pyspark.sql import functions as F

from tilth.functions import containers
from tilth.sources import audio_files, readers


def wav(seconds, rate=8000, junk=0):
    data = bytes(int(seconds * rate) * 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16)
    extra = struct.pack("<4sI", b"LIST", junk) + bytes(junk) if junk else b""
    body = b"WAVE" + extra + fmt + struct.pack("<4sI", b"data", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp3(frames, kbit=9, tag=True, table=False):
    size = {9: 417, 5: 208}[kbit]
    head = bytes((0xFF, 0xFB, kbit << 4, 0x00))
    out = b"ID3\x04\x00\x00\x00\x00\x01\x00" + bytes(128) if tag else b""
    if table:
        out += head + bytes(32) + b"Info" + struct.pack(">II", 1, frames) + bytes(size - 48)
    return out + (head + bytes(size - 4)) * frames + (b"TAG" + bytes(125) if tag else b"")


def flac(samples, rate=44_100):
    info = bytes(10) + ((rate << 44) | (1 << 41) | (15 << 36) | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info + bytes(5000)


def page(packet, granule, serial=5, kind=0):
    laces = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    return b"OggS\x00" + bytes([kind]) + struct.pack("<qIII", granule, serial, 0, 0) + bytes([len(laces)]) + laces + packet


def ogg(samples, rate=48_000, opus=False, pages=20):
    first = b"OpusHead\x01\x02" + struct.pack("<HIHB", 312, rate, 0, 0) if opus else b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, rate, 0, 0, 0, 0xB8) + b"\x01"
    return page(first, 0, kind=2) + b"".join(page(bytes(3000), -1 if i % 2 else samples * (i + 1) // pages) for i in range(pages - 1)) + page(bytes(100), samples + 312 * opus, kind=4)


def mp4(seconds, wide=False):
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    head = b"\x01" + bytes(3) + bytes(16) + struct.pack(">IQ", 1000, int(seconds * 1000)) if wide else bytes(4) + bytes(8) + struct.pack(">II", 1000, int(seconds * 1000))
    return box(b"ftyp", b"M4A " + bytes(8)) + struct.pack(">I4sQ", 1, b"mdat", 16 + 70_000) + bytes(70_000) + box(b"moov", box(b"free", b"x") + box(b"mvhd", head + bytes(80)))


def aac(frames, size=200):
    return (bytes((0xFF, 0xF1, 4 << 2 | 1 << 6, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5, 0)) + bytes(size - 7)) * frames


FILES = {
    "a/001001.wav": (wav(2.5), 2.5), "a/001002.wav": (wav(1.0, junk=70_000), 1.0), "a/001003.mp3": (mp3(50), 50 * 1152 / 44_100), "a/001004.mp3": (mp3(4000), 4000 * 1152 / 44_100),
    "a/001005.mp3": (mp3(300, table=True), 300 * 1152 / 44_100), "a/001006.flac": (flac(441_000), 10.0), "b/001001.ogg": (ogg(96_000), 2.0), "b/001002.opus": (ogg(144_000, opus=True), 3.0),
    "b/001003.m4a": (mp4(7.25), 7.25), "b/001004.m4a": (mp4(7.25, wide=True), 7.25), "b/001005.aac": (aac(430), 430 * 1024 / 44_100), "b/001006.aac": (aac(2000), 2000 * 1024 / 44_100),
}
BAD = {
    "c/1.wav": (b"", "empty"), "c/2.flac": (b"fLaC" + bytes(10), "tiny"), "c/3.flac": (b"fLaC" + b"\x84" + bytes(2000), "corrupt"), "c/4.ogg": (page(b"something else", 5) + bytes(2000), "corrupt"),
    "c/5.m4a": (struct.pack(">I4s", 16, b"ftyp") + bytes(2000), "corrupt"), "c/6.mp3": (b"hello " * 400, "unreadable"), "c/7.flac": (flac(0), "zero_duration"), "c/8.wav": (wav(0) + bytes(2000), "zero_duration"),
    "c/9.ogg": (b"OggS" + bytes(3000), "corrupt"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("audio")
    for name, (raw, _) in {**FILES, **BAD}.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(raw)
    (top / "a/.hidden.wav").write_bytes(b"x")
    (top / "a/notes.txt").write_bytes(b"x")
    return top


def test_every_container(spark, folder):
    got = {"/".join(r["path"].rsplit("/", 2)[1:]): r for r in readers.probe_files(spark, str(folder)).collect()}
    assert set(got) == set(FILES) | set(BAD)
    for name, (raw, seconds) in FILES.items():
        r = got[name]
        assert r["status"] == "ok" and r["duration"] == pytest.approx(seconds, rel=0.005) and r["length"] == len(raw), name
        assert r["bitrate"] == pytest.approx(len(raw) * 8 / seconds, rel=0.2) or "junk" in name or name.endswith("2.wav")
    for name, (_, status) in BAD.items():
        assert got[name]["status"] == status, name


def test_bytes_read_are_bounded(spark, tmp_path):
    (tmp_path / "1.wav").write_bytes(wav(600))
    (tmp_path / "2.mp3").write_bytes(mp3(20_000))
    (tmp_path / "3.ogg").write_bytes(ogg(96_000 * 100, pages=2000))
    (tmp_path / "4.m4a").write_bytes(mp4(3) + bytes(3_000_000))
    got = readers.probe_files(spark, str(tmp_path)).collect()
    assert all(r["length"] > 3_000_000 and r["bytes_read"] <= 200_000 and r["status"] == "ok" for r in got)


def test_partitions_follow_sizes():
    files = [(f"{i}", 1 << 30) for i in range(300)] + [("x", 0)] * 5
    parts = audio_files.packed(files, lambda size: min(size, audio_files.HEADER_COST))
    assert [f for p in parts for f in p.files] == files and len(parts) == 1
    assert len(audio_files.packed(files, lambda size: size)) == 301 and len(audio_files.packed([], len)) == 1


def test_waveforms_of_wave_files_only(spark, folder):
    got = {"/".join(r["path"].rsplit("/", 2)[1:]): r for r in readers.read_waveforms(spark, str(folder)).select("path", "rate", F.size("signal").alias("n")).collect()}
    assert got["a/001001.wav"]["rate"] == 8000 and got["a/001001.wav"]["n"] == 20_000
    assert all(r["rate"] is None for n, r in got.items() if not n.endswith(".wav") or n == "c/1.wav")


def test_missing_folder_and_odd_bytes(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        readers.probe_files(spark, str(tmp_path / "nowhere")).collect()
    import random

    rng = random.Random(1)
    for raw, _ in [*FILES.values(), *BAD.values()]:
        for _ in range(30):
            cut = bytearray(raw[: rng.randrange(len(raw) + 1)])
            for _ in range(rng.randrange(4)):
                if cut:
                    cut[rng.randrange(min(len(cut), 200))] = rng.randrange(256)
            known, seconds, _ = containers.probe(lambda o, n, cut=cut: bytes(cut[o : o + n]), len(cut))
            assert seconds is None or (known and seconds >= 0)

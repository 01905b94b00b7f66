"""Data sources over folders of audio files: ``audio_listing``, ``audio_headers`` and ``audio_waveforms``.

The folder is listed once, names and sizes only, and cut into partitions by what will be read of each
file. Headers take ranges of bytes, never a whole file; every listed file gives a row, an empty one too. Waveforms
are read a file at a time, each in a batch of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilth.functions.audio import waveform
from tilth.functions.containers import TAIL, WALKED, probe

EXTENSIONS = ("mp3", "wav", "flac", "ogg", "opus", "m4a", "aac")
#: Bytes that a partition reads, about, and what opening a file costs, in bytes.
PART, OPENING = 64 << 20, 1 << 16
HEADER_COST = 2 * max(WALKED, TAIL)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def listed(uri: str, extensions: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of one file, by path; hidden ones are left out."""
    from pyarrow import fs

    system, path = file_system(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(path) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and extension(f.path) in extensions and not hidden(f.path))


def packed(files: list[tuple[str, int]], cost) -> list[Files]:
    """Files in order, cut where a partition has about ``PART`` bytes to read."""
    parts, held = [], 0
    for f in files:
        if not parts or held >= PART:
            parts.append(Files([]))
            held = 0
        parts[-1].files.append(f)
        held += OPENING + cost(f[1])
    return parts or [Files([])]


class _Folder(DataSource):
    def folder(self) -> tuple[str, tuple[str, ...]]:
        if "path" not in self.options:
            raise ValueError("load() needs a path")
        wanted = self.options.get("extensions")
        return self.options["path"], tuple(x.strip().lower() for x in wanted.split(",")) if wanted else EXTENSIONS


class AudioListing(_Folder):
    """path, length; nothing of a file is read, and files without bytes are listed."""

    @classmethod
    def name(cls) -> str:
        return "audio_listing"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(*self.folder())


class ListingReader(DataSourceReader):
    def __init__(self, uri: str, extensions: tuple[str, ...]):
        self.uri, self.extensions = uri, extensions

    def partitions(self):
        return packed(listed(self.uri, self.extensions), lambda size: 0)

    def read(self, partition: Files):
        yield from partition.files


class AudioHeaders(_Folder):
    """path, length, known, duration (seconds), bitrate, bytes_read; options: path, extensions (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return "path string, length long, known boolean, duration double, bitrate long, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(*self.folder())


class HeaderReader(DataSourceReader):
    def __init__(self, uri: str, extensions: tuple[str, ...]):
        self.uri, self.extensions = uri, extensions

    def partitions(self):
        return packed(listed(self.uri, self.extensions), lambda size: min(size, HEADER_COST))

    def read(self, partition: Files):
        system, _ = file_system(self.uri)
        for path, size in partition.files:
            used = 0
            try:
                with system.open_input_file(path) as f:

                    def at(offset: int, n: int, f=f, size=size) -> bytes:
                        nonlocal used
                        raw = f.read_at(max(0, min(n, size - offset)), offset) if offset < size else b""
                        used += len(raw)
                        return raw

                    found = probe(at, size)
            except OSError:
                found = (False, None, None)
            yield (path, size, *found, used)


class AudioWaveforms(_Folder):
    """path, rate, signal (mono, -1 to 1); both null for what isn't a readable WAVE file, of which nothing is read if its name says so."""

    @classmethod
    def name(cls) -> str:
        return "audio_waveforms"

    def schema(self) -> str:
        return "path string, rate int, signal array<float>"

    def reader(self, schema) -> DataSourceReader:
        return WaveformReader(*self.folder())


class WaveformReader(DataSourceReader):
    def __init__(self, uri: str, extensions: tuple[str, ...]):
        self.uri, self.extensions = uri, extensions

    def partitions(self):
        return packed(listed(self.uri, self.extensions), lambda size: size)

    def read(self, partition: Files):
        import pyarrow as pa

        system, _ = file_system(self.uri)
        schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("signal", pa.list_(pa.float32()))])
        for path, _ in partition.files:
            found = None
            if extension(path) == "wav":
                with system.open_input_file(path) as f:
                    found = waveform(f.read())
            rate, signal = found or (None, None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), pa.array([signal], pa.list_(pa.float32()))], schema=schema)


def register(spark: SparkSession) -> None:
    for source in (AudioListing, AudioHeaders, AudioWaveforms):
        spark.dataSource.register(source)

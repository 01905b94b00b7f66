"""A keyed table of rows in buckets: an upsert rewrites only the buckets that it touches.

``data/<write>/_bucket=<n>`` holds the rows of a bucket, ``manifest/<version>.json`` which folder each bucket
has in that version, its schema, and the last batch of each stream. A commit is one rename of a new manifest, which
fails if another writer was first; readers follow the manifest they began with, so they see one version whatever is
committed meanwhile. Folders that no kept version names go with ``expire``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilth.operators.quality import last_wins

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed the version first; nothing of this write is visible."""


@dataclass
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: str | None = None
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        """The table below ``path``, new or old; ``buckets`` counts only for a new one (later: ``resize``)."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark.sparkContext._jvm
        self._files = jvm.org.apache.hadoop.fs
        self._fs = self._files.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions ----
    def _at(self, *parts: str):
        return self._files.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        where = self._at("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version's, or ``version``'s; an empty one before the first commit."""
        known = self.versions()
        if not known and version is None:
            return Manifest(-1, self.keys, self.buckets)
        number = known[-1] if version is None else version
        stream = self._fs.open(self._at("manifest", f"{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = Manifest(**json.loads(text))
        if found.keys != self.keys:
            raise ValueError(f"the table's keys are {found.keys}")
        return found

    def _commit(self, manifest: Manifest) -> Manifest:
        draft, final = self._at("manifest", f".{uuid.uuid4().hex}"), self._at("manifest", f"{manifest.version:012d}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        context = self._files.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep_old = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, keep_old)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version} is taken") from e
            raise
        return manifest

    # ---- reading ----
    def _read(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        wanted = manifest.folders if buckets is None else {str(b): manifest.folders[str(b)] for b in buckets if str(b) in manifest.folders}
        if manifest.schema is None:
            raise ValueError(f"{self.path} has no rows yet")
        schema = StructType.fromJson(json.loads(manifest.schema))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in wanted.values()])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; only their buckets are read. ``keys`` is a list of wanted keys, its buckets are found first."""
        manifest = self.manifest()
        wanted = keys.select(*self.keys).distinct()
        touched = self._touched(self._placed(wanted, manifest))
        return _semi(self._read(manifest, touched), wanted, self.keys, "left_semi")

    # ---- writing ----
    def _placed(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        if BUCKET in rows.columns:
            raise ValueError(f"a column is named {BUCKET}")
        if manifest.schema is not None:
            kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(manifest.schema))}
            rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(manifest.buckets)).cast("int"))

    @staticmethod
    def _touched(placed: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r[0] for r in placed.select(BUCKET).distinct().collect())

    def _write(self, placed: DataFrame, n: int) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        placed.repartition(max(1, n), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, rows: DataFrame, order: list[str], stream: str | None = None, batch: int | None = None) -> Manifest:
        """Rows take the place of those with their keys; of several with one key the last in ``order`` counts.

        A ``batch`` of a ``stream`` that is no newer than its last one changes nothing. Null keys are equal. The
        columns of the first write stay the table's; others are an error.
        """
        old = self.manifest()
        if stream is not None and batch is not None and old.batches.get(stream, -1) >= batch:
            return old
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._placed(last_wins(rows, self.keys, order).select(rows.columns), old).write.parquet(staged)  # once, for the buckets and the merge
        new = self.spark.read.parquet(staged)
        touched = self._touched(new)
        folders, schema = dict(old.folders), old.schema or json.dumps(new.drop(BUCKET).schema.jsonValue())
        if touched:
            merged = new
            if old.schema is not None:
                if sorted(new.drop(BUCKET).columns) != sorted(f.name for f in StructType.fromJson(json.loads(old.schema))):
                    raise ValueError("the columns aren't the table's")
                before = self._placed(self._read(old, touched), old)
                merged = _semi(before, new.select(*self.keys), self.keys, "left_anti").unionByName(new)
            folder = self._write(merged, len(touched))
            folders |= {str(b): f"{folder}/{BUCKET}={b}" for b in touched}
        done = self._commit(Manifest(old.version + 1, self.keys, old.buckets, schema, folders, old.batches | ({stream: batch} if stream is not None and batch is not None else {})))
        self._fs.delete(self._files.Path(staged), True)
        return done

    def delete(self, keys: DataFrame) -> Manifest:
        """Rows of these keys go; only their buckets are rewritten."""
        old = self.manifest()
        wanted = keys.select(*self.keys).distinct()
        touched = [b for b in self._touched(self._placed(wanted, old)) if str(b) in old.folders]
        left = self._placed(_semi(self._read(old, touched), wanted, self.keys, "left_anti"), old)
        folders = {b: f for b, f in old.folders.items() if int(b) not in touched}
        if touched:
            folder = self._write(left, len(touched))
            folders |= {str(b): f"{folder}/{BUCKET}={b}" for b in touched if self._fs.exists(self._at(folder, f"{BUCKET}={b}"))}
        return self._commit(Manifest(old.version + 1, self.keys, old.buckets, old.schema, folders, old.batches))

    def resize(self, buckets: int) -> Manifest:
        """The same rows in another number of buckets, for a table that has outgrown them."""
        old = self.manifest()
        new = Manifest(old.version + 1, self.keys, buckets, old.schema, {}, old.batches)
        placed = self._placed(self._read(old), new)
        folder = self._write(placed, buckets)
        new.folders = {str(b): f"{folder}/{BUCKET}={b}" for b in range(buckets) if self._fs.exists(self._at(folder, f"{BUCKET}={b}"))}
        return self._commit(new)

    def expire(self, keep: int = 3, older_than: float = 3600.0) -> int:
        """Drop all but the newest ``keep`` versions and the folders that none of those names. -> folders removed.

        Folders younger than ``older_than`` seconds stay: a writer may be about to commit them.
        """
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._at("manifest", f"{v:012d}.json"), False)
        named = {f for v in known[-keep:] for f in self.manifest(v).folders.values()}
        before, removed = (time.time() - older_than) * 1000, 0
        for top in ("data", "staged"):
            for write in self._fs.listStatus(self._at(top)) if self._fs.exists(self._at(top)) else []:
                parts = [p for p in self._fs.listStatus(write.getPath()) if p.isDirectory()]
                mine = {f"{top}/{write.getPath().getName()}/{p.getPath().getName()}": p for p in parts}
                if write.getModificationTime() > before:
                    continue
                gone = [p for name, p in mine.items() if name not in named]
                if len(gone) == len(mine):
                    self._fs.delete(write.getPath(), True)
                else:
                    for p in gone:
                        self._fs.delete(p.getPath(), True)
                removed += max(1, len(gone)) if len(gone) == len(mine) else len(gone)
        return removed


def _semi(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """A semi or anti join on keys where null equals null."""
    marks = keys.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(names)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(names):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    return rows.join(marks, same, how)

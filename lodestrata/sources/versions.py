"""A versioned table in plain Parquet: manifests, upserts, tombstones, compaction, tags, garbage collection, generations.

A version is a small manifest that lists data folders; folders and manifests are
written once and never changed. The manifest is a version's commit: it comes last,
and one that was cut off while it was written doesn't count, so a crash at any
place leaves the last version as it was, and the next write goes on after it.
Manifests and pointers go through the file system that the root belongs to, so
the table works on any store that Spark can write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Small files on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def put(self, name: str, text: str) -> None:
        """Writes a file, which must be new, so of two writers one fails; nothing is ever replaced."""
        out = self.fs.create(self.at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def get(self, name: str) -> str | None:
        path = self.at(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self.at(folder) if folder else self.root
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass
class Version:
    vid: int
    folders: list[str] = field(default_factory=list)  # oldest first; later ones win
    unindexed: list[str] = field(default_factory=list)
    sha_tag: str | None = None
    stamp: dict = field(default_factory=dict)


class VersionedTable:
    """Rows by key; the newest folder that holds a key has its row. `tombstone` rows are hidden from read()."""

    def __init__(self, spark: SparkSession, root: str, key: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.root, self.key, self.partition_by = spark, root.rstrip("/"), key, partition_by
        self.store = Store(spark, root)

    def versions(self) -> list[Version]:
        """All versions whose manifest is whole, oldest first."""
        return [Version(**v) for n in self.store.names("versions") if (v := whole_json(self.store.get(f"versions/{n}")))]

    def current(self) -> Version | None:
        every = self.versions()
        return every[-1] if every else None

    def _next(self) -> int:
        """One more than any number that was ever given out: a mark stays of the highest when its manifest goes."""
        return max((int(n.split(".")[0]) for folder in ("versions", "marks") for n in self.store.names(folder)), default=0) + 1

    def _commit(self, v: Version) -> Version:
        self.store.put(f"versions/{v.vid:09d}.json", json.dumps(asdict(v)))
        return v

    def upsert(self, rows: DataFrame, sha_tag: str | None = None, stamp: dict | None = None) -> Version:
        """A new version in which rows replace those of equal keys; rows that hold a key twice are refused, and leave the table as it was."""
        old, vid = self.current(), self._next()
        folder = f"data/{vid:09d}-{uuid.uuid4().hex[:12]}"
        out = rows if "tombstone" in rows.columns else rows.withColumn("tombstone", F.lit(False))
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.root}/{folder}")
        written = self.spark.read.parquet(f"{self.root}/{folder}")
        if not written.groupBy(self.key).count().where("count > 1").isEmpty():
            self.store.delete(folder)
            raise ValueError(f"a batch holds more than one row of the same {self.key}")
        base = old or Version(0)
        return self._commit(Version(vid, [*base.folders, folder], [*base.unindexed, folder], sha_tag, stamp or base.stamp))

    def replace_source(self, source: str, value: str, rows: DataFrame, sha_tag: str | None = None) -> Version:
        """Tombstones all live rows of a source, then puts its new rows, in one version."""
        if self.current() is None:
            return self.upsert(rows, sha_tag)
        gone = self.lookup(self._holders(source, value)).where(F.col(source) == value).join(rows.select(self.key), self.key, "left_anti").withColumn("tombstone", F.lit(True))
        return self.upsert(rows.withColumn("tombstone", F.lit(False)).unionByName(gone), sha_tag)

    def _holders(self, column: str, value: str) -> DataFrame:
        """Keys of which any folder has a row with this value; the filter reaches the scans."""
        keys = None
        for f in self.current().folders:
            some = self.spark.read.parquet(f"{self.root}/{f}").where(F.col(column) == value).select(self.key)
            keys = some if keys is None else keys.unionByName(some)
        return keys.distinct()

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The live rows of the newest version whose key is among keys; only these are ranked by age, so cost goes with keys, not with the table."""
        v, parts = self.current(), None
        for k, f in enumerate(v.folders):
            part = self.spark.read.parquet(f"{self.root}/{f}").join(keys.select(self.key), self.key, "left_semi").withColumn("__age", F.lit(len(v.folders) - k))
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        newest = Window.partitionBy(self.key).orderBy("__age")
        rows = parts.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__age")
        return rows.where(~F.coalesce("tombstone", F.lit(False))).drop("tombstone")

    def read(self, vid: int | None = None, sha_tag: str | None = None, with_tombstones: bool = False) -> DataFrame:
        """The live rows of the newest version, of a given one, or of the newest with a tag."""
        v = next((v for v in reversed(self.versions()) if (vid is None or v.vid == vid) and (sha_tag is None or v.sha_tag == sha_tag)), None)
        if v is None:
            raise KeyError(f"no version {vid or sha_tag or ''}")
        if len(v.folders) == 1:
            rows = self.spark.read.parquet(f"{self.root}/{v.folders[0]}")
        else:
            parts = [self.spark.read.parquet(f"{self.root}/{f}").withColumn("__age", F.lit(len(v.folders) - k)) for k, f in enumerate(v.folders)]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p, allowMissingColumns=True)
            newest = Window.partitionBy(self.key).orderBy("__age")
            rows = rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__age")
        return rows if with_tombstones else rows.where(~F.coalesce("tombstone", F.lit(False))).drop("tombstone")

    def optimize(self) -> Version:
        """Folds all folders into one; nothing is unindexed after it."""
        v = self.current()
        if v is None or (len(v.folders) == 1 and not v.unindexed):
            return v
        vid = self._next()
        folder = f"data/{vid:09d}-{uuid.uuid4().hex[:12]}"
        writer = self.read(v.vid).withColumn("tombstone", F.lit(False)).write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.root}/{folder}")
        return self._commit(Version(vid, [folder], [], None, v.stamp))

    def index_stats(self) -> dict[str, int]:
        v = self.current()
        count = lambda names: sum(self.spark.read.parquet(f"{self.root}/{f}").count() for f in names)
        if v is None:
            return {"num_unindexed_rows": 0, "num_indexed_rows": 0}
        behind = count(v.unindexed)
        return {"num_unindexed_rows": behind, "num_indexed_rows": count(v.folders) - behind}

    def tag(self, sha: str) -> Version:
        """The newest version again, under a commit's tag."""
        v = self.current()
        return self._commit(Version(self._next(), v.folders, v.unindexed, sha, v.stamp))

    def restore(self, sha: str) -> Version:
        """A tagged version becomes the newest."""
        v = next(v for v in reversed(self.versions()) if v.sha_tag == sha)
        return self._commit(Version(self._next(), v.folders, v.unindexed, None, v.stamp))

    def cleanup_old_versions(self, keep: int) -> int:
        """Removes untagged versions but the newest `keep`, and data that no version left lists; returns how many."""
        if keep < 0:
            raise ValueError("keep must not be negative")
        every = self.versions()
        plain = [v for v in every if v.sha_tag is None]
        gone = plain[: len(plain) - keep] if keep else plain
        left = {f for v in every if v not in gone for f in v.folders}
        if gone:
            highest = self._next() - 1
            if f"{highest:09d}" not in self.store.names("marks"):
                self.store.put(f"marks/{highest:09d}", "")
            for n in self.store.names("marks"):
                if n != f"{highest:09d}":
                    self.store.delete(f"marks/{n}")
        for v in gone:
            self.store.delete(f"versions/{v.vid:09d}.json")
        for f in {f for v in gone for f in v.folders} - left:
            self.store.delete(f)
        return len(gone)


def whole_json(text: str | None) -> dict | None:
    """What a small file says, or nothing if it was cut off."""
    try:
        return json.loads(text or "")
    except ValueError:
        return None


class Generations:
    """Blue-green generations of a table under root: one is active, a new one is built beside it and swapped in.

    Pointers are written once each; the active generation is the one that the
    highest whole pointer names. A crash before it leaves the old one active.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def active(self) -> int | None:
        whole = (whole_json(self.store.get(f"pointers/{n}")) for n in reversed(self.store.names("pointers")))
        return next((p["generation"] for p in whole if p), None)

    def build(self, rows: DataFrame, validate, room_bytes: int = 0) -> int:  # noqa: ANN001
        """Writes the next generation, validates what was written and makes it active; on failure the old one stays."""
        status = self.store.fs.getStatus()
        if status.getRemaining() < room_bytes:
            raise OSError("not enough room for another generation")
        n = max([int(x.split(".")[0]) for x in self.store.names("pointers")] + [int(x.split("=")[1]) for x in self.store.names("") if x.startswith("generation=")], default=0) + 1
        folder = f"generation={n}"
        try:
            rows.write.parquet(f"{self.root}/{folder}")
            if not validate(self.spark.read.parquet(f"{self.root}/{folder}")):
                raise ValueError(f"generation {n} is not valid")
        except BaseException:
            self.store.delete(folder)
            raise
        self.store.put(f"pointers/{n:09d}.json", json.dumps({"generation": n}))
        return n

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generation={self.active()}")


def plain_versions_to_remove(versions: DataFrame, keep: int) -> DataFrame:
    """Of a catalog (store_id, vid, sha_tag): which versions cleanup removes and which stay."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    order = Window.partitionBy("store_id", F.col("sha_tag").isNull()).orderBy(F.desc("vid"))
    return versions.withColumn("removed", F.col("sha_tag").isNull() & (F.row_number().over(order) > keep))


def unindexed_stats(rows: DataFrame, by: str) -> DataFrame:
    """(by, num_unindexed_rows, num_indexed_rows) of rows with a flag `indexed`."""
    return rows.groupBy(by).agg(F.count_if(~F.col("indexed")).alias("num_unindexed_rows"), F.count_if(F.col("indexed")).alias("num_indexed_rows"))


def manifests(chunks: DataFrame) -> DataFrame:
    """One manifest row per project from chunk rows (project_id, source_path, content_hash, doc_type, ownership, sha): artifacts as JSON."""
    artifact = F.struct(F.col("source_path").alias("path"), "content_hash", "doc_type", "ownership")
    out = chunks.groupBy("project_id").agg(F.array_sort(F.collect_list(artifact)).alias("a"), F.max("sha").alias("sha"))
    return out.select("project_id", F.col("sha").alias("ingestedFromSha"), F.size("a").cast("long").alias("n_artifacts"), F.to_json("a").alias("artifacts"))


def registry_of(manifest_rows: DataFrame) -> DataFrame:
    """The registry as it is rebuilt from manifests (project_id, ingestedFromSha, vid): the newest of each project."""
    return manifest_rows.groupBy("project_id").agg(F.max_by("ingestedFromSha", "vid").alias("last_indexed_sha"), F.count("*").alias("n_manifests"))


def content_delta(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(key, change): added, removed, changed or same, by a full outer join."""
    a, b = old.select(key, F.col(digest).alias("old_hash"), F.lit(True).alias("was")), new.select(key, F.col(digest).alias("new_hash"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks (content_hash, model_version) that the embedding cache lacks."""
    return wanted.join(cache, ["content_hash", "model_version"], "left_anti")

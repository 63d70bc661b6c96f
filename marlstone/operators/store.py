"""A versioned store of chunks: immutable folders, and a manifest per version that names those in use.

Below the root: ``chunks`` (path, chunk_hash, chunk and what ``derive`` adds, such as
vectors), ``layout`` (path, chunk_idx, chunk_hash: the chunks of each file in their
order) and ``files`` (path, hash, size, version, created_at, updated_at), each a
set of folders that are written once.  A version exists from the moment its
manifest is renamed into place: a job that dies before leaves the last version
as it was, and folders that ``vacuum`` removes.  A chunk whose file has held
it before is neither derived nor written again.  One writer at a time: a second one's switch fails.

Defined results: a null text is the empty text and has no chunks; equal chunks of a file are stored once and
laid out as often as they occur; an empty table of files removes all; repeated paths are not allowed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chunking, incremental

PARTS = {
    "chunks": "path string, chunk_hash string, chunk string", "layout": "path string, chunk_idx int, chunk_hash string",
    "files": "path string, hash string, size int, version int, created_at timestamp, updated_at timestamp",
}
Derive = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer made the same version."""


def cut_files(files: DataFrame) -> DataFrame:
    """path, chunk_idx, chunk of (path, text), in chunks of fixed size."""
    return chunking.fixed_chunks(files.select(F.col("path").alias("doc_id"), "text")).select(F.col("doc_id").alias("path"), "chunk_idx", "chunk")


class Store:
    def __init__(self, spark: SparkSession, root: str, derive: Derive = lambda fresh: fresh, cut: Derive = cut_files) -> None:
        self.spark, self.root, self.derive, self.cut = spark, root.rstrip("/"), derive, cut
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of a version, the last one by default."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {part: [] for part in PARTS}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0])

    def _switch(self, folders: dict[str, list[str]]) -> int:
        """Make the folders the next version: the manifest appears whole, under a name that must be free."""
        version = max(self.versions(), default=0) + 1
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json"), self._path(f"{self.root}/manifests/{version:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict(f"version {version} exists")
        return version

    def _write(self, part: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.mode("error").parquet(f"{self.root}/{part}/{name}")
        return name

    def _read(self, part: str, folders: dict[str, list[str]]) -> DataFrame:
        if not folders[part]:
            return self.spark.createDataFrame([], PARTS[part])
        return self.spark.read.parquet(*[f"{self.root}/{part}/{name}" for name in folders[part]])

    # -- contents

    def files(self, version: int | None = None) -> DataFrame:
        return self._read("files", self.manifest(version))

    def read(self, version: int | None = None) -> DataFrame:
        """path, chunk_idx, chunk_hash, chunk and what was derived, of a version's files."""
        folders = self.manifest(version)
        return self._read("layout", folders).join(self._read("chunks", folders), ["path", "chunk_hash"])

    def count(self, version: int | None = None) -> int:
        return self._read("layout", self.manifest(version)).count()

    def upsert(self, files: DataFrame) -> int:
        """Bring the store up to date with (path, text), all files there are: missing ones go, unchanged ones are not read again.  Returns the version."""
        before = self.manifest()
        stored = self._read("files", before)
        prints = incremental.fingerprints(files)
        changed = incremental.changed_files(stored.select("path", "hash", "size"), files)
        same = prints.join(stored.select("path", "hash", "size"), ["path", "hash", "size"], "left_semi").select("path")
        cut = self.cut(changed).select("path", "chunk_idx", F.md5("chunk").alias("chunk_hash"), "chunk")
        folders = {part: [] for part in PARTS}
        old_layout = self._read("layout", before).join(same, "path", "left_semi")
        folders["layout"] = [self._write("layout", old_layout.unionByName(cut.drop("chunk")))]
        fresh = cut.select("path", "chunk_hash", "chunk").dropDuplicates(["path", "chunk_hash"])
        fresh = fresh.join(self._read("chunks", before).select("path", "chunk_hash"), ["path", "chunk_hash"], "left_anti")
        folders["chunks"] = [*before["chunks"], self._write("chunks", self.derive(fresh))]
        seen = prints.select("path", "hash", "size").withColumn("seen_at", F.current_timestamp())
        versions = incremental.version_upsert(stored.drop("size"), seen.drop("size"))
        folders["files"] = [self._write("files", versions.join(prints.select("path", "size"), "path"))]
        return self._switch(folders)

    def clear(self) -> int:
        """A version without files; earlier ones stay until ``vacuum``."""
        return self._switch({part: [] for part in PARTS})

    def compact(self) -> int:
        """A version of the same content whose chunks lie in one folder, without those that no file holds any more."""
        before = self.manifest()
        live = self._read("chunks", before).join(self._read("layout", before).select("path", "chunk_hash").distinct(), ["path", "chunk_hash"], "left_semi")
        return self._switch(before | {"chunks": [self._write("chunks", live)]})

    def orphans(self, keep: int = 1) -> list[str]:
        """Folders that none of the last ``keep`` versions names."""
        used = {f"{part}/{name}" for v in self.versions()[-keep:] for part, names in self.manifest(v).items() for name in names}
        return [f for part in PARTS for name in self._names(part) if (f := f"{part}/{name}") not in used]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove older versions' manifests, then orphans; returns those.  Not beside a running writer, whose folders no manifest names yet."""
        for version in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{version:09d}.json"), False)
        gone = self.orphans(keep)
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone

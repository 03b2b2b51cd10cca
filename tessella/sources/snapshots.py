"""Versioned Parquet snapshots of the chunk table and the manifest, behind one pointer that moves atomically."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.sync import MANIFEST


class SnapshotStore:
    """A directory of snapshots. Readers follow the pointer; a crashed writer leaves the old snapshot in force.

    The last ``kept`` snapshots before the one in force stay, for readers that have not finished with them.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = 2) -> None:
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def current(self) -> str | None:
        """The directory of the snapshot in force; None if there is none or the pointer can't be read."""
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            name = bytes(b % 256 for b in stream.readAllBytes()).decode("utf-8", "replace").strip()
        finally:
            stream.close()
        return f"{self.root}/{name}" if name and self._fs.exists(self._path(f"{self.root}/{name}/manifest")) else None

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        at = self.current()
        if at is None:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{at}/{table}")

    def manifest(self) -> DataFrame:
        """The manifest in force; empty if there is none."""
        found = self.read("manifest", MANIFEST)
        return found if found is not None else self.spark.createDataFrame([], MANIFEST)

    def begin(self) -> str:
        return f"{self.root}/snapshot-{uuid.uuid4().hex}"

    def publish(self, directory: str, based_on: str | None = None) -> None:
        """Move the pointer to a directory that is completely written, and drop snapshots that are out of date.

        If ``based_on`` is given and another snapshot is in force by now, another writer was faster: that is an error.
        """
        old = self.current()
        if based_on is not None and old != based_on:
            raise RuntimeError("another snapshot was published since this one was begun")
        temporary, pointer = self._path(f"{self.root}/.CURRENT-{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(temporary, True)
        out.write(bytearray(directory.rsplit("/", 1)[1].encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, pointer, overwrite)
        self._drop_old(directory)

    def _drop_old(self, current: str) -> None:
        """Drop complete snapshots but the newest ones; a directory without a manifest may still be written."""
        held = [s for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName().startswith("snapshot-")]
        done = [(s.getModificationTime(), s.getPath()) for s in held if s.getPath().getName() != current.rsplit("/", 1)[1] and self._fs.exists(self._path(f"{self.root}/{s.getPath().getName()}/manifest/_SUCCESS"))]
        for _, path in sorted(done, key=lambda x: -x[0])[self.kept :]:
            self._fs.delete(path, True)

    def reset(self) -> None:
        """Remove all snapshots."""
        self._fs.delete(self._path(self.root), True)

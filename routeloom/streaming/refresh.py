"""Snapshot refresh: rebuild when new dumps appear, and swap the snapshot by a pointer."""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import rib_dump

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def listing(spark: SparkSession, source: str, dump_of: Callable[[Column], Column] = _file_name) -> DataFrame:
    """(collector, dump, path, modified, length) of the files below a folder; no content is read.

    The collector is the name of a file's folder. ``dump_of`` names the dump a path belongs to, where one has several files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    path = F.col("path")
    return files.select(F.element_at(F.split(path, "/"), -2).alias("collector"), dump_of(path).alias("dump"), "path", F.col("modificationTime").alias("modified"), "length")


def newest(files: DataFrame) -> DataFrame:
    """The files of each collector's newest dump; the dump's name breaks ties of its time."""
    last = files.groupBy("collector", "dump").agg(F.max("modified").alias("at")).groupBy("collector").agg(F.max(F.struct("at", "dump"))["dump"].alias("dump"))
    return files.join(last, ["collector", "dump"], "left_semi")


class SnapshotFolder:
    """Snapshots side by side in ``v=<n>``; the pointer ``current/v=<n>`` names what the newest one was built from.

    A snapshot is complete before its pointer is written, so a reader sees the old one or the new one. The last ``keep`` stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), max(1, keep)

    def _pointers(self) -> list:
        try:
            return sorted(self.spark.read.schema("v bigint, made_from string").json(f"{self.folder}/current/*").collect(), key=lambda r: r["v"])
        except Exception as e:  # nothing published yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def current(self) -> tuple[str, list] | None:
        """Folder of the newest snapshot and what it was built from."""
        held = self._pointers()
        return (f"{self.folder}/v={held[-1]['v']}", json.loads(held[-1]["made_from"])) if held else None

    def swap(self, write: Callable[[str], None], made_from: list) -> str:
        """Write a new snapshot into a folder of its own, then point to it."""
        held = self._pointers()
        v = held[-1]["v"] + 1 if held else 0
        write(f"{self.folder}/v={v}")
        row = self.spark.createDataFrame([(v, json.dumps(made_from))], "v bigint, made_from string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/current/v={v}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for old in [r["v"] for r in held][: max(0, len(held) + 1 - self.keep)]:
            fs.delete(path(f"{self.folder}/current/v={old}"), True)
            fs.delete(path(f"{self.folder}/v={old}"), True)
        return f"{self.folder}/v={v}"


def refresh(spark: SparkSession, source: str, snapshots: SnapshotFolder, build: Callable[[DataFrame, str], None],
            dump_of: Callable[[Column], Column] = _file_name) -> str | None:
    """Build a snapshot of every collector's newest whole dump with ``build(entries, folder)``, unless the current one is of the same files.

    Only the chosen dumps are read. A dump with a torn file is passed over for the one before it. None when nothing changed.
    """
    files, torn = listing(spark, source, dump_of), set()
    while True:
        left = files.where(~F.col("path").isin(sorted(torn))) if torn else files
        whole = left if not torn else left.join(files.where(F.col("path").isin(sorted(torn))).select("collector", "dump").distinct(), ["collector", "dump"], "left_anti")
        # One dump per collector: a handful of file names.
        chosen = sorted([r["collector"], r["path"], r["length"], str(r["modified"])] for r in newest(whole).collect())
        now = snapshots.current()
        if not chosen or now and now[1] == chosen:
            return None
        paths: dict[str, list[str]] = {}
        for collector, path, *_ in chosen:
            paths.setdefault(collector, []).append(path)
        framed = rib_dump.dump_frames(spark, paths)
        bad = {r["file"] for r in rib_dump.dump_status(framed).where(~F.col("complete")).select("file").collect()}
        if not bad:
            entries = rib_dump.entries_from_frames(framed).drop("file", "seq")
            return snapshots.swap(lambda folder: build(entries, folder), chosen)
        torn |= bad


def refresh_on_new_dumps(spark: SparkSession, source: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None]):
    """When a dump appears that was not seen before, hand the entries of every collector's newest dump to
    ``rebuild(entries, batch_id)``.

    New files are only the trigger: a snapshot needs all collectors, also those whose dump is older. Runs over what is
    there and stops. ``rebuild`` should overwrite by snapshot date, so that a repeated batch gives the same result.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(source)

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.select("path").isEmpty():
            return
        chosen = {r["collector"]: r["path"] for r in newest(listing(spark, source)).collect()}  # one file per collector
        rebuild(rib_dump.entries_from_frames(rib_dump.dump_frames(spark, chosen)).drop("file", "seq"), batch_id)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

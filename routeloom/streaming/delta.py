"""Incremental registry feeds: ordered additions and deletions on a keyed set of route objects."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import durable
from ..sources.rpsl import delta_operations, feed_operations

KEY = ["family", "ip_start", "ip_end", "plen", "origin", "source"]


def last_operations(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """The operation that decides each key: the last one."""
    return ops.groupBy(*key).agg(F.max_by("op", order).alias("op"))


def apply_delta(state: DataFrame, ops: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """State after the operations: touched keys leave, keys whose last operation is ADD come back.

    Deleting an absent row does nothing.
    """
    last = last_operations(ops, key, order)
    rest = state.select(*key).join(last.select(*key), key, "left_anti")
    return rest.unionByName(last.where(F.col("op") == "ADD").select(*key))


def changes(state: DataFrame, ops: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """Keys actually added or deleted by the operations."""
    last = last_operations(ops, key, order)
    had = state.select(*key, F.lit(True).alias("had")).distinct()
    j = last.join(had, key, "left").withColumn("had", F.coalesce("had", F.lit(False)))
    return j.where((F.col("op") == "ADD") != F.col("had"))


def can_apply(have_serial: int | None, oldest: int, current: int, limit: int | None = None) -> bool:
    """May the feed bring this state up to date, or is a full load due? One apply is one shuffle, so there is no limit by default."""
    return have_serial is not None and oldest <= have_serial <= current and (limit is None or current - have_serial <= limit)


class FeedGap(RuntimeError):
    """The feed does not continue the state: a full load is due."""


class DeltaFeed:
    """A versioned set that is read by merging: a base, and the operations that came after it.

    ``base/v=<n>`` holds the whole set as of some serial, ``delta/v=<n>`` the deciding operation of each key that a batch
    touched, sorted by key. A version becomes current when its row is in ``commits/v=<n>``: that row names the serial, the base and
    the deltas to merge. A batch costs as much as its operations; the base is read when the set is read, and rewritten when
    the deltas have grown to ``fold_at`` of it (or to ``most_deltas`` in number). Folders that no version among the last
    ``keep`` names are then removed, so a reader has that many versions of time.

    A batch that is replayed finds its serials committed and changes nothing; one that died before its commit is written over.
    """

    def __init__(self, spark: SparkSession, folder: str, limit: int | None = None, fold_at: float = 0.1, most_deltas: int = 32, keep: int = 2):
        self.spark, self.folder, self.limit = spark, folder.rstrip("/"), limit
        self.fold_at, self.most_deltas, self.keep = fold_at, most_deltas, max(1, keep)

    def _commits(self) -> list:
        """Rows of the stored versions, oldest first; a handful, as older ones are removed."""
        kind = "v bigint, serial bigint, base bigint, deltas array<bigint>, base_rows bigint, delta_rows bigint"
        try:
            return sorted(self.spark.read.schema(kind).json(f"{self.folder}/commits/*").collect(), key=lambda r: r["v"])
        except Exception as e:  # nothing published yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def current(self):
        """Row of the current version, or None."""
        held = self._commits()
        return held[-1] if held else None

    def serial(self) -> int | None:
        now = self.current()
        return now and now["serial"]

    def _commit(self, now, v: int, **row) -> None:
        fields = "v bigint, serial bigint, base bigint, deltas array<bigint>, base_rows bigint, delta_rows bigint"
        one = self.spark.createDataFrame([(v, row["serial"], row["base"], row["deltas"], row["base_rows"], row["delta_rows"])], fields)
        one.coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/v={v}")

    def _merged(self, now) -> DataFrame:
        base = self.spark.read.parquet(f"{self.folder}/base/v={now['base']}")
        if not now["deltas"]:
            return base
        ops = self.spark.read.parquet(*[f"{self.folder}/delta/v={v}" for v in now["deltas"]])
        last = last_operations(ops, KEY, "serial")
        # The number of delta rows is in the commit, so the size is known before the join is planned.
        side = F.broadcast(last) if now["delta_rows"] <= self.FEW_OPERATIONS else last
        rest = base.join(side.select(*KEY), KEY, "left_anti")
        return rest.unionByName(last.where(F.col("op") == "ADD").select(*KEY))

    #: Operations are broadcast to the base up to this number.
    FEW_OPERATIONS = 200_000

    def state(self, serial: int | None = None) -> DataFrame:
        """The set at the current version, or at a stored one with this serial."""
        held = [r for r in self._commits() if serial is None or r["serial"] == serial]
        if not held:
            raise RuntimeError("no state" if serial is None else f"no stored version has serial {serial}")
        return self._merged(held[-1])

    def publish(self, rows: DataFrame, serial: int) -> None:
        """A full load: the whole set as of a serial."""
        now = self.current()
        v = now["v"] + 1 if now else 0
        rows.select(*KEY).distinct().sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{self.folder}/base/v={v}")
        n = self.spark.read.parquet(f"{self.folder}/base/v={v}").count()
        self._commit(now, v, serial=serial, base=v, deltas=[], base_rows=n, delta_rows=0)
        self._remove_old()

    def fold(self) -> bool:
        """Merge the deltas into a new base at the same serial; False when there is none."""
        now = self.current()
        if now is None or not now["deltas"]:
            return False
        self.publish(self._merged(now), now["serial"])
        return True

    def _remove_old(self) -> None:
        held = self._commits()
        kept = held[-self.keep:]
        named = {("base", r["base"]) for r in kept} | {("delta", v) for r in kept for v in r["deltas"]} | {("commits", r["v"]) for r in kept}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for kind in ("commits", "delta", "base"):  # a commit goes before what it names
            top = hadoop(f"{self.folder}/{kind}")
            fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if not fs.exists(top):
                continue
            for f in fs.listStatus(top):
                name = f.getPath().getName()
                if name.startswith("v=") and int(name[2:]) <= held[-1]["v"] and (kind, int(name[2:])) not in named:
                    fs.delete(f.getPath(), True)

    def apply_batch(self, texts: DataFrame, batch_id: int = 0) -> bool:
        """Apply one micro-batch of feed texts (column ``text``); False when nothing was applied.

        Serials count operations on objects of every class, so continuity and the new serial come from all of them, and
        the routes among them change the state. Every serial after the state's must be there: a gap, at the start or between two
        operations, raises :class:`FeedGap` and changes nothing.
        """
        # The feed is read once: the check below and the update must see the same operations.
        texts = durable(texts.select("text"))
        now = self.current()
        have = now and now["serial"]
        every = feed_operations(texts).select("serial")
        fresh = F.col("serial") if have is None else F.when(F.col("serial") > have, F.col("serial"))
        span = every.agg(F.min(fresh).alias("lo"), F.max(fresh).alias("hi"), F.count_distinct(fresh).alias("n"), F.count_if(F.col("serial").isNull()).alias("odd")).first()
        if span["odd"]:
            raise RuntimeError(f"{span['odd']} operations have no serial, and the feed's start names no range")
        if span["hi"] is None:
            return False
        if not can_apply(have, span["lo"] - 1, span["hi"], self.limit):
            raise FeedGap(f"feed starts at {span['lo']}, state is at {have}: load the full dump")
        if span["n"] != span["hi"] - have:
            raise FeedGap(f"{span['hi'] - have - span['n']} of the operations {have + 1} to {span['hi']} are missing: load the full dump")
        v = now["v"] + 1
        ops = delta_operations(texts).where(F.col("serial") > have).withColumn("at", F.struct("serial", "ord"))
        last = ops.groupBy(*KEY).agg(F.max_by("op", "at").alias("op"), F.max("serial").alias("serial"))
        path = f"{self.folder}/delta/v={v}"
        last.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).count() + now["delta_rows"]
        self._commit(now, v, serial=span["hi"], base=now["base"], deltas=[*now["deltas"], v], base_rows=now["base_rows"], delta_rows=rows)
        if len(now["deltas"]) + 1 >= self.most_deltas or rows > self.fold_at * max(1, now["base_rows"]):
            self.fold()
        return True

    def catch_up(self, texts: DataFrame, full_load: Callable[[], tuple[DataFrame, int]]) -> str:
        """Apply the feed where it continues the state; otherwise load the full set and apply what of the feed follows it.

        ``full_load`` gives the rows of a dump and the dump's serial. Returns ``delta``, ``full`` or ``none``.
        """
        texts = durable(texts.select("text"))
        try:
            return "delta" if self.apply_batch(texts) else "none"
        except FeedGap:
            self.publish(*full_load())
        try:
            self.apply_batch(texts)
        except FeedGap:  # the feed ends before the dump's serial, or begins after it: the dump stands
            pass
        return "full"

    def stream(self, source: str, checkpoint: str):
        """Start applying feed files as they appear; ends when none is left."""
        texts = self.spark.readStream.text(source, wholetext=True).select(F.col("value").alias("text"))
        return (texts.writeStream.foreachBatch(lambda df, i: self.apply_batch(df, i)).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def dump_serial(spark: SparkSession, path: str) -> int | None:
    """The serial in the one-line file beside a full dump, or None."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s*$", 1).try_cast("bigint").alias("n")).where("n IS NOT NULL").limit(1).collect()
    return found[0]["n"] if found else None

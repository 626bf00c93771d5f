"""Measurements that arrive round by round. The functions work on batch and streaming frames alike.

A poll repeats what earlier polls have shown, so rounds and hops are told once by their key. In a stream with a time column that is the
same in every repeat (``ts``: when the round or the measurement was made), what is remembered is bounded by default: a key
is forgotten when the watermark has passed its time by ``delay``, and a repeat that comes later still is older than the
watermark and is dropped as late. So each round counts once, however late it is repeated, as long as its first showing is
at most ``delay`` behind the newest one; a first showing that is later than that is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.measure import merge_ping

FINISHED = ["finished", "failed"]
#: How long rounds and hops may be behind the newest one.
DELAY = "6 hours"


def once(rows: DataFrame, key: list[str], delay: str | None = DELAY, ts: str = "ts") -> DataFrame:
    """One row per key. A stream without the time column, or with ``delay=None``, remembers every key."""
    if not rows.isStreaming or delay is None or ts not in rows.columns:
        return rows.dropDuplicates(key)
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def finished_rounds(rounds: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Each (probe, round) once, when it has finished or failed."""
    return once(rounds.where(F.col("status").isin(FINISHED)), ["probe", "round"], delay)


def running_ping(rounds: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Statistics per probe over all rounds so far; a replayed round changes nothing. The result keeps one row per probe."""
    return merge_ping(finished_rounds(rounds, delay))


def new_hops(hops: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Hops not reported before; later polls repeat the earlier ones."""
    return once(hops, ["measurement", "probe", "ttl"], delay)

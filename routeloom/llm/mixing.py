"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 and 1, normalised. The exponent is bisected to
meet a target entropy, or is the smallest one at which no source is repeated more often than a limit. A source's quota is
weight * budget tokens: as many whole passes over its documents as fit, then part of one more. Every pass deals the same
blocks of documents in another order; the last one ends within a block at the row where the quota is reached.

A null source is a source of its own. Null and empty texts have no tokens; they are drawn with whole passes and within
the part of a pass that is drawn. Repeated rows are drawn like any others. An empty table, or one without any token,
gives no rows.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

TOKEN = r"[^\x20\x09-\x0D]+"
#: Documents in a block, about.
BLOCK_ROWS = 2_000
MAX_REPEATS = 4.0


def shares(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised powers of the token shares; a source without tokens has none."""
    p = np.where(tokens > 0, np.power(np.maximum(tokens, 1) / max(tokens.sum(), 1), exponent), 0.0)
    return p / p.sum() if p.sum() else p


def entropy(p: np.ndarray) -> float:
    q = p[p > 0]
    return float(-(q * np.log(q)).sum())


def exponent_for(tokens: np.ndarray, budget: float, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """Bisect: entropy falls and the largest repetition falls as the exponent grows from 0 to 1."""

    def flat_enough(a: float) -> bool:
        p = shares(tokens, a)
        if target_entropy is not None:
            return entropy(p) <= target_entropy
        return bool((p * budget <= max_repeats * tokens * (1 + 1e-12)).all())

    if flat_enough(0.0) or (target_entropy is None and max_repeats is None):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if flat_enough(mid) else (mid, hi)
    return hi


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
        block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """Drawn rows: every column of ``docs`` with mix_pass (from 1), mix_block, mix_place (of the block in its pass), mix_tokens.

    Read in the order (mix_pass, mix_place, a hash of the row) the rows of a source are its permutation. ``budget`` is in
    tokens, all tokens of the input by default. One row per source reaches the driver.
    """
    own = [c for c in docs.columns if c.lower() not in ("mix_pass", "mix_block", "mix_place", "mix_tokens", "mix_order", "mix_blocks", "mix_quota")]
    d = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("mix_tokens", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKEN)).cast("bigint"))
    lean = d.select("source", "mix_tokens")
    totals = lean.groupBy("source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is not None, str(r["source"])))
    tokens = np.array([r["tokens"] for r in totals], np.float64)
    if not tokens.sum():
        return d.limit(0).selectExpr(*[f"`{c}`" for c in own], "0L AS mix_pass", "0L AS mix_block", "0L AS mix_place", "mix_tokens")
    spend = float(tokens.sum() if budget is None else budget)
    weight = shares(tokens, exponent_for(tokens, spend, target_entropy, max_repeats))
    plan = []
    for r, w in zip(totals, weight):
        quota = floor(w * spend + 1e-6)
        whole = quota // r["tokens"] if r["tokens"] else 0
        plan.append((r["source"], max(1, ceil(r["rows"] / block_rows)), int(whole), int(quota - whole * r["tokens"])))
    spark = docs.sparkSession
    # As many rows as sources.
    quotas = F.broadcast(spark.createDataFrame(plan, "mix_source string, mix_blocks bigint, mix_whole bigint, mix_rest bigint"))
    same = F.col("source").cast("string").eqNullSafe(F.col("mix_source"))

    def dealt(frame: DataFrame) -> DataFrame:
        """Block of each row by a hash of its id and text, so equal input gives equal blocks whatever its order."""
        key = F.xxhash64(F.lit(seed), "doc_id", "text")
        return frame.join(quotas, same).withColumn("mix_order", key).withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed + 1), key), F.col("mix_blocks")))

    def in_pass(place: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), place, "mix_block")

    by_block = ["mix_source", "mix_block"]
    blocks = dealt(d).groupBy(*by_block, "mix_whole", "mix_rest").agg(F.sum("mix_tokens").alias("held"))
    blocks = blocks.select(*by_block, "mix_whole", "mix_rest", "held", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_whole") + 1)).alias("mix_pass"))
    order = W.partitionBy("mix_source", "mix_pass").orderBy(in_pass(F.col("mix_pass")), "mix_block")
    blocks = blocks.withColumn("mix_place", F.row_number().over(order).cast("bigint")).withColumn("before", F.sum("held").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("held"))
    full = F.col("mix_pass") <= F.col("mix_whole")
    blocks = blocks.where(full | (F.col("before") < F.col("mix_rest"))).select(
        *by_block, "mix_pass", "mix_place", F.when(~full & (F.col("before") + F.col("held") > F.col("mix_rest")), F.col("mix_rest") - F.col("before")).alias("mix_quota"))
    drawn = dealt(d).drop("mix_whole", "mix_rest", "mix_blocks").join(
        blocks.withColumnsRenamed({"mix_source": "b_source", "mix_block": "b_block"}), F.col("mix_source").eqNullSafe(F.col("b_source")) & (F.col("mix_block") == F.col("b_block")))
    drawn = drawn.drop("b_source", "b_block", "mix_source")
    # Only the block in which a source's quota ends is walked row by row; it holds about block_rows rows.
    last = drawn.where(F.col("mix_quota").isNotNull())
    upto = F.sum("mix_tokens").over(W.partitionBy("source", "mix_block").orderBy("mix_order", *[c for c in ("doc_id",) if c in own]).rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where(F.col("upto") <= F.col("mix_quota")).drop("upto")
    out = drawn.where(F.col("mix_quota").isNull()).unionByName(last)
    return out.select(*[F.col(f"`{c}`") for c in own], "mix_pass", "mix_block", "mix_place", "mix_tokens")

"""Approximate nearest neighbours by multi-index hashing: rotated binary codes cut into substrings, each indexed.

Codes come from principal axes and a rotation learnt on a bounded sample (iterative quantisation). A code within a Hamming
radius r of another must agree with it up to floor(r / m) bits in one of the m substrings, so probing every substring's
buckets within that many bits retrieves all of them; the originals then give the cosine in double precision. The radius
is the one that holds ``RECALL`` of the sample's true neighbours. A query that finds fewer than k is searched again with
the radius of all codes, so every query has its k nearest found, or all candidates if there are fewer.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Equal
vectors are indexed once with their k + 1 smallest ids, which is all that can be among k nearest; a vector shared by a
third of the rows is therefore one entry. Ties go to the smaller id. Rows without an id take no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from routeloom.session import durable

#: Vectors that the rotation and the radius are fitted on, chosen by a hash; rows and queries in a block.
SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 8_000, 4_096, 4_096
RECALL, SUBSTRING = 0.97, 8


class Codes:
    """Centre, projection and radius; codes are arrays of 8-bit substrings."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = unit.mean(0)
        z = unit - self.centre
        _, axes = np.linalg.eigh(z.T @ z)
        bits = max(SUBSTRING, z.shape[1] // SUBSTRING * SUBSTRING)
        bits = min(bits, 256)
        rng = np.random.default_rng(seed)
        if z.shape[1] >= bits:
            axes = axes[:, ::-1][:, :bits]
            p, turn = z @ axes, np.linalg.qr(rng.normal(size=(bits, bits)))[0]
            for _ in range(30):
                left, _, right = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
                turn = (left @ right).T
            self.projection = axes @ turn
        else:  # fewer dimensions than one substring has bits
            self.projection = rng.normal(size=(z.shape[1], bits))
        self.bits, self.parts = bits, bits // SUBSTRING
        self.radius = bits
        if len(unit) > 2 * k:
            code = self.encode(sample)
            asked = np.arange(0, len(unit), max(1, len(unit) // 300))
            near = unit[asked] @ unit.T
            near[np.arange(len(asked)), asked] = -9
            top = np.argpartition(-near, k, axis=1)[:, :k]
            gaps = np.bitwise_count(code[asked][:, None, :] ^ code[top]).sum(2)
            self.radius = int(np.quantile(gaps, RECALL, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.centre) @ self.projection > 0, axis=1)


def _masks(most: int) -> np.ndarray:
    """All 8-bit differences of at most so many bits."""
    return np.array([sum(1 << b for b in c) for n in range(min(most, SUBSTRING) + 1) for c in combinations(range(SUBSTRING), n)], np.uint8)


def search_block(codes: Codes, radius: int, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the best k rows of a block within the radius, through the substring buckets of the block."""
    row_codes, query_codes = codes.encode(rows), codes.encode(queries)
    masks = _masks(radius // codes.parts)
    row_norm, query_norm = np.sqrt((rows * rows).sum(1)), np.sqrt((queries * queries).sum(1))
    buckets = []
    for j in range(codes.parts):
        order = np.argsort(row_codes[:, j], kind="stable")
        ends = np.searchsorted(row_codes[order, j], np.arange(257))
        buckets.append((order, ends, {}))
    out_q, out_r, out_s = [], [], []
    for q, code in enumerate(query_codes):
        hit = np.zeros(len(rows), bool)
        for j, (order, ends, probed) in enumerate(buckets):
            c = int(code[j])
            if c not in probed:
                probed[c] = np.concatenate([order[ends[v]:ends[v + 1]] for v in (masks ^ np.uint8(c)).astype(int)])
            hit[probed[c]] = True
        found = np.flatnonzero(hit)
        found = found[np.bitwise_count(row_codes[found] ^ code).sum(1) <= radius]
        if not len(found):
            continue
        score = (rows[found] * queries[q]).sum(1) / (row_norm[found] * query_norm[q])
        best = np.lexsort((found, -score))[:k]
        out_q.append(np.full(len(best), q))
        out_r.append(found[best])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two just above their largest component: the cosine stays as it is, and no square over- or underflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    a = col.combine_chunks()
    values = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return scaled(values.reshape(len(a), -1)) if len(a) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``queries``, a condition on vec_id, selects, against all rows."""
    x = F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return v.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    v = v.where(F.size("v") == size["n"])
    ranked = v.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    index = durable(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sample = index.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(SAMPLE).toPandas()["v"]
    codes = Codes(scaled(np.stack(sample.to_numpy()).astype(np.float64)), k)
    asked = v.where(queries)
    keys = durable(asked.groupBy("v").agg(F.min("vec_id").alias("key")))
    found = durable(_in_blocks(index, keys, codes, codes.radius, k))
    short = keys.join(found.groupBy("key").agg(F.sum(F.size("ids")).alias("n")), "key", "left").where(F.coalesce("n", F.lit(0)) < k + 1).select("v", "key")
    short = durable(short)
    if short.limit(1).count():  # fewer than k within the radius: all codes
        found = found.join(short.select("key"), "key", "left_anti").unionByName(_in_blocks(index, short, codes, codes.bits, k))
    best = W.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    each = asked.join(keys, "v").select(F.col("vec_id").alias("query_id"), "key").join(found, "key")
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _in_blocks(index: DataFrame, keys: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    """Best k + 1 entries per query key and block of rows; every pair of blocks is one group of bounded size."""
    n_rows, n_keys = -(-max(1, index.count()) // BLOCK_ROWS), -(-max(1, keys.count()) // BLOCK_QUERIES)

    def spread(d: DataFrame, mine: str, n_mine: int, other: str, n_other: int) -> DataFrame:
        return d.withColumn(mine, F.pmod(F.xxhash64("v"), F.lit(n_mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = spread(index, "r", n_rows, "q", n_keys).groupBy("r", "q")
    right = spread(keys, "q", n_keys, "r", n_rows).groupBy("r", "q")

    def block(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        order = np.argsort([x[0] for x in rows.column("ids").to_pylist()], kind="stable")
        q, r, s = search_block(codes, radius, _matrix(rows.column("v"))[order], _matrix(queries.column("v")), k + 1)
        return pa.table({"key": queries.column("key").take(pa.array(q)), "score": pa.array(s), "ids": rows.column("ids").take(pa.array(order[r]))})

    return left.cogroup(right).applyInArrow(block, "key bigint, score double, ids array<bigint>")

"""Exact dedup by distributed MSD radix partitioning: documents are split by their length and then by successive runs of
their bytes until a group holds one document or its texts have ended. Texts are compared byte by byte; no digest decides.

A node of the radix tree is (length in bytes, text so far). Level by level only nodes that outweigh a task are split on
the cluster: counts of the next run of characters fold before they move, and rows themselves stay where they are. A heavy
node whose texts have ended is a group already and its rows are answered from its counts, so a text that a third of all
rows share never moves. All other rows move once, to the bucket of their lightest node, where the same splitting goes on
in memory. Heavy nodes weigh more than ``node_bytes`` (or a 200th of the input), which bounds their number by the input;
they are broadcast only while few and short, and joined otherwise.

Texts are equal when identical after folding A to Z; a null text counts as empty and all empty texts are one group. The
largest doc_id of a group stays; a null id stays only where no row of the group has an id. Rows that repeat id and text are
one document and are answered alike. One id may have several texts, in a group each. A very long text is one row of its
bucket and is cut into slices of 64 KB at most. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from routeloom.session import durable

from .common import FOLD, LOWER, UPPER, flat, texts

#: Characters of the first run; each level looks four times as far.
FIRST, GROWTH = 64, 4
#: Bytes of a bucket, on average, and of a node that a bucket may take whole.
BUCKET_BYTES, NODE_BYTES = 4 << 20, 16 << 20
#: In a small input nodes are heavy from a 200th of it on, but not below this.
LEAST_BYTES = 1 << 18
#: Nodes are broadcast up to this number and this many bytes of text.
FEW_NODES, FEW_BYTES = 20_000, 16 << 20
#: Longest slice that is compared at once in a bucket.
SLICE = 1 << 16

_OUT = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


def split(raw: bytes, offsets: list[int], first: int = FIRST) -> Iterator[list[int]]:
    """Groups of equal texts: by length, then by successive slices, until one text is left or the texts have ended."""
    sizes: dict[int, list[int]] = {}
    for r in range(len(offsets) - 1):
        sizes.setdefault(offsets[r + 1] - offsets[r], []).append(r)
    todo = [(rows, size, 0, first) for size, rows in sizes.items()]
    while todo:
        rows, size, at, width = todo.pop()
        if len(rows) == 1 or at >= size:
            yield rows
            continue
        stop, children = min(size, at + width), {}
        for r in rows:
            children.setdefault(raw[offsets[r] + at:offsets[r] + stop], []).append(r)
        todo += [(own, size, stop, min(width * 4, SLICE)) for own in children.values()]


def _bucket(rows: pa.Table) -> pa.Table:
    raw, offs = flat(rows.column("text"))
    raw, offs = FOLD[raw[offs[0]:offs[-1]]].tobytes(), (offs - offs[0]).tolist()
    ids, n = rows.column("doc_id").to_pylist(), rows.num_rows
    keep, size, digest = [None] * n, [0] * n, [""] * n
    for own in split(raw, offs):
        best = max((ids[r] for r in own if ids[r] is not None), default=None)
        text = hashlib.sha256(raw[offs[own[0]]:offs[own[0] + 1]]).hexdigest()
        for r in own:
            keep[r], size[r], digest[r] = best, len(own), text
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "keep_id": pa.array(keep, pa.int64()), "group_size": pa.array(size, pa.int64()),
                     "kept": pa.array([a == b for a, b in zip(ids, keep)], pa.bool_()), "text_sha256": pa.array(digest, pa.string())})


def _prefix(level: int) -> Column:
    """Text so far at a level."""
    return F.translate(F.substring("text", 1, FIRST * GROWTH ** level), UPPER, LOWER)


def _known(rows: DataFrame, level: int, nodes: DataFrame, few: bool, how: str) -> DataFrame:
    """Rows joined with the heavy nodes of a level."""
    keys = [f"size_{level}", f"text_{level}"]
    named = nodes.withColumnsRenamed({"size": keys[0], "so_far": keys[1]})
    rows = rows.withColumns({keys[0]: F.col("size"), keys[1]: F.when(F.col("heavy") == level, _prefix(level))})
    return rows.join(F.broadcast(named) if few else named, keys, how)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, node_bytes: int = NODE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the folded text)."""
    rows = texts(docs, id_col, text_col).withColumn("size", F.octet_length("text"))
    total = rows.agg(F.sum(F.col("size").cast("bigint") + FIRST)).first()[0] or 0
    limit = min(node_bytes, max(LEAST_BYTES, total // 200))
    # ``heavy`` counts the levels at which a row's node was heavy: the row's next node is the one at that level.
    at, levels, answered = rows.withColumn("heavy", F.lit(0)), [], None
    while True:
        level = len(levels)
        nodes = at.where(F.col("heavy") == level).groupBy("size", _prefix(level).alias("so_far")).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        nodes = durable(nodes.where((F.col("group_size") > 1) & ((F.col("size") + FIRST) * F.col("group_size") > limit)))
        seen = nodes.agg(F.count(F.lit(1)), F.sum(F.octet_length("so_far")), F.count(F.when(F.octet_length("so_far") < F.col("size"), 1))).first()
        if not seen[0]:
            break
        few = seen[0] <= FEW_NODES and (seen[1] or 0) <= FEW_BYTES
        levels.append(nodes)
        over = _known(at, level, nodes, few, "left").withColumn("ended", F.octet_length(f"text_{level}") == F.col("size"))
        done = over.where("group_size IS NOT NULL AND ended").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2(f"text_{level}", 256).alias("text_sha256"))
        answered = done if answered is None else answered.unionByName(done)
        heavy = F.when(F.col("group_size").isNotNull() & F.col("ended"), -1).when(F.col("group_size").isNotNull(), level + 1).otherwise(F.col("heavy"))
        at = over.select("doc_id", "text", "size", heavy.alias("heavy"))
        if not seen[2]:
            break
    leaf = F.lit(None).cast("string")
    for level in reversed(range(len(levels) + 1)):
        leaf = F.when(F.col("heavy") == level, _prefix(level)).otherwise(leaf)
    n = max(1, total // bucket_bytes)
    light = at.where("heavy >= 0").select("doc_id", "text", F.pmod(F.xxhash64("size", leaf), F.lit(n)).alias("bucket"))
    found = light.groupBy("bucket").applyInArrow(_bucket, _OUT)
    return found if answered is None else found.unionByName(answered)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays."""
    mark, own = "_radix_sha", F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), 256)
    kept = groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_radix_id"), F.col("text_sha256").alias("_radix_kept"))
    d = docs.withColumn(mark, own)
    d = d.join(kept, F.col(id_col).cast("bigint").eqNullSafe(F.col("_radix_id")) & (F.col(mark) == F.col("_radix_kept")), "left_semi")
    return d.dropDuplicates([id_col, mark]).drop(mark)

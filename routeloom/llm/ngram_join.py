"""N-gram Jaccard join with several global orders.

Sets are the distinct 5-word shingles of a text, as 64-bit hashes. Two sets that reach the threshold share a token among
the first n - ceil(t n) + 1 of each in *any* order of all tokens, and a larger prefix must share more. Documents first
pass a filter on a hash order, which drops those without enough shared tokens; the rest are ordered by rising document
frequency with ties by several hashes, and a candidate pair must share a prefix token in every one of these orders before
its sets are compared.

Links are then counted within each component, since no link leaves one: the sets of two blocks of its classes are
compared in one task, which returns a count per class and no pairs. n_links is thus the number of all classes that reach
the threshold; its work grows with the square of a component.

Equal sets are one class, represented by the smallest id. Within a block of classes that share a token the classes are
compared with a few pivots first; only classes that remain in different components are then compared with each other, so
a large group of near copies costs a star and not all pairs. Null and empty texts have an empty set and link with
nothing. Repeated rows link; rows without an id are left out of the links and get their own row with a null component.
An id with several texts is several documents, each with its own set and links; component_id is then still the smallest id reached.
A very long text is one array of 8 bytes a shingle; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from routeloom.session import durable

from .common import BROADCAST_IDS, flat, hashed_words, mix, semi, texts
from .components import components

N_WORDS, PERCENT = 5, 80
#: Orders that every candidate must pass, and pivots tried in each block before its other pairs.
ORDERS, PIVOT_ROUNDS = 3, 3
#: Tokens of the classes in one block of a component, about; a class counts as LEAST_TOKENS at least, which bounds a block's classes.
BLOCK_TOKENS, LEAST_TOKENS = 1 << 17, 256
#: Tokens compared at once within two blocks.
SLAB = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n_words: int = N_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, a text at a time; a shorter text is one shingle, a text without words has none."""
    for i, j, word, first in hashed_words(raw, offs):
        gram = word
        if len(word) >= n_words:
            gram = word[:len(word) - n_words + 1].copy()
            for k in range(1, n_words):
                gram = gram * _GRAM + word[k:k + len(gram)]
            gram = mix(gram)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= n_words:
                yield np.unique(gram[a:b - n_words + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for x in word[a:b]:
                    whole = np.uint64((int(whole) * int(_GRAM) + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: Column, percent: int = PERCENT) -> Column:
    """Smallest overlap with any set: ceil(t n)."""
    return F.floor((n * percent + 99) / 100)


def _sets(docs: DataFrame, n_words: int, whole: bool, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, low, high, head or tokens): set size, a 128-bit digest of the set, and its hash-order head or all of it."""
    name = "tokens" if whole else "head"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, low, high, kept, sizes = [], [], [], [], []
            for s in shingle_sets(*flat(b.column("text")), n_words):
                n.append(len(s))
                low.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                high.append(int(mix(s ^ _BASE).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                if not whole:  # the sorted hashes are the hash order
                    m = len(s) - (len(s) * percent + 99) // 100
                    s = s[:m + 1 + _slack(len(s))]
                kept.append(s.view(np.int64))
                sizes.append(len(s))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists], names=["doc_id", "n", "low", "high", name])

    return docs.mapInArrow(rows, f"doc_id bigint, n int, low bigint, high bigint, {name} array<bigint>")


def _slack(n: int) -> int:
    """Tokens by which the hash-order head is longer than the plain prefix; so many more must then be shared."""
    return n // 20


def _can_reach(n_a: str, k_a: str, n_b: str, k_b: str, percent: int) -> Column:
    """Whether sets of n tokens, of which k are in other sets at all, can overlap enough."""
    most = F.least(k_a, k_b)
    return most * 100 >= (F.col(n_a) + F.col(n_b) - most) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate (a, b) that pass every order's prefix filter and then the exact comparison."""
    heads = [f"p{i}" for i in range(1, ORDERS)]  # the pairs come from the blocks of the first order
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), *[F.col(h).alias(f"{h}_a") for h in heads]), "a")
    x = x.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), *[F.col(h).alias(f"{h}_b") for h in heads]), "b")
    x = x.where(_can_reach("n_a", "k_a", "n_b", "k_b", percent))
    for h in heads:
        x = x.where(F.arrays_overlap(f"{h}_a", f"{h}_b"))
    x = x.select("a", "b", "n_a", "n_b").join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("t_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t_b")), "b")
    x = x.withColumn("both", F.size(F.array_intersect("t_a", "t_b")))
    return x.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b", "both")


def survivors(heads: DataFrame) -> DataFrame:
    """Ids whose hash-order head shares as many tokens with other sets as any partner would need to share with it."""
    each = heads.select("doc_id", F.explode("head").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    met = each.join(shared, "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return met.join(heads.select("doc_id", "n").distinct(), "doc_id").where(F.col("hits") >= F.floor(F.col("n") / 20) + 1).select("doc_id").distinct()


def told_apart(docs: DataFrame) -> DataFrame:
    """All rows with an id and their ``row_id``: the id, or a hash of id and text where the id has several texts."""
    d = docs.where("doc_id IS NOT NULL")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    several = d.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id")
    several = durable(several)
    own = F.col("doc_id").cast("bigint")
    if several.isEmpty():
        return d.withColumn("row_id", own)
    marked = several.select(F.col("doc_id").alias("_several"))
    few = marked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d = d.join(F.broadcast(marked) if few else marked, F.col("doc_id") == F.col("_several"), "left")
    return d.withColumn("row_id", F.when(F.col("_several").isNull(), own).otherwise(F.xxhash64("doc_id", text))).drop("_several")


def links(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, sets): documents are (doc_id, n, class_id) for every row with an id; links are (a, b, both) between
    class ids and join the same classes as all links together do; sets has (doc_id, n, tokens) of every class in a link."""
    d = texts(docs).where("doc_id IS NOT NULL")
    heads = durable(_sets(d, n_words, False, percent))
    classes = heads.where("n > 0").groupBy("n", "low", "high").agg(F.min("doc_id").alias("class_id"))
    members = durable(heads.select("doc_id", "n", "low", "high").join(classes, ["n", "low", "high"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")))
    firsts = members.where("n > 0 AND doc_id = class_id").select("doc_id").distinct()
    left = durable(survivors(semi(heads, firsts, "doc_id").where("n > 0")))
    sets = _ordered(durable(_sets(semi(d, left, "doc_id"), n_words, True).dropDuplicates(["doc_id"])), percent)
    blocks = sets.select("doc_id", F.posexplode("p0").alias("at", "token"))
    common = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    blocks = durable(blocks.join(common, "token"))
    state, tried, used, found, part = blocks.withColumn("part", F.col("doc_id")), None, None, None, None
    for _ in range(PIVOT_ROUNDS):
        # A class meets one pivot: the smallest class of its blocks outside the components that pivots of these blocks had before.
        open_ = state if tried is None else state.join(tried, ["token", "part"], "left_anti")
        pivots = open_.groupBy("token").agg(F.min(F.struct("part", "doc_id")).alias("pivot"))
        meets = open_.join(pivots, "token").where("part <> pivot.part").groupBy("doc_id").agg(F.min("pivot").alias("pivot")).select("doc_id", F.col("pivot.doc_id").alias("a"))
        new = durable(_verified(meets.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct(), sets, percent))
        found = new if found is None else found.unionByName(new)
        part = components(found)
        here = pivots.select("token", F.col("pivot.doc_id").alias("doc_id"))
        used = durable(here if used is None else used.unionByName(here))
        now = used.join(part, F.col("doc_id") == part.node, "left").select("token", F.coalesce("component", "doc_id").alias("part"))
        state = durable(blocks.join(part, blocks.doc_id == part.node, "left").select("doc_id", "at", "token", F.coalesce("component", "doc_id").alias("part")))
        tried = durable(now.distinct())
    # The rest: classes of one block in different components. At the first token that two sets have in common all that they
    # share is still to come in both orders, so a pair is met where the tokens left would suffice, and hardly ever twice.
    mixed = state.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    state = state.join(mixed, "token").join(sets.select("doc_id", "n", "k"), "doc_id").withColumn("k", F.col("k") - F.col("at")).drop("at")
    other = state.select("token", F.col("doc_id").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"))
    rest = state.join(other, "token").where((F.col("doc_id") < F.col("b")) & (F.col("part") != F.col("part_b")) & _can_reach("n", "k", "n_b", "k_b", percent))
    new = durable(_verified(rest.select(F.col("doc_id").alias("a"), "b").distinct(), sets, percent))
    return members, found.unionByName(new).distinct(), sets.select("doc_id", "n", "tokens")


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets of ``a`` and ``b`` (distinct tokens each) reach the threshold, as a matrix."""
    n_a, n_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
    common = np.intersect1d(all_a, all_b)

    def placed(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
        held = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        order = np.argsort(at[held], kind="stable")
        return at[held][order], row[held][order]

    (at_a, row_a), (at_b, row_b) = placed(all_a, row_a), placed(all_b, row_b)
    both = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, len(common), SLAB):
        x, y = np.zeros((len(a), SLAB), np.float32), np.zeros((len(b), SLAB), np.float32)
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            i, j = np.searchsorted(at, (lo, lo + SLAB))
            m[row[i:j], at[i:j] - lo] = 1
        both += x @ y.T
    return both * 100 >= (n_a[:, None] + n_b[None, :] - both) * percent


def degrees(part: DataFrame, sets: DataFrame, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(node, n_links): how many other classes each class of a component reaches the threshold with."""
    d = durable(part.join(sets, F.col("node") == F.col("doc_id")).select("component", "node", "n", "tokens"))
    size = d.groupBy("component").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST_TOKENS))) / block_tokens).cast("int").alias("blocks"))
    # Components of several blocks: at most all tokens / block_tokens of them.
    d = d.join(F.broadcast(size.where("blocks > 1")), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    d = d.select("component", "node", "tokens", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    d = d.select("component", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), (F.col("block") > F.col("with")).alias("right"), "node", "tokens")
    d = d.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def counted() -> pa.RecordBatch:
            (left, right), (component, lo, hi) = sides, key
            nodes, n = [], []
            if lo == hi and left:
                m = linked([t for _, t in left], [t for _, t in left], percent)
                np.fill_diagonal(m, False)
                nodes, n = [x for x, _ in left], m.sum(1)
            elif left and right:
                m = linked([t for _, t in left], [t for _, t in right], percent)
                nodes, n = [x for x, _ in left + right], np.concatenate((m.sum(1), m.sum(0)))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n_links"])

        for b in batches:
            tokens = b.column("tokens")
            ends, flat_tokens = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            rows = zip(*(b.column(c).to_pylist() for c in ("component", "lo", "hi", "right", "node")))
            for i, (component, lo, hi, right, node) in enumerate(rows):
                if key != (component, lo, hi):
                    if key is not None:
                        yield counted()
                    key, sides = (component, lo, hi), ([], [])
                sides[right].append((node, flat_tokens[ends[i]:ends[i + 1]].copy()))
        if key is not None:
            yield counted()

    return d.mapInArrow(count, "node bigint, n_links bigint").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Sets with the prefixes p0, p1, ... under orders by (document frequency, a hash of the token); tokens of one set only
    fill the prefix but are left out of it, since they can't be shared. p0 holds tokens and makes the blocks; the others are
    only compared, as 32-bit hashes, for which a false match costs a comparison and nothing else."""
    each = sets.select("doc_id", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = each.join(often, "token").groupBy("doc_id").agg(F.collect_list(F.struct("df", "token")).alias("known"))
    # k: how many tokens of a set are in others too; no two sets share more than the smaller k.
    x = sets.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    room = F.col("n") - needed(F.col("n"), percent) + 1 - (F.col("n") - F.size("known"))
    room = F.greatest(room, F.lit(0)).cast("int")
    x = x.withColumn("k", F.size("known"))
    for i in range(ORDERS):
        order = F.array_sort(F.transform("known", lambda s: F.struct(s["df"].alias("df"), F.xxhash64(F.lit(i), s["token"]).alias("h"), s["token"].alias("token"))))
        x = x.withColumn(f"p{i}", F.transform(F.slice(order, F.lit(1), room), lambda s: s["token"] if i == 0 else F.hash(s["token"])))
    return durable(x.where(F.size("p0") > 0).drop("known"))


def parts(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, (node, component) of every class in a link, sets)."""
    members, found, sets = links(docs, n_words, percent)
    return members, components(found), sets


def kept_rows(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns, and the rows without an id; of repeated rows one stays."""
    d = told_apart(docs)
    kept = firsts(d.select(F.col("row_id").alias("doc_id"), "text"), n_words, percent).select(F.col("doc_id").alias("row_id"))
    out = d.join(kept, "row_id", "left_semi").dropDuplicates(["row_id"]).drop("row_id")
    return out.unionByName(docs.where("doc_id IS NULL"))


def firsts(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """Ids of the documents that are the smallest of their component; no links are counted for this. Ids tell texts apart."""
    members, part, _ = parts(docs, n_words, percent)
    out = members.join(part, members.class_id == part.node, "left")
    return out.where(F.col("doc_id") == F.coalesce("component", "class_id")).select("doc_id").distinct()


def groups(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, n_links (all other classes that its class reaches the threshold with)."""
    d = told_apart(docs.select("doc_id", "text"))
    members, part, sets = parts(d.select(F.col("row_id").alias("doc_id"), "text"), n_words, percent)
    degree = degrees(part, sets, percent)
    out = members.join(part, members.class_id == part.node, "left").drop("node").join(degree, F.col("class_id") == F.col("node"), "left")
    out = out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    renamed = durable(d.where("row_id <> doc_id").select("row_id", F.col("doc_id").alias("real")).distinct())
    if not renamed.isEmpty():  # ids with several texts: the ids again, and the smallest of each class and component
        out = durable(out.join(renamed, out.doc_id == renamed.row_id, "left").withColumn("doc_id", F.coalesce("real", "doc_id")).drop("row_id", "real"))
        for c in ("class_id", "component_id"):
            out = out.join(out.groupBy(F.col(c).alias("_c")).agg(F.min("doc_id").alias("_least")), F.col(c) == F.col("_c")).withColumn(c, F.col("_least")).drop("_c", "_least")
        out = out.select("doc_id", "n_shingles", "class_id", "component_id", "n_links")
    none = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(none)

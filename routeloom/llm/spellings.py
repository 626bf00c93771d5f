"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point, found as equal pairs of
trie nodes.

The vocabulary is put into two tries, one of the words and one of the reversed words, whose nodes are numbered. Cutting a word
between two code points gives the pair (node of what is before, node of what is after); skipping a code point gives such a
pair too. Two words of one length are near exactly if they share a pair by skipping at the same place; a word and one that
is shorter by one are near exactly if a skipped pair of the longer is a cut pair of the shorter. Numbers stand for whole prefixes and
suffixes, so equal pairs need no further check. A pair holds one word as cut and, as skipped, one word for each code point that can
stand in the gap, so a group is bounded by the alphabet (90 for the words read here). Only counts and the best neighbour of each word
leave a group; links are not written out.

Numbering follows the sorted words: range partitions of bounded size are numbered on their own, in order, and one row for
each partition (first word, last word and its nodes) tells which leading nodes its neighbour has numbered already. Node
numbers ascend with the sorted words, so they also break ties in code-point order.

Words come from whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z folded. A null text has no words; a null id
counts as empty text in the hash that edits a run; rows that repeat are counted each. The work of a long run grows with its
length, not its square. Only id and text are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from routeloom.operators.ordered import PART, pin
from routeloom.session import durable

from .common import LOWER, UPPER, texts

RUN = "[a-zÀ-ÿ]"
#: Least code points and occurrences of a word; one run in so many is edited.
MIN_CHARS, MIN_COUNT, EDITED = 5, 3, 97
#: Words of a range partition.
PART_WORDS = 50_000
#: Links are broadcast up to this number, and words up to so many bytes.
BROADCAST_IDS = 250_000
BROADCAST_BYTES = 16 << 20


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, edited: int | None = EDITED) -> DataFrame:
    """(word, n): distinct words and their occurrences. With ``edited``, a run whose crc32 with its document's id that number divides loses one code point."""
    # A run that is too short stays too short, so it is not taken out at all.
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))
    each = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("word"))
    if edited:
        h = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        place = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        each = each.select(F.when(h % edited == 0, cut).otherwise(F.col("word")).alias("word"))
        each = each.where(F.length("word") >= min_chars)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _number(rows: pa.Table) -> pa.Table:
    """Nodes of each word's prefixes, numbered from 1 in the order in which the sorted words reach them."""
    part, held = rows.column(PART)[0].as_py(), sorted(rows.column("key").to_pylist())
    paths, path, last, before = [], [], 0, ""
    for w in held:
        same, most = 0, min(len(w), len(before))
        while same < most and w[same] == before[same]:
            same += 1
        path = path[:same] + list(range(last + 1, last + 1 + len(w) - same))
        last += len(w) - same
        paths.append(path)
        before = w
    return pa.table({PART: pa.array([part] * len(held), pa.int32()), "key": pa.array(held, pa.string()), "path": pa.array(paths, pa.list_(pa.int64()))})


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nodes(keys: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(key, path): the trie nodes of every distinct key, from the root (0) to the key itself. Keys are not empty."""
    spark = keys.sparkSession
    n = max(1, -(-keys.count() // part_words))
    local = durable(pin(keys.select("key"), "key", parts=n).groupBy(PART).applyInArrow(_number, f"{PART} int, key string, path array<bigint>"))
    # One row for each range partition: bounded by the vocabulary over ``part_words``.
    ends = local.groupBy(PART).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path"), F.max(F.element_at("path", -1)).alias("n"))
    base, word, path, rows = 0, "", [], []
    for r in sorted(ends.collect(), key=lambda r: r[PART]):
        known = path[:_shared(word, r["first"])]  # the first word's leading nodes, which have the numbers 1, 2, ... here
        rows.append((r[PART], base, known))
        path = [known[x - 1] if x <= len(known) else base + x for x in r["path"]]
        word, base = r["last"], base + r["n"]
    edges = spark.createDataFrame(rows, f"{PART} int, base bigint, known array<bigint>")
    final = F.transform("path", lambda x: F.when(x <= F.size("known"), F.get("known", (x - 1).cast("int"))).otherwise(x + F.col("base")))
    return local.join(F.broadcast(edges), PART).select("key", F.concat(F.array(F.lit(0).cast("bigint")), final).alias("path"))


def _pairs() -> Column:
    """Structs (before, after, skip, lead) of a word's cuts and skips; of a run of equal code points only the last skip leads to a shorter word."""
    chars, size = F.split("word", ""), F.length("word")

    def after(n: Column) -> Column:
        return F.get("back", n)

    def pair(i: Column, rest: Column, skip: Column, lead: Column) -> Column:
        return F.struct(F.get("ahead", i).alias("before"), after(rest).alias("after"), skip.alias("skip"), lead.alias("lead"))

    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, F.lit(False), F.lit(False)))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, size - i - 1, F.lit(True), ~F.get(chars, i).eqNullSafe(F.get(chars, i + 1))))
    return F.concat(cuts, skips)


def near(vocabulary: DataFrame, part_words: int = PART_WORDS) -> tuple[DataFrame, DataFrame]:
    """((id, word, n), (id, n_near, best)): words with the number that sorts them, and for those with a near word how many they have and
    the struct (-n, id) of the most frequent, ties to the smaller word."""
    held = durable(vocabulary.select("word", "n"))
    ahead = nodes(held.select(F.col("word").alias("key")), part_words).select(F.col("key").alias("word"), F.col("path").alias("ahead"))
    back = nodes(held.select(F.reverse("word").alias("key")), part_words).select(F.reverse("key").alias("word"), F.col("path").alias("back"))
    both = held.join(ahead, "word").join(back, "word").withColumn("id", F.element_at("ahead", -1))
    # A word makes some twenty pairs: few words a task keep the tasks alike whatever the size of the vocabulary's files.
    both = durable(both.repartition(max(1, -(-held.count() // (part_words // 2))), "id"))
    each = both.select((-F.col("n")).alias("rank"), "id", F.explode(_pairs()).alias("at")).select("rank", "id", "at.*")
    # A group is bounded by the alphabet, so its members may lie in one array.
    groups = each.groupBy("before", "after").agg(F.collect_list(F.struct("rank", "id", "skip", "lead")).alias("own")).where(F.size("own") > 1)

    def others(x: Column) -> Column:
        return F.filter("own", lambda y: F.when(x["skip"], F.when(y["skip"], y["id"] != x["id"]).otherwise(x["lead"])).otherwise(y["skip"] & y["lead"]))

    def told(x: Column) -> Column:
        them = others(x)
        return F.struct(x["id"].alias("id"), F.size(them).alias("n_near"), F.array_min(F.transform(them, lambda y: F.struct(y["rank"].alias("rank"), y["id"].alias("id")))).alias("best"))

    found = groups.select(F.explode(F.transform("own", told)).alias("x")).select("x.*").where("n_near > 0")
    return both.select("id", "word", "n"), found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _with(rows: DataFrame, few: bool, other: DataFrame, key: str) -> DataFrame:
    """Left join with a side that is unique on the key, broadcast only when counted as small."""
    return rows.join(F.broadcast(other) if few else other, key, "left")


def variants(vocabulary: DataFrame, factor: int = 2, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``vocabulary`` (word, n; distinct words, not empty).

    A word's form is its most frequent near word if that is ``factor`` times as frequent; the root ends the chain of forms.
    """
    held, found = near(vocabulary, part_words)
    named = F.when(-F.col("best.rank") >= factor * F.col("n"), F.col("best"))
    told = held.join(found, "id", "left").withColumn("named", named)
    told = durable(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("named.id").alias("form_id"), (-F.col("named.rank")).alias("form_n")))
    # Each round doubles the steps along a chain; n grows by the factor at each step, so chains are short.
    links = told.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id"))
    few = links.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    while True:
        further = links.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        step = durable(_with(links, few, further, "root_id").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        links = step.select("id", "root_id")
        if not step.where("moved").limit(1).count():
            break
    # Every form and root is a near word of another, and few words have one: only those are looked up.
    names = told.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    wanted = told.select("form_id").unionByName(links.select(F.col("root_id").alias("form_id"))).where("form_id IS NOT NULL").distinct()
    names = durable(names.join(wanted, "form_id", "left_semi"))
    few = few and (names.agg(F.sum(F.octet_length("form"))).first()[0] or 0) <= BROADCAST_BYTES
    out = _with(_with(told, few, links, "id"), few, names, "form_id")
    out = _with(out, few, names.select(F.col("form_id").alias("root_id"), F.col("form").alias("root")), "root_id")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

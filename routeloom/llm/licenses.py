"""Licence scan in built-in functions: a stem gate on the raw text, a gate word per rule, then the rule's pattern.

Everything happens within the row, so nothing is shuffled and a long document is only a longer row. A detection is
suppressed if a detection of a better priority contains it, or a longer one of the same priority. Null and empty texts
have no words, no labels and score 0; repeated rows give repeated results; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, texts
from .license_rules import GATE, rules

# Separators in raw and in folded text: ASCII other than digits and letters
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A superset of the places of the base phrases, so the stem gate can never hide one.
_BASE_GATE = rf"(?i)cc{_SEP}by|general{_SEP}public{_SEP}license|all{_SEP}rights{_SEP}reserved"
_LEVELS = 5
_OPEN, _SHUT = "\u0002", "\u0003"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _matches(line: Column, rule: Column) -> Column:
    """Detections of one rule: array of (start word, word after the end, rule's fields).

    Marks are put around every match, and the words before each mark are counted along the pieces.
    """
    pieces = F.split(F.regexp_replace(line, rule["pattern"], F.lit(f"{_OPEN}$0{_SHUT}")), F.lit(f"[{_OPEN}{_SHUT}]"))
    counts = F.transform(pieces, _spaces)
    zero = F.struct(F.lit(-1).alias("at"), F.lit(True).alias("outside"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    walked = F.aggregate(counts, zero, lambda acc, n: F.struct(
        (acc["at"] + n).alias("at"), (~acc["outside"]).alias("outside"),
        F.when(acc["outside"], acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n + 1).alias("stop"))))).alias("found")))
    return F.transform(walked["found"], lambda m: F.struct(
        m["start"].alias("start"), (-m["stop"]).alias("minus_stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(gate).alias("gate"), F.lit(p).alias("pattern"), F.lit(pr).alias("priority"), F.lit(w).alias("weight"), F.lit(b).alias("base"))
                      for label, gate, p, pr, w, b in rules()])
    gates = F.array(*[F.lit(x) for x in sorted({r[1] for r in rules()})])
    d = texts(docs).select("doc_id", F.regexp_count("text", F.lit(_RAW_WORD)).cast("bigint").alias("n_words"),
                           F.when(F.col("text").rlike(GATE) | F.col("text").rlike(_BASE_GATE), F.col("text")).alias("held"))
    d = d.withColumn("line", F.when(F.col("held").isNotNull(), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("held", UPPER, LOWER), _NOT_WORD, " ")), F.lit(" "))))
    d = d.select("doc_id", "n_words", "line", F.when(F.col("line").isNotNull(), F.array_intersect(F.split("line", " "), gates)).alias("seen"))
    d = d.withColumn("found", F.when(F.size("seen") > 0, F.flatten(F.transform(
        F.filter(table, lambda r: F.array_contains(F.col("seen"), r["gate"])), lambda r: _matches(F.col("line"), r)))))
    none = F.array().cast("array<struct<start:int,minus_stop:int,priority:int,label:string,weight:double,base:boolean>>")
    d = d.select("doc_id", "n_words", F.array_sort(F.coalesce("found", none)).alias("found"))
    # Sorted by start, longer first: a detection lies within an earlier one iff its stop is at most the largest stop so far.
    start = F.struct(F.array_repeat(F.lit(-1), _LEVELS).alias("stops"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        stop = -m["minus_stop"]
        inside = F.exists(F.slice(acc["stops"], 1, m["priority"] + 1), lambda s: s >= stop)
        stops = F.transform(acc["stops"], lambda s, i: F.when(i == m["priority"], F.greatest(s, stop)).otherwise(s))
        return F.struct(stops.alias("stops"), F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(m["label"]))).alias("labels"),
                        F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], m["weight"])).alias("score"), (acc["kept"] + (~inside).cast("int")).alias("kept"))

    # A better priority may start at the same word and be shorter; ordering by priority within equal spans needs no more than the tuple order.
    d = d.withColumn("base", F.filter("found", lambda m: m["base"])).withColumn("won", F.aggregate(F.filter("found", lambda m: ~m["base"]), start, step))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda m: m["label"])))
    return d.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
                    F.array_min(F.transform("base", lambda m: m["start"])).cast("bigint").alias("first_word"),
                    F.array_max(F.transform("base", lambda m: m["start"])).cast("bigint").alias("last_word"),
                    F.array_join(base_labels, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base_labels, F.col("won")["labels"])), ",").alias("labels"),
                    F.greatest(F.col("won")["score"], F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
                    F.size("found").cast("bigint").alias("n_found"), F.col("won")["kept"].cast("bigint").alias("n_kept"))

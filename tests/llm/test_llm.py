"""The document operators against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import bilinear, fingerprint, license_rules, licenses, lines, mixing, neighbours, ngram_join, pieces, quality, queries, suffixes
from routeloom.llm.common import flat, hashed_words
from routeloom.llm.components import components

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, token string, part int"


def rows_of(n=60, seed=1):
    """Short texts with copies, near copies, shared lines, nulls, blanks, one long text, repeated rows and clashing columns."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    out, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            t = rng.choice(texts)
        elif texts and kind < 0.45:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = "\n".join(rng.choice(shared) if rng.random() < 0.3 else line(rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))
        texts.append(t)
        out.append((i * 2, t, "en", rng.choice(["a", "a", "b", None]), len(t), 1, "x", 2))
    out += [(1001, None, None, None, None, None, None, None), (1003, "", "", "", 0, 0, "", 0), (1005, "   \n ", "en", "b", 5, 0, "", 0),
            (1007, " ".join(rng.choice(vocab) for _ in range(60_000)), "en", "a", 0, 0, "", 0), (1009, "All Rights RESERVED. cc-by, CC BY", "en", "a", 0, 0, "", 0)]
    return out + [out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def folded_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# ------------------------------------------------------------------ line dedup

def test_patience_aligns_unique_lines_in_order():
    a, b = [1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 8, 5]
    assert lines.patience(a, b) == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 6)]
    assert lines.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert lines.patience([], [1]) == []


def test_patience_pairs_increase_and_match():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(1, 8) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_line_dedup_deletes_from_later_document(spark):
    block = "one two three four five\nsix seven eight nine ten"
    d = spark.createDataFrame([(1, f"head\n{block}\ntail"), (2, f"other head\n{block}\nend"), (3, "short\nother"), (4, f"{block}"), (None, block), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup(d).collect()}
    assert got[1]["text"] == f"head\n{block}\ntail" and got[1]["lines_removed"] == 0
    assert got[2]["text"] == "other head\nend" and got[2]["lines_removed"] == 2
    assert got[4]["text"] == "" and not got[4]["lines_left"] and got[None]["text"] == block and got[5]["text"] is None


def test_frequent_lines_still_pair_each_copy_with_the_first(spark):
    text = "\n".join(f"line {i} of a text that all share" for i in range(4))
    d = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    got = lines.dedup(d, rare=5)
    assert got.where("lines_left").count() == 1 and got.where("lines_removed = 4").count() == 299


def test_frequent_passage_goes_from_documents_that_share_a_rarer_line_too(spark):
    passage = "a passage of nine words that very many share"
    made = [(0, f"start\n{passage}"), (1, "rarer\nown words")] + [(i, f"{passage}\nrarer {i}" if i % 2 else f"{passage}\nrarer") for i in range(2, 300)]
    got = lines.dedup(spark.createDataFrame(made, "doc_id long, text string"))
    assert got.where(F.contains("text", F.lit(passage))).count() == 1 and got.where("lines_removed = 1").count() == 298


def test_a_copy_goes_whose_lines_each_have_another_first_holder(spark):
    lines_ = [f"line number {i}" for i in range(10)]
    made = [(i, f"own words of {i} here\n{x}\nand more of {i} below") for i, x in enumerate(lines_)] + [(20, "\n".join(lines_)), (30, "\n".join(lines_)), (40, "\n\n".join(lines_)), (50, "\n".join(lines_[::-1]))]
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[20]["lines_removed"] == 0 and got[30]["lines_removed"] == 10 and not got[30]["lines_left"]
    assert got[40]["lines_removed"] == 0 and got[50]["lines_removed"] == 0 and all(got[i]["lines_removed"] == 0 for i in range(10))


def windows_of(text, min_words=8):
    """(lines of the window, first line number) by definition."""
    ls = [x.strip() for x in text.split("\n")]
    for i, x in enumerate(ls):
        if x:
            for j in range(i, len(ls)):
                if sum(len(y.split()) for y in ls[i:j + 1]) >= min_words:
                    yield tuple(ls[i:j + 1]), i
                    break


@pytest.mark.parametrize("seed,rare,hot", [(1, 100, 2000), (2, 1, 2000), (3, 100, 10**9)])
def test_line_dedup_leaves_no_window_of_an_earlier_document(spark, monkeypatch, seed, rare, hot):
    monkeypatch.setattr(lines, "HOT_SHARE", hot)
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 2, 3, 5, 9)))) for _ in range(25)]
    made = [(i * 2, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(70)]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    gone = {r["doc_id"]: set(r["gone"]) for r in lines.removed_lines(d, rare=rare).collect()}
    seen, checked = set(), 0
    for n, (i, t) in enumerate(made):
        ls, must, may = t.split("\n"), set(), set()
        for w, at in windows_of(t):
            if w in seen:
                must |= set(range(at, at + len(w)))
        for _, earlier in made[:n]:  # every run of lines that both have, of eight words or more
            es = earlier.split("\n")
            for x in range(len(ls)):
                for y in range(len(es)):
                    k = 0
                    while x + k < len(ls) and y + k < len(es) and ls[x + k] == es[y + k]:
                        k += 1
                    if sum(len(v.split()) for v in ls[x:x + k]) >= 8:
                        may |= set(range(x, x + k))
        assert must <= gone.get(i, set()) <= may
        checked += len(must)
        seen |= {w for w, _ in windows_of(t)}
    assert checked > 50


# ------------------------------------------------------------------ suffix dedup

def removed_by_brute_force(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(i, first.get(s, i))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p + 1:p + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone[1:]) if not g))
    return out


@pytest.mark.parametrize("alphabet,length,k,part_bytes,hot", [("ab", 20, 8, 400, 5), ("abcdefé ", 50, 24, 3000, 4), ("abcdefé ", 50, 24, 2000, 10**9), ("a", 50, 24, 500, 3)])
def test_suffix_dedup_equals_brute_force(spark, alphabet, length, k, part_bytes, hot):
    rng = random.Random(len(alphabet) + hot)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(8)]
    made = []
    for i in range(50):
        cut = []
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            cut.append(b[a:a + rng.randint(5, 150)] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(40)))
        made.append((i * 3 + 1, "".join(cut) if i % 11 else None))
    got = suffixes.dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(3), length, k, part_bytes, hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == removed_by_brute_force(made, length)


def test_loser_tree_merges_runs_with_prefixes():
    rng = random.Random(4)
    held = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))) for _ in range(7)]
    runs = []
    for h in held:
        lcp, size, rest = suffixes.front_code(h)
        runs.append(suffixes.Run(lcp.tobytes(), size.tobytes(), rest))
    got = list(suffixes.merge(runs))
    out = [held[r][i] for r, i, _ in got]
    assert out == sorted(x for h in held for x in h)
    assert all(n == suffixes.shared(a, b, 0) for (_, _, n), a, b in zip(got[1:], out, out[1:]))


# ------------------------------------------------------------------ n-gram join

def groups_by_brute_force(rows):
    def shingles(t):
        w = folded_words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.7:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice((0, 1, 3, 5, 9, 40, 90)))]
        rows.append((i, " ".join(w) if i % 23 else None))
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == groups_by_brute_force(rows)


def test_every_link_of_a_group_of_near_copies_is_counted(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        made.append((i, " ".join(w)))
    d = spark.createDataFrame(made, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in made}
    classes = {frozenset(s): i for i, s in reversed(sets.items())}
    want = {i: sum(s != x and 100 * len(s & x) >= 80 * len(s | x) for x in classes) for i, s in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.groups(d).collect()} == want and max(want.values()) > 10
    _, part, held = ngram_join.parts(d)
    got = ngram_join.degrees(part, held, block_tokens=2000).collect()  # several blocks
    assert {r["node"]: r["n_links"] for r in got} == {i: want[i] for i in classes.values() if want[i]}


def test_ngram_query_equals_brute_force_on_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_ngram_jaccard(spark, SF).collect()}
    assert got == groups_by_brute_force(zip(d.doc_id, d.text))


def test_an_id_with_two_texts_is_two_documents(spark):
    a, b = ("x1 x2 x3 x4 x5 x6 x7", "y1 y2 y3 y4 y5 y6 y7")
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, "z"), (9, "z"), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["n_links"], r["n_shingles"]) for r in ngram_join.groups(d).collect())
    assert got == [(-1, None, 0, 0), (1, 1, 0, 3), (5, 1, 0, 3), (5, 5, 0, 3), (7, 5, 0, 3), (9, 9, 0, 1), (9, 9, 0, 1)]
    near = spark.createDataFrame([(1, a + " q" * 90), (5, a + " q" * 90), (5, b), (7, b + " y8"), (8, "other")], "doc_id long, text string")
    kept = ngram_join.kept_rows(near.withColumn("row_no", F.lit(1))).collect()
    assert len(kept) == 4 and {r["text"] for r in kept} == {a + " q" * 90, b, b + " y8", "other"} and kept[0].asDict().keys() == {"doc_id", "text", "row_no"}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}}


# ------------------------------------------------------------------ licences

def test_license_rules_are_hundreds_of_gated_patterns():
    made = license_rules.rules()
    assert len(made) > 300
    gate = re.compile(license_rules.GATE)
    for label, word, pattern, priority, weight, base in made:
        assert re.compile(pattern) and 0 <= priority < licenses._LEVELS and 0 < weight <= 1 and re.fullmatch(r"[a-z0-9]+", word)
    for text in ("Licensed under the Apache License, Version 2.0.", "cc-by", "Alle Rechte vorbehalten", "WTFPL", "GPLv3"):
        assert gate.search(text)


def every_text(tree):
    """All texts of a parsed pattern, with one digit for a class of digits and at most two rounds of a repeat."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            own = [chr(arg)]
        elif op == "IN":
            own = ["7" if str(k) == "CATEGORY" else chr(x) for k, x in arg]
        elif op == "SUBPATTERN":
            own = every_text(arg[3])
        elif op == "BRANCH":
            own = [t for b in arg[1] for t in every_text(b)]
        else:
            assert op == "MAX_REPEAT", op
            once = every_text(arg[2])
            own = [t for n in range(arg[0], min(arg[1], arg[0] + 2) + 1) for t in map("".join, itertools.product(once, repeat=n))]
        out = [a + b for a in out for b in own]
    return out


def test_every_license_text_passes_both_gates():
    # A phrasing only puts words before and after a name, so the bare name stands for all five.
    assert all(before in ("",) or before[-1] == " " or before.endswith(" )?") for _, _, _, before, _ in license_rules.PHRASINGS)
    bare = license_rules.BASE + license_rules.FAMILIES + [x[:3] for x in license_rules.SINGLE]
    assert len(bare) > 90
    for label, word, pattern in bare:
        for t in every_text(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, t) and word in t.split(" "), (label, word, t)
            for gap in (" ", "\n" + " " * 20):
                assert re.search(license_rules.GATE, t.replace(" ", gap)), (label, t)


def test_license_phrases_alone_are_found(spark):
    want = {"It may not be copied.": "proprietary", "They may not be reproduced or copied": "proprietary", "May not be redistributed": "proprietary", "without warranties of any kind": "warranty",
            "licensed under the Open Font License": "ofl", "Tous droits réservés": "reserved", "Alle Rechte\n              vorbehalten": "reserved"}
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {list(want)[r["doc_id"]]: r["labels"] for r in got} == want and all(r["score"] > 0 and r["n_kept"] == 1 for r in got)


def base_by_brute_force(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = sorted((i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
                   for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark):
    rng = random.Random(5)
    bits = ["cc", "CC", "by", "by-nc", "general", "public", "License", "all", "rights", "reserved", "é", "GNU", "x", "mit", "version", "3", "ccby"]
    rows = [(i, rng.choice([" ", "-", "\n", ".. "]).join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "")]
    rows += list(zip(*pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].to_numpy().T))
    got = licenses.scan(spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[int(i)].append(base_by_brute_force(t))
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("GNU Lesser General Public License", "gpl,lgpl"), ("a text about merit", "")])
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


# ------------------------------------------------------------------ neighbours

def test_neighbours_recall_and_exact_scores(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(d.embedding).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.op5_multi_index_hashing(spark, SF).toPandas()
    hit = 0
    for i in np.flatnonzero(d.vec_id % 50 == 0):
        s = unit @ unit[i]
        s[i] = -9
        best = d.vec_id.to_numpy()[np.lexsort((d.vec_id, -s))[:5]]
        own = got[got.query_id == d.vec_id[i]].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and np.allclose(own.score, [s[d.vec_id == v][0] for v in own.vec_id], atol=1e-12)
        hit += len(set(best) & set(own.vec_id))
    assert hit >= 0.9 * len(got)


def test_neighbours_of_extreme_vectors_have_finite_cosines(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    size = np.where(np.arange(60) % 3 == 0, 1e200, np.where(np.arange(60) % 3 == 1, 1e-200, 1.0))
    rows = [(i, (x[i] * size[i]).tolist()) for i in range(60)] + [(100, [5e-324, 0.0, 0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r["score"]) <= 1 + 1e-12 for r in got) and len(got) == 15
    for q in (0, 50):
        s = unit @ unit[q]
        for r in got:
            if r["query_id"] == q and r["vec_id"] < 60:
                assert math.isclose(r["score"], s[r["vec_id"]], abs_tol=1e-9)


def test_neighbours_on_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 50, 7]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50] == [0, 1, 2, 7]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


# ------------------------------------------------------------------ language model

def test_language_model_counts_equal_brute_force(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    tokens = {i: [*folded_words(t), "\0"] for i, t in zip(d.doc_id, d.text)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in queries.op6_log_bilinear(spark, SF).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9) and r["score"] < 0


def test_language_model_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "SHARD_TOKENS", 3000)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    two, six = ({r["doc_id"]: r["score"] for r in bilinear.score(d.repartition(n)).collect()} for n in (2, 6))
    assert two == six


def test_language_model_fills_its_head_from_a_level_of_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "HEAD", 3000)
    d = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(200))) for i in range(40)], "doc_id long, text string")
    counts = bilinear.token_counts(d)
    model = bilinear.fit(d, counts, F.lit(True), F.lit(0), [])
    assert 2500 < len(model.hashes) <= 3001 and model.size == len(model.hashes) + 2 and (model.hashes == bilinear.END_HASH).sum() == 1


def test_language_model_is_normalised_and_learns_an_order():
    hashes = np.arange(10, 16, dtype=np.int64)
    counts = np.full(6, 1000, np.int64)
    model = bilinear.Model(np.append(hashes, -1), np.append(counts, 10), bilinear.Totals(6010, 7, 0, 0, 0.5))
    ids = np.tile(np.arange(3, 9, dtype=np.int32), 2000)
    a, b, t, _ = model.contexts(ids, np.array([0, len(ids)]))
    before = model.log_probs(model.normalisers(), a, b, t).mean()
    for seed in range(6):
        model.params, _ = model.walk(zip(np.array_split(a, 40), np.array_split(b, 40), np.array_split(t, 40)), seed)
    z = model.normalisers()
    assert model.log_probs(z, a, b, t).mean() > before + 0.3
    every = np.array([w for w in range(model.size) if w != bilinear.START])
    for x, y in ((2, 2), (3, 2), (5, 4)):
        assert math.isclose(np.exp(model.log_probs(z, np.full(len(every), x), np.full(len(every), y), every)).sum(), 1, rel_tol=1e-4)


# ------------------------------------------------------------------ mixing

def test_mixing_meets_entropy_and_repetition():
    tokens = np.array([900.0, 90.0, 10.0])
    a = mixing.exponent_for(tokens, 1000, max_repeats=2)
    p = mixing.shares(tokens, a)
    assert math.isclose(p.sum(), 1) and (p * 1000 / tokens).max() <= 2 + 1e-6 and math.isclose((p * 1000 / tokens).max(), 2, rel_tol=1e-6)
    target = 0.8
    assert math.isclose(mixing.entropy(mixing.shares(tokens, mixing.exponent_for(tokens, 1000, target))), target, rel_tol=1e-9)


def test_mixing_quotas_and_passes(spark, docs):
    got = mixing.mix(docs, max_repeats=3.0, block_rows=7).toPandas()
    d = docs.toPandas()
    d["tokens"] = [len(folded_words(t)) for t in d.text]
    total = d.groupby(d.source.fillna("-")).tokens.sum()
    p = dict(zip(total.index, mixing.shares(total.to_numpy(float), mixing.exponent_for(total.to_numpy(float), float(total.sum()), max_repeats=3.0))))
    for source, part in got.groupby(got.source.fillna("-")):
        quota, longest = math.floor(p[source] * total.sum() + 1e-6), d[d.source.fillna("-") == source].tokens.max()
        assert quota - longest <= part.mix_tokens.sum() <= quota
        for k in range(1, quota // total[source] + 1):
            assert sorted(part[part.mix_pass == k].doc_id) == sorted(d[d.source.fillna("-") == source].doc_id)
    assert set(got.columns) == {*docs.columns, "mix_pass", "mix_block", "mix_place", "mix_tokens"}


# ------------------------------------------------------------------ pieces

@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def test_pieces_equal_the_library_in_unigram_mode(vocabulary):
    pb, sp = pytest.importorskip("sentencepiece.sentencepiece_model_pb2"), pytest.importorskip("sentencepiece")
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for x, s in zip(m.pieces, vocabulary.scores):
        x.score = s
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist() + ["", " ", "  a  b ", "漢字\n\t😀", "▁x▁", "a" * 300]
    total = lambda ids: sum(vocabulary.scores[i] if not vocabulary.byte_ids[i] else 0.0 for i in ids)
    for t in texts:
        own, other = vocabulary.encode(t).tolist(), lib.encode(t)
        assert own == other or math.isclose(total(own), total(other), rel_tol=1e-6)  # equal sums may split differently
        assert vocabulary.decode(np.array(own, np.int32)) == t.replace("▁", " ")


def test_trie_finds_every_prefix():
    rng = random.Random(6)
    keys = {bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 5))): n for n in range(300)}
    trie = pieces.Trie(keys)
    for _ in range(200):
        t = bytes(rng.choice(b"abc\xff\x00") for _ in range(12))
        assert list(trie.ends(t, 2)) == [(e, keys[t[2:e]]) for e in range(3, 13) if t[2:e] in keys]


def test_decode_frame(spark, vocabulary):
    data = pieces.load(spark, MODEL)
    d = spark.createDataFrame([(1, "Hello  wörld\n", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, decoded string")
    got = {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(d, data), data).collect()}
    assert got == {1: "Hello  wörld\n", 2: "", 3: ""}


# ------------------------------------------------------------------ fingerprints

def test_syncmers_by_definition():
    rng = random.Random(7)
    t = "".join(rng.choice("abcdefgh ") for _ in range(700))
    got = fingerprint.anchors(t, 16, 4)
    inner = [hashlib.md5(t[i:i + 4].encode()).digest() for i in range(len(t))]  # another hash: only counts and context freedom are compared
    assert 0 < len(got) < len(t) and len(inner) == len(t)
    shifted = fingerprint.anchors("zz" + t + "yy", 16, 4)
    at = next(i for i in range(len(shifted)) if np.array_equal(shifted[i:i + len(got)], got))
    assert at <= 3


def test_fingerprints_equal_brute_force(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ascending=False)
    ids, texts = d.doc_id.tolist(), d.text.tolist()
    got = {r["doc_id"]: r for r in queries.op9_syncmer_fingerprints(spark, SF).collect()}
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(zip(ids, texts)):
        following, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digits(fingerprint.anchors(t)) and r["edited_fingerprint"] == fingerprint.digits(fingerprint.anchors(edited))
        assert 0 <= r["near_next"] <= 1 and r["near_edited"] == fingerprint.likeness(fingerprint.anchors(t), fingerprint.anchors(edited))


def test_half_edited_short_texts_are_alike():
    rng = random.Random(11)
    for n in [*range(37, 201)] * 3:
        t, other = ("".join(rng.choice("abcdefgh é") for _ in range(n)) for _ in range(2))
        half = n // 2
        assert fingerprint.likeness(fingerprint.anchors(t), fingerprint.anchors(t[:n - half] + other[:half])) > 0


def test_likeness():
    a = fingerprint.anchors("abc " * 200)
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, a[:0]) == 0 and fingerprint.likeness(a[:0], a[:0]) == 1


def matched_plainly(a, b):
    """Likeness by its definition: occurrences numbered on both sides, the longest rising subsequence by patience."""
    number = lambda xs: [(x, xs[:i].count(x)) for i, x in enumerate(xs)]
    place = {x: i for i, x in enumerate(number(b))}
    piles = []
    for p in (place[x] for x in number(a) if x in place):
        i = next((i for i, top in enumerate(piles) if top >= p), len(piles))
        piles[i:i + 1] = [p]
    return 2 * len(piles) / (len(a) + len(b)) if a and b else float(len(a) == len(b))


def test_anchors_and_likeness_of_many_texts_equal_those_of_each():
    rng = random.Random(5)
    many = ["", "", "a", "abc " * 60, "é😀" * 40] + ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 11, 12, 13, 40, 200]))) for letters in ("ab", "abcdé 😀", "abcdefghij ") for _ in range(60)] + [""]
    values, first = fingerprint.anchors_of(many)
    own = [values[x:y].tolist() for x, y in zip(first, first[1:])]
    assert len(own) == len(many) and own == [fingerprint.anchors(t).tolist() for t in many] and all(map(lambda t, a: bool(t) == bool(a), many, own))
    pairs = [(rng.choice(own), rng.choice(own)) for _ in range(300)] + list(zip(own, own[1:])) + [(a, a[len(a) // 2:] + a[:len(a) // 2]) for a in own]
    got = fingerprint.alike([(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs])
    assert got.tolist() == [matched_plainly(a, b) for a, b in pairs]
    assert fingerprint.alike([]).tolist() == []


def test_likeness_takes_no_step_for_each_anchor_that_stayed_in_place(monkeypatch):
    rng = random.Random(6)
    t, other = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000)) for _ in range(2))
    a, b = fingerprint.anchors(t), fingerprint.anchors(t[:10_000] + other[:10_000])
    steps = []
    real = fingerprint.bisect_left
    monkeypatch.setattr(fingerprint, "bisect_left", lambda *x: steps.append(1) or real(*x))
    assert 0.4 < fingerprint.likeness(a, b) < 0.6 and len(a) > 4000 and len(steps) < 100


def test_each_range_of_ids_has_a_task_of_its_own(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = fingerprint.neighbours(docs).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert len(tasks) >= 15 and all(t["parts"] == 1 and t["n"] < 350 for t in tasks) and sum(t["n"] for t in tasks) == 4000 + len(tasks)


def test_fingerprints_over_many_slices_and_batches(spark):
    """Texts of several slices, one longer than a slice, and batches of three rows: each row meets its next one."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgé") for _ in range(5)) for _ in range(300)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 900]))) for i in range(40)} | {40: "long " + " ".join(rng.choice(words) for _ in range(60_000))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(texts) and len(texts[40].encode()) > fingerprint.SLICE
    for i, t in texts.items():
        following, half, r = texts[(i - 1) % 41], len(t) // 2, got[i]
        edited = t[:len(t) - half] + following[:half]
        a, b, c = (fingerprint.anchors(x) for x in (t, edited, following))
        assert (r["n_chars"], r["edited_sha256"], r["n_anchors"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a))
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{x:06x}" for x in xs.tolist()) for xs in (a, b))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))


# ------------------------------------------------------------------ quality

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_ranking(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() >= 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_quality_takes_a_bounded_number_of_rows_of_one_labelled_id(spark, monkeypatch):
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or real(x, y))
    d = spark.range(3000).selectExpr("IF(id < 2990, 1, id) AS doc_id", "concat('text ', id, ' of words') AS text")
    quality.train(d, spark.createDataFrame([(1, 1), (2991, 0), (2992, 0)], "doc_id long, quality int"), most=5)
    assert seen == [5]


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([(0, None), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r[0] for r in quality.score(docs, model).select("quality_score").collect()} == {0.5}


# ------------------------------------------------------------------ all operators on odd tables

def test_words_equal_the_pattern():
    texts = ["a b", "b", "", "  ", "x\ty\x0bé", "A B", "c" * 50, "\n", "end "] * 4
    for i, j, h, first in hashed_words(*flat(pa.array(texts))):
        seen = {}
        for d in range(i, j):
            own = h[first[d - i]:first[d - i + 1]]
            assert len(own) == len(folded_words(texts[d]))
            for w, x in zip(folded_words(texts[d]), own):
                assert seen.setdefault(w, x) == x


OPERATORS = {
    "lines": lambda d: lines.dedup(d), "suffixes": lambda d: suffixes.dedup(d), "ngrams": lambda d: ngram_join.groups(d), "licenses": lambda d: licenses.scan(d),
    "model": lambda d: bilinear.score(d), "pieces": lambda d: pieces.encode(d, pieces.load(d.sparkSession, MODEL)), "fingerprints": lambda d: fingerprint.fingerprints(d),
    "quality": lambda d: quality.score(d, quality.train(d, d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("quality")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(spark, docs, empty, name):
    run = OPERATORS[name]
    with_null = docs.unionByName(spark.createDataFrame([(None, "a text without an id that is long enough to be cut somewhere", None, None, None, None, None, None)], DOCS))
    got = run(with_null)
    key = "doc_id"
    assert sorted(str(r[key]) for r in got.select(key).collect()) == sorted(str(r[key]) for r in with_null.select(key).collect())
    assert run(empty).count() == 0


def test_mixing_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0


def test_pipeline_stages_keep_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = lines.durable(stage(spark, docs, SF))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert set(out.columns) == set(docs.columns) and (i == 3 or out.count() <= docs.count())
        docs = out
    assert 0.5 * n < docs.count() and docs.where("not round_trip").count() == 0


def test_pipeline_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_ranking(spark, docs, sf).select("doc_id")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count()

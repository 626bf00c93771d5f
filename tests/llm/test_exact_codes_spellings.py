"""Radix dedup, dual-tree codes and spelling variants against brute force, on skewed input and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import codes, radix, spellings
from routeloom.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


# ------------------------------------------------------------------ radix dedup

def groups_by_brute_force(rows):
    held = defaultdict(list)
    for i, t in rows:
        held[(t or "").translate(FOLD)].append(i)
    out = []
    for t, ids in held.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def odd_rows(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.4:
            t = rng.choice(out)[1]
            t = t and (t.upper() if rng.random() < 0.4 else t)
        elif out and kind < 0.6 and out[-1][1]:  # same length and beginning, another end or middle
            t = list(out[-1][1])
            t[rng.randrange(len(t))] = rng.choice("xyzé")
            t = "".join(t)
        else:
            t = "".join(rng.choice("abÀéß \n") for _ in range(rng.choice((1, 5, 63, 64, 65, 300, 5000))))
        out.append((i, t))
    return out + [(500, None), (501, ""), (502, None), (7, "another text of one id"), (None, "no id"), (None, "NO ID"), (None, out[0][1]), (3, out[3][1]), (900, "l" * 300_000), (901, "L" * 300_000), (902, "l" * 299_999 + "m")]


@pytest.mark.parametrize("least,bucket", [(1, 400), (2000, 5000), (1 << 18, 4 << 20)])
def test_radix_groups_equal_brute_force_at_every_weight(spark, monkeypatch, least, bucket):
    rows = odd_rows()
    rng = random.Random(3)
    rng.shuffle(rows)
    monkeypatch.setattr(radix, "LEAST_BYTES", least)
    got = radix.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_bytes=bucket, node_bytes=least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_brute_force(rows)


def test_heavy_nodes_go_on_by_joins_when_they_may_not_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(radix, "FEW_NODES", 0)
    monkeypatch.setattr(radix, "LEAST_BYTES", 1)
    rows = [(i, ["head " * 60 + str(i % 3), "copy"][i % 2]) for i in range(60)] + [(99, None)]
    got = radix.groups(spark.createDataFrame(rows, "doc_id long, text string"), node_bytes=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_brute_force(rows)


def test_a_text_of_very_many_rows_reaches_no_bucket(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(radix, "LEAST_BYTES", 1000)
    d = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat(repeat('same words ', 20), 'end'), concat('own ', id)) AS text")
    got = radix.groups(d, node_bytes=1000)
    assert got.where("group_size = 1000").count() == 1000 and got.where("kept").count() == 2001
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and seen == []


def test_split_by_length_and_slices():
    raw = b"aaa" + b"aab" + b"aaa" + b"" + b"a" + b""
    assert sorted(map(sorted, radix.split(raw, [0, 3, 6, 9, 9, 10, 10], 1))) == [[0, 2], [1], [3, 5], [4]]


def test_radix_dedup_keeps_columns_and_one_row(spark):
    rows = [(1, "A b", "x"), (2, "a B", "y"), (2, "a B", "z"), (3, None, "n"), (4, "", "e"), (5, "other", "o"), (None, "other", "p")]
    d = spark.createDataFrame(rows, "doc_id long, text string, heavy string").withColumns({"size": F.lit(1), "bucket": F.lit("b"), "kept": F.lit(0), "so_far": F.lit(2)})
    got = radix.dedup(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 4, 5]
    assert radix.groups(d.limit(0)).count() == 0 and radix.dedup(d.limit(0)).count() == 0


# ------------------------------------------------------------------ codes

def lloyd_by_brute_force(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label); whole numbers of Python all the way."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in v] for _, v, _ in kept]
    part = -(-len(whole[0]) // parts)
    cut = [[(v + [0] * parts)[k * part:(k + 1) * part] for v in whole] for k in range(parts)]
    books = [own[:entries] for own in cut]

    def nearest(k):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[k])) for x in cut[k]]

    for _ in range(rounds):
        for k in range(parts):
            held = defaultdict(list)
            for x, (_, e) in zip(cut[k], nearest(k)):
                held[e].append(x)
            books[k] = [[sum(col) // len(held[e]) for col in zip(*held[e])] if e in held else c for e, c in enumerate(books[k])]
    final = [nearest(k) for k in range(parts)]
    error = [sum(final[k][r][0] for k in range(parts)) for r in range(len(kept))]
    by_label = Counter()
    for r, x in zip(kept, error):
        by_label[r[2]] += x
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], "".join(f"{final[k][i][1]:02x}" for k in range(parts)), fits(error[i]), fits(by_label[r[2]]), digest) for i, r in enumerate(kept)), key=str)


def vectors(n, width, seed, spread=1.0, ties=False):
    rng = random.Random(seed)
    draw = (lambda: rng.randint(-3, 3) / 1024) if ties else (lambda: rng.gauss(0, spread))
    return [(i, [draw() for _ in range(width)], rng.choice([1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(700, 8, 1), vectors(400, 12, 2, ties=True), vectors(90, 10, 3), vectors(300, 4, 4, 1e12), vectors(40, 4, 5, 1e30)], ids=["plain", "ties", "few", "large", "huge"])
def test_codes_equal_brute_force(spark, rows):
    odd = [(10_000, None, 1), (10_001, [1.0, None] * (len(rows[0][1]) // 2), 1), (10_002, [float("nan")] * len(rows[0][1]), 1), (10_003, [float("inf")] * len(rows[0][1]), None),
           (10_004, [0.5], 1), (5, rows[5][1], 2), (None, rows[6][1], 2)]
    made = rows + odd
    d = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit("c"), "error": F.lit(1.5), "vector": F.lit(None).cast("string"), "total": F.lit(0)})
    got = codes.compress(d.repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd_by_brute_force(made)


def test_codes_do_not_depend_on_the_layout(spark):
    made = vectors(600, 8, 6)
    one, many = (codes.compress(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(n)).collect() for n in (1, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_codes_of_one_label_empty_tables_and_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    none = codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in none} == {("00000000", 0, 0)}


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("n,k,width,most", [(1, 1, 3, 5), (500, 40, 2, 9), (800, 256, 16, 900), (300, 17, 1, 3), (260, 256, 4, 2), (200, 5, 0, 1)])
def test_dual_tree_assigns_like_all_distances(kind, n, k, width, most):
    rng = np.random.default_rng(n)
    x, e = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (k, width))
    nearest, sums, counts = codes.assign(x.astype(kind), e.astype(kind))
    want = ((x[:, None] - e[None]) ** 2).sum(2).argmin(1)
    total = np.zeros((k, width), np.int64)
    np.add.at(total, want, x)
    assert (nearest == want).all() and (sums.astype(np.int64) == total).all() and (counts == np.bincount(want, minlength=k)).all()


def test_clustered_nodes_are_assigned_whole():
    rng = np.random.default_rng(8)
    centres = rng.integers(-10**6, 10**6, (10, 4))
    x = np.repeat(centres, 1000, axis=0) + rng.integers(-5, 5, (10_000, 4))
    tree = codes.Tree(x, codes.LEAF)
    exact = []
    real = np.argmin
    try:
        np.argmin = lambda a, axis=None: exact.append(len(a)) or real(a, axis=axis)
        nearest, _, counts = codes.assign(x, centres, tree)
    finally:
        np.argmin = real
    assert sum(exact) < 2000 and (counts == 1000).all() and (nearest == np.repeat(np.arange(10), 1000)).all()


def test_decoded_vectors_are_the_entries(spark):
    d = spark.createDataFrame(vectors(300, 8, 7), "vec_id long, embedding array<double>, label int")
    model = codes.fit(d)
    got = codes.decode(codes.encode(d, model), model).join(d, "vec_id").collect()
    for r in got:
        own, back = np.floor(np.array(r["embedding"]) * 1024), np.array(r["vector"]) * 1024
        assert int(((own - back) ** 2).sum()) == r["error"]


# ------------------------------------------------------------------ spellings

def words_by_brute_force(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            if len(w) >= 5:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_brute_force(n):
    form, out = {}, {}
    for w in n:
        near = [v for v in n if v != w and is_near(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n), key=str)


def spelled(seed, size=220, alphabet="abé"):
    rng = random.Random(seed)
    held = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 8))) for _ in range(size // 4)]
    while len(held) < size:
        w = list(rng.choice(held))
        k, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.4:
            w[k] = rng.choice(alphabet)
        elif kind < 0.7:
            w.insert(k, rng.choice(alphabet))
        elif len(w) > 1:
            del w[k]
        held.append("".join(w))
    return {w: rng.choice((3, 4, 7, 9, 20, 60, 500)) for w in held}


@pytest.mark.parametrize("part_words", [7, 50_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed, part_words):
    n = spelled(seed)
    d = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spellings.variants(d, part_words=part_words)
    assert sorted((tuple(r) for r in got.collect()), key=str) == variants_by_brute_force(n)


def test_variants_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(spellings, "BROADCAST_IDS", 0)
    n = spelled(4, 120)
    got = spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == variants_by_brute_force(n)


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("ab😀") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    got = {r["key"]: r["path"] for r in spellings.nodes(spark.createDataFrame([(k,) for k in keys], "key string"), part_words=11).collect()}
    node = {}
    for k, path in got.items():
        assert len(path) == len(k) + 1 and path[0] == 0
        for i, x in enumerate(path):
            assert node.setdefault(k[:i], x) == x
    assert len(set(node.values())) == len(node) and [got[k][-1] for k in keys] == sorted(got[k][-1] for k in keys)


def test_words_equal_brute_force_and_odd_texts(spark):
    rng = random.Random(6)
    vocab = ["Straße", "straße", "naïve", "naive", "ÀÉÎÕÜ", "word", "words", "wordy", "x" * 4000, "x" * 4001, "don't", "a_b_cdefg", "漢字abcdef", "ÿÿÿÿÿ", "Àbcdef÷ghijkl"]
    rows = [(i, rng.choice((" ", "-", "\n", "9")).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "words words naïve"), (3, None), (4, ""), (5, " "), rows[0], rows[0]]
    d = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n long, id long")
    n = words_by_brute_force(rows)
    assert {r["word"]: r["n"] for r in spellings.words(d).collect()} == n and len(n) > 8
    got = spellings.variants(spellings.words(d)).collect()
    assert sorted((tuple(r) for r in got), key=str) == variants_by_brute_force(n)
    assert spellings.variants(spellings.words(d.limit(0))).count() == 0


def test_a_chain_of_forms_ends_at_its_root(spark):
    chain = ["aaaaa" + "b" * i for i in range(12)]
    n = {w: 3 * 2 ** i for i, w in enumerate(chain)}
    got = {r["word"]: r for r in spellings.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert all(got[w]["root"] == chain[-1] for w in chain) and got[chain[0]]["form"] == chain[1] and got[chain[-1]]["form"] is None

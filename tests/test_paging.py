"""Pages by key against plain ordering, on keys with NULLs in every direction."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from routeloom.operators import paging as P

KIND = "a long, b string, id long"


def rows(seed=1, n=97):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2, 3, -5]), rng.choice([None, "x", "y", "é"]), i) for i in range(n)]


def place(v, k):
    """A sortable stand-in of a value under a key."""
    null = v is None
    rank = (1 if null else 0) if k.last else (0 if null else 1)
    v = 0 if null else v if isinstance(v, int) else [ord(c) for c in v][0]
    return rank, -v if k.descending else v


def wanted(made, order):
    at = {"a": 0, "b": 1, "id": 2}
    return sorted(made, key=lambda r: [place(r[at[k.name]], k) for k in order])


DIRECTIONS = [(d, n) for d in (False, True) for n in (False, True)]


@pytest.mark.parametrize("first", DIRECTIONS)
def test_pages_and_cursors_equal_the_order(spark, first):
    made = rows()
    df = spark.createDataFrame(made, KIND).repartition(5)
    for second in DIRECTIONS:
        order = [P.Key("a", *first), P.Key("b", *second), P.Key("id", True)]
        want = wanted(made, order)
        starts = P.page_starts(df, order, 20, parts=4)
        assert starts.count() == 5
        for n in (0, 2, 4, 5):
            got = P.page(df, order, starts, n).orderBy("row_no").collect()
            assert [(r.a, r.b, r.id) for r in got] == want[n * 20:n * 20 + 20] and [r.row_no for r in got] == list(range(n * 20 + 1, n * 20 + 1 + len(got)))
            assert all(r.more == (n < 4) for r in got)
        mark, seen = None, []
        for _ in range(4):
            got = P.after(df, order, mark, 30).orderBy(*[k.order() for k in order]).collect()
            seen += [(r.a, r.b, r.id) for r in got]
            assert all(r.more == (len(seen) < 97) for r in got)
            mark = P.cursor(got[-1], order)
        assert seen == want and P.after(df, order, mark, 30).count() == 0


def test_a_deep_page_reads_its_range_and_sorts_its_rows(spark, tmp_path):
    spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.lit("x" * 20).alias("v")).repartitionByRange(20, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = P.keys("k")
    starts = P.page_starts(df, order, 100)
    page = P.page(df, order, starts, 1500)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,150000)" in plan and "LessThanOrEqual(k,15" in plan
    assert [r.k for r in page.orderBy("row_no").collect()] == list(range(150_000, 150_100)) and page.first().row_no == 150_001


def test_an_order_with_ties_and_empty_tables(spark):
    df = spark.createDataFrame(rows(), KIND)
    with pytest.raises(ValueError):
        P.page_starts(df, P.keys("a", "b"), 10)
    none = df.limit(0)
    starts = P.page_starts(none, P.keys("id"), 10)
    assert starts.count() == 0 and P.page(none, P.keys("id"), starts, 0).count() == 0 and P.after(none, P.keys("id"), None, 5).count() == 0
    assert list(itertools.chain(P.keys("a", P.Key("b", True)))) == [P.Key("a"), P.Key("b", True)]

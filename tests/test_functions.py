"""Edge rows of the column functions against plain Python."""

import ipaddress
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from routeloom.functions import addr, paths as P, text as X
from routeloom.operators.measure import half_up, unusable_place


def col_values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def one(spark, values, fn, kind="string"):
    return [r[0] for r in col_values(spark, [(i, v) for i, v in enumerate(values)], f"i int, v {kind}", F.struct("i", fn(F.col("v")).alias("r")).alias("s"))
            for r in [(r[0]["r"],)]]


def test_v4_text(spark):
    assert one(spark, ["1.2.3.4", " 255.255.255.255 ", "256.1.1.1", "1.2.3", "01.2.3.4", "a.b.c.d", "", None], addr.v4_int) == [
        16909060, 4294967295, None, None, 16909060, None, None, None]
    assert one(spark, [0, 16909060, 4294967295], addr.v4_text, "bigint") == ["0.0.0.0", "1.2.3.4", "255.255.255.255"]


def test_v4_range(spark):
    got = one(spark, ["10.1.2.3/8", "10.1.2.3", "0.0.0.0/0", "1.1.1.1/33", "1.1.1.1/", "x"], addr.v4_range)
    assert [tuple(g) if g else None for g in got] == [
        (167772160, 184549375, 8, True), (167838211, 167838211, 32, False), (0, 4294967295, 0, True), None, None, None]


def test_v6_point(spark):
    texts = ["2001:DB8::", "::", "::1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "12345::", ":::", "1.2.3.4", "g::"]
    want = []
    for t in texts:
        try:
            want.append(f"{int(ipaddress.IPv6Address(t)):032x}")
        except ValueError:
            want.append(None)
    assert one(spark, texts, lambda c: addr.wide_hex(addr.v6_point(c))) == want


def test_wide_neighbours_and_masks(spark):
    pts = ["0" * 32, "f" * 32, "0" * 16 + "f" * 16, "00000000000000010000000000000000", "20010db8000000000000000000000001"]
    up = one(spark, pts, lambda c: addr.wide_hex(addr.WIDE.succ(addr.wide_from_hex(c))))
    down = one(spark, pts, lambda c: addr.wide_hex(addr.WIDE.pred(addr.wide_from_hex(c))))
    step = lambda h, d: f"{int(h, 16) + d:032x}" if 0 <= int(h, 16) + d < 1 << 128 else None
    assert up == [step(p, 1) for p in pts] and down == [step(p, -1) for p in pts]
    for n in (0, 1, 63, 64, 65, 127, 128):
        mask = ((1 << n) - 1) << (128 - n)
        assert one(spark, pts, lambda c: addr.wide_hex(addr.WIDE.mask(addr.wide_from_hex(c), n))) == [f"{int(p, 16) & mask:032x}" for p in pts]
        assert one(spark, pts, lambda c: addr.wide_hex(addr.WIDE.last(addr.wide_from_hex(c), n))) == [f"{int(p, 16) | ((1 << 128) - 1 ^ mask):032x}" for p in pts]


def test_canonical_text(spark):
    rnd = random.Random(1)
    addrs = [rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.choice([0xFFFF << 48 | 0xF, (1 << 128) - 1, 0xFFFF << 112 | 0xFFFF]) for _ in range(60)]
    long = [ipaddress.IPv6Address(a).exploded for a in addrs]
    assert one(spark, long, addr.normalize_ip) == [str(ipaddress.IPv6Address(a)) for a in addrs]
    assert one(spark, ["::ffff:1.2.3.4", "[FE80::1%eth0]", "010.001.0.5", "1::2::3", "not", "1:0:0:2:0:0:0:3", "0:0:1::"], addr.normalize_ip) == [
        "::ffff:102:304", "fe80::1", "10.1.0.5", "1::2::3", "not", "1:0:0:2::3", "0:0:1::"]


def test_private(spark):
    private = ["10.0.0.1", "172.16.0.1", "172.31.9.9", "192.168.1.1", "127.0.0.1", "169.254.0.1", "100.64.0.1", "0.1.2.3", "::1", "fe80::1", "fd00::1", "", None, "1.2.3", "a.b.c.d"]
    public = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "2001:db8::1", "192.169.0.1"]
    assert one(spark, private, addr.is_private) == [True] * len(private)
    assert one(spark, public, addr.is_private) == [False] * len(public)


def test_cidr_lists(spark):
    rnd = random.Random(2)
    spans = [(0, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2), (7, 8)] + [tuple(sorted((rnd.getrandbits(32), rnd.getrandbits(32)))) for _ in range(40)]
    got = col_values(spark, spans, "a bigint, b bigint", "a", "b", addr.v4_cidrs("a", "b"))
    for a, b, nets in got:
        assert nets == [str(n) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(a), ipaddress.IPv4Address(b))]


def test_cidr_bounds(spark):
    got = one(spark, ["10.1.2.3/8", "2001:DB8::1/32", "::ffff:1.2.3.4/128", "1.2.3.4", "1.2.3.4/33", "01.2.3.4/8", "::/0", None],
              lambda c: addr.let(addr.cidr_bounds(c), lambda b: F.when(b.isNotNull(), F.concat_ws(" ", b["family"].cast("string"), b["plen"].cast("string"), addr.wide_hex(b["ip_start"])))))
    h = lambda t: f"{int(ipaddress.ip_address(t)):032x}"
    assert got == ["4 8 " + h("10.0.0.0"), "6 32 " + h("2001:db8::"), "6 128 " + h("::ffff:1.2.3.4"), "4 32 " + h("1.2.3.4"), None, None, "6 0 " + h("::"), None]


# ---------------------------------------------------------------- paths

PATHS = [[], [1], [1, 1, 1], [1, 2, 2, 3], [1, 2, 1], [64500, 1299, 174, 9], [64500, 9]]


def test_path_columns(spark):
    got = one(spark, PATHS, P.clean_path, "array<bigint>")
    assert got == [[], [1], [1], [1, 2, 3], [1, 2, 1], [64500, 1299, 174, 9], [64500, 9]]
    assert one(spark, PATHS, P.from_first_tier1, "array<bigint>") == [[], [1], [1, 1], [2, 2, 3], [2, 1], [1299, 174, 9], [9]]
    assert one(spark, PATHS, P.first_tier1, "array<bigint>") == [None, None, None, None, None, 2, None]
    assert one(spark, PATHS, P.hop_before_origin, "array<bigint>") == [None, None, None, 2, 2, 174, 64500]


@pytest.mark.parametrize("seq", [[], [1], [1, 2], [2, 3], [1, 3], [1, 2, 1], [9]])
def test_sequences(spark, seq):
    want = [any(p[i:i + len(seq)] == seq for i in range(len(p) - len(seq) + 1)) if seq else True for p in PATHS]
    assert one(spark, PATHS, lambda c: P.contains_sequence(c, seq), "array<bigint>") == want


@pytest.mark.parametrize("query,regex,exclude", [
    ("1 * 2", " 1 (?:[0-9]+ )*2 ", ()), ("1 ? 2", " 1 (?:[0-9]+ ){1}2 ", ()), ("1 ?? 2", " 1 (?:[0-9]+ ){2}2 ", ()), ("1 ? ?? 2", " 1 (?:[0-9]+ ){3}2 ", ()),
    ("1 ? * 2", " 1 (?:[0-9]+ )*2 ", ()), ("* 1", " 1 ", ()), ("1 *", " 1 ", ()), ("!3", None, (3,)), ("-3 4", " 4 ", (3,)), ("1->2,3", " 1 2 3 ", ()), ("abc", None, ()), ("", None, ()), (None, None, ())])
def test_pattern(query, regex, exclude):
    p = P.compile_pattern(query)
    assert (p.regex, p.exclude) == (regex, exclude)
    assert p.empty == (regex is None and not exclude)


def _walk(path, steps):
    """Reference matcher on numbers."""
    def at(i, k):
        if k == len(steps):
            return True
        kind, v = steps[k]
        if kind == "asn":
            return i < len(path) and path[i] == v and at(i + 1, k + 1)
        return any(at(j, k + 1) for j in range(i, len(path) + 1)) if v == "*" else at(i + v, k + 1)
    return any(at(i, 0) for i in range(len(path)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=7), st.lists(st.sampled_from(["1", "2", "3", "*", "?", "??"]), max_size=5))
def test_pattern_regex_equals_walk(path, words):
    p = P.compile_pattern(" ".join(words))
    text = " " + " ".join(map(str, path)) + " "
    if p.has_include:
        assert bool(re.search(p.regex, text)) == _walk(path, p.include)


def test_pattern_stays_on_one_path(spark):
    p = P.compile_pattern("1 2")
    df = spark.createDataFrame([([" 3 1 ", " 2 4 "],), ([" 1 2 "],)], "paths array<string>")
    assert [r[0] for r in df.select(p.accepts("paths")).collect()] == [False, True]
    x = P.compile_pattern("1 !4")
    assert [r[0] for r in df.select(x.accepts("paths")).collect()] == [False, True]


# ---------------------------------------------------------------- texts

def test_query_kinds(spark):
    q = {"": "empty", "  ": "empty", "AS-FOO": "asset", "AS2914:AS-GLOBAL": "asset", "radb::as-foo": "asset", "2001:db8::/32": "ipv6", "2001:zz": "text", "1.2.3.4": "ipv4",
         "1.2.3.0/24": "ipv4", "1.2.3.400": "text", "mozz.ie": "domain", "x.y/z": "text", "AS15169": "asn", "asn 42": "asn", "4294967295": "asn", "google": "name"}
    assert one(spark, list(q), X.query_kind) == list(q.values())


def test_domains_and_dates(spark):
    assert one(spark, ["a.b.example.co.uk", "mail.google.com.", "x", "co.uk", "WWW.Foo.org"], X.registrable_domain) == ["example.co.uk", "google.com", "x", "co.uk", "foo.org"]
    assert one(spark, ["foo.dn42", "a.com", "-a.com", "xn--p1ai.xn--p1ai"], X.is_domain) == [False, True, False, True]
    assert one(spark, ["foo.dn42"], lambda c: X.is_domain(c, "private")) == [True]
    assert one(spark, ["2026-4-1T00:00", "2026/04/01 (JST)", "2002. 06. 28.", "soon ", ""], X.iso_date) == ["2026-04-01", "2026-04-01", "2002-06-28", "soon", ""]


def test_names(spark):
    assert one(spark, ["中国 (电信) CN2  x", "abc", None], X.strip_cjk) == ["CN2 x", "abc", ""]
    assert one(spark, ["HK", "DE", "XX"], lambda c: X.country_label("en", c, F.when(c == "DE", "Germany"))) == ["Hong Kong (HK)", "Germany (DE)", "XX (XX)"]


def test_small_numbers(spark):
    assert one(spark, [1.25, 0.05, 2.0], lambda c: half_up(c, 1), "double") == [1.3, 0.1, 2.0]
    rows = [(None, 1.0, ""), (0.0, 0.0, ""), (1.0, 2.0, "AnyCast node"), (1.0, 2.0, None)]
    assert [r[0] for r in col_values(spark, rows, "a double, b double, t string", unusable_place(F.col("a"), F.col("b"), F.col("t")))] == [True, True, True, False]

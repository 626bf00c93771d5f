"""Internet addresses as Spark columns.

Two physical forms, chosen by what a table holds:

* IPv4 only: one ``BIGINT``.
* IPv6, or both families together: ``STRUCT<hi BIGINT, lo BIGINT>``, each half with its sign bit flipped
  so that Spark's signed order is the unsigned order. Such structs sort, group, join and window as they
  are, and ``hi`` as a leaf column gets Parquet statistics.

Nothing here runs Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

SIGN = -(1 << 63)
WIDE_TYPE = "struct<hi:bigint,lo:bigint>"
V4_RE = r"^\d{1,3}(\.\d{1,3}){3}$"


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shl(value, bits) -> Column:
    return F.call_function("shiftleft", value, bits)


# ---------------------------------------------------------------- IPv4

def v4_int(text) -> Column:
    """Dotted quad to its number; NULL unless four decimal octets up to 255."""
    t = F.trim(_as_col(text))
    octets = [F.split_part(t, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    ok = t.rlike(V4_RE)
    for o in octets:
        ok = ok & (o <= 255)
    return F.when(ok, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def v4_text(number) -> Column:
    """Number to dotted quad."""
    n = _as_col(number)
    dot = F.lit(".")
    octets = [F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(octets[0], dot, octets[1], dot, octets[2], dot, octets[3])  # NULL stays NULL


def v4_size(plen) -> Column:
    return _shl(F.lit(1).cast("bigint"), F.lit(32) - _as_col(plen).cast("int"))


def v4_mask(number, plen) -> Column:
    """Network address of ``number`` at length ``plen``."""
    n = _as_col(number)
    return n - n % v4_size(plen)


def v4_range(text) -> Column:
    """Address or CIDR text to ``struct(start, end, plen, is_cidr)``; NULL when malformed."""
    t = F.trim(_as_col(text))
    ok = t.rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$")
    base = v4_int(F.split_part(t, F.lit("/"), F.lit(1)))
    cidr = F.contains(t, F.lit("/"))
    plen = F.when(cidr, F.split_part(t, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))
    start = v4_mask(base, plen)
    good = ok & base.isNotNull() & (plen <= 32)
    return F.when(good, F.struct(
        start.alias("start"), (start + v4_size(plen) - 1).alias("end"), plen.alias("plen"), cidr.alias("is_cidr")))


def v4_cidrs(start, end) -> Column:
    """Closed interval to its minimal CIDR list, ascending.

    At level k the cover can hold one block on the rising left edge and one on the falling right edge;
    both follow directly from ceil(start / 2^k) and floor((end + 1) / 2^k), so no state is carried
    between levels.
    """
    s, stop = _as_col(start), _as_col(end) + 1

    def level(k):
        size = _shl(F.lit(1).cast("bigint"), k)
        left = F.floor((s + size - 1) / size).cast("bigint")
        right = F.floor(stop / size).cast("bigint")
        plen = F.lit(32) - k
        block = lambda at: F.struct((at * size).alias("at"), plen.alias("plen"))
        open_ = left < right
        return F.array(F.when(open_ & (left % 2 == 1), block(left)),
                       F.when(open_ & (right % 2 == 1), block(right - 1)))

    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), level))
    blocks = F.array_sort(F.filter(blocks, lambda b: b.isNotNull()))
    return F.transform(blocks, lambda b: F.concat(v4_text(b["at"]), F.lit("/"), b["plen"].cast("string")))


# ---------------------------------------------------------------- 128 bit

def wide(hi_bits, lo_bits) -> Column:
    """Raw 64-bit halves to the ordered form."""
    return F.struct(hi_bits.bitwiseXOR(F.lit(SIGN)).alias("hi"), lo_bits.bitwiseXOR(F.lit(SIGN)).alias("lo"))


def wide_from_hex(hex32) -> Column:
    def build(h):
        half = lambda p: F.conv(F.substring(h, p, 16), 16, -10).cast("bigint")
        return F.when(h.isNotNull(), wide(half(1), half(17)))
    return let(_as_col(hex32), build)


def wide_hex(point) -> Column:
    """32 lower-case hex digits; fixed width, so text order is numeric order."""
    p = _as_col(point)
    half = lambda f: F.lpad(F.hex(p[f].bitwiseXOR(F.lit(SIGN))), 16, "0")
    return F.lower(F.concat(half("hi"), half("lo")))


def wide_from_v4(number) -> Column:
    n = _as_col(number)
    return F.when(n.isNotNull(), wide(F.lit(0).cast("bigint"), n))


def v4_from_wide(point) -> Column:
    return _as_col(point)["lo"].bitwiseXOR(F.lit(SIGN))


def _v6_groups(text: Column) -> Column:
    """Eight hex groups of lower-case IPv6 text, or NULL."""
    def expand(t):
        first = F.instr(t, "::")
        last = F.length(t) - F.instr(F.reverse(t), "::")
        begins, ends = F.startswith(t, F.lit("::")).cast("int"), F.endswith(t, F.lit("::")).cast("int")
        # A colon between any two groups and one more at the cut, except where the cut is at an end.
        gap = F.lit(8) - (F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))) + begins + ends
        filled = F.replace(t, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), gap)))
        bare = let(filled, lambda x: F.substring(x, begins + 1, F.length(x) - begins - ends))
        return F.when(first == 0, t).when(first == last, bare)

    return let(let(text, expand), lambda t: F.when(t.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$"), F.split(t, ":")))


def _groups_hex(groups: Column) -> Column:
    return let(groups, lambda g: F.concat(*[F.lpad(F.get(g, F.lit(i)), 4, "0") for i in range(8)]))


def v6_point(text) -> Column:
    """IPv6 text (one ``::`` at most, no embedded IPv4) to the ordered form; NULL when malformed."""
    def parse(t):
        ok = t.rlike("^[0-9a-f:]+$") & F.contains(t, F.lit(":"))
        return F.when(ok, wide_from_hex(_groups_hex(_v6_groups(t))))
    return let(F.lower(F.trim(_as_col(text))), parse)


def v6_range(text) -> Column:
    """IPv6 address or CIDR to ``struct(start, end, plen, is_cidr)``; NULL when malformed."""
    def parse(t):
        cidr = F.contains(t, F.lit("/"))
        plen = F.when(cidr, F.split_part(t, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(128))
        base = F.when(t.rlike(r"^[0-9a-fA-F:]+(/\d{1,3})?$"), v6_point(F.split_part(t, F.lit("/"), F.lit(1))))

        def build(x):
            b, n = x["b"], x["n"]
            return F.when(b.isNotNull() & (n <= 128), F.struct(
                WIDE.mask(b, n).alias("start"), WIDE.last(b, n).alias("end"), n.alias("plen"), x["c"].alias("is_cidr")))

        return let(F.struct(base.alias("b"), plen.alias("n"), cidr.alias("c")), build)

    return let(F.trim(_as_col(text)), parse)


def _ones_above(bits: Column, before: int = 0) -> Column:
    """64-bit mask with the top ``bits - before`` bits set: none below 0, all from 64 on and where the length is NULL."""
    return (F.when(bits <= before, F.lit(0).cast("bigint"))
            .when(bits < before + 64, _shl(F.lit(-1).cast("bigint"), (F.lit(before + 64) - bits).cast("int"))).otherwise(F.lit(-1).cast("bigint")))


def _wide_mask(p: Column, bits) -> Column:
    b = _as_col(bits) if not isinstance(bits, int) else F.lit(bits)
    raw = lambda f: p[f].bitwiseXOR(F.lit(SIGN))
    return wide(raw("hi").bitwiseAND(_ones_above(b)), raw("lo").bitwiseAND(_ones_above(b, 64)))


def _wide_last(p: Column, bits) -> Column:
    b = _as_col(bits) if not isinstance(bits, int) else F.lit(bits)
    raw = lambda f: p[f].bitwiseXOR(F.lit(SIGN))
    host = lambda m: F.bitwise_not(m)
    return wide(raw("hi").bitwiseOR(host(_ones_above(b))), raw("lo").bitwiseOR(host(_ones_above(b, 64))))


def _wide_step(p: Column, by: int) -> Column:
    """Neighbour address; NULL past either end of the space."""
    edge, wrap = ((1 << 63) - 1, SIGN) if by > 0 else (SIGN, (1 << 63) - 1)
    hi = F.when(p["lo"] == F.lit(edge), F.try_add(p["hi"], F.lit(by))).otherwise(p["hi"])
    lo = F.when(p["lo"] == F.lit(edge), F.lit(wrap)).otherwise(F.try_add(p["lo"], F.lit(by)))
    return F.when(p.isNotNull() & hi.isNotNull(), F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo")))


@dataclass(frozen=True)
class Axis:
    """What interval operators need to know about an address column's physical form."""

    name: str
    type: str
    succ: Callable[[Column], Column]
    pred: Callable[[Column], Column]
    _mask: Callable
    _last: Callable
    v4_offset: int

    def _bits(self, plen, family):
        b = F.lit(plen) if isinstance(plen, int) else _as_col(plen)
        if family is not None and self.v4_offset:
            b = b + F.when(_as_col(family) == 4, F.lit(self.v4_offset)).otherwise(F.lit(0))
        return b

    def mask(self, point, plen, family=None) -> Column:
        """First address of the block of length ``plen`` around ``point``."""
        return self._mask(_as_col(point), self._bits(plen, family))

    def last(self, point, plen, family=None) -> Column:
        """Last address of that block."""
        return self._last(_as_col(point), self._bits(plen, family))


NARROW = Axis("narrow", "bigint", lambda p: p + 1, lambda p: p - 1, v4_mask,
              lambda p, b: v4_mask(p, b) + v4_size(b) - 1, 0)
WIDE = Axis("wide", WIDE_TYPE, lambda p: _wide_step(p, 1), lambda p: _wide_step(p, -1), _wide_mask, _wide_last, 96)


def axis_of(df: DataFrame, column: str = "ip_start") -> Axis:
    kind = df.schema[column].dataType
    if isinstance(kind, LongType):
        return NARROW
    if isinstance(kind, StructType):
        return WIDE
    raise TypeError(f"{column}: {kind.simpleString()} is no address column")


def family_width(family) -> Column:
    return F.when(_as_col(family) == 4, F.lit(32)).otherwise(F.lit(128))


# ---------------------------------------------------------------- text forms

def _half_text(half: Column) -> Column:
    """Groups of one word of a wide address, each behind a colon."""
    # The flipped sign bit is in the first group.
    first = F.shiftright(half, 48).bitwiseXOR(F.lit(32768))
    words = [F.hex(x.bitwiseAND(65535)) for x in (first, *[F.shiftright(half, n) for n in (32, 16, 0)])]
    return F.lower(F.concat(*[x for w in words for x in (F.lit(":"), w)]))


def _shortened(groups: Column) -> Column:
    """Eight groups, each behind a colon, to RFC 5952 text."""
    def cut(t):
        bare = F.substring(t, 2, 39)  # without the first colon
        out = bare
        for n in range(2, 9):  # the longest run is asked for first
            run = ":0" * n
            at = F.instr(F.concat(t, F.lit(":")), run + ":")
            tail = F.substring(t, at + len(run), F.lit(40))
            cut_out = F.concat(F.substring(t, F.lit(2), at - 2), F.lit("::"), F.substring(tail, 2, 39))
            out = F.when(at > 0, cut_out).otherwise(out)
        return F.when(F.contains(t, F.lit(":0:0")), out).otherwise(bare)

    return let(groups, cut)


def wide_text(point) -> Column:
    """RFC 5952 text: lower case, no leading zeros, the first longest run of two or more zero groups cut."""
    return let(_as_col(point), lambda p: _shortened(F.concat(_half_text(p["hi"]), _half_text(p["lo"]))))


def canonical_v4(text) -> Column:
    """Dotted quad without leading zeros; anything else unchanged."""
    return F.coalesce(v4_text(v4_int(text)), _as_col(text))


def _embedded_v4(text: Column) -> Column:
    """Rewrite a trailing dotted quad as two hex groups; NULL when the quad is bad."""
    def rewrite(t):
        quad = F.regexp_extract(t, r"([^:]*\.[^:]*)$", 1)

        def words(n):
            word = lambda shift: F.lower(F.hex(F.shiftright(n, shift).bitwiseAND(65535)))
            return F.concat(word(16), F.lit(":"), word(0))

        head = F.substring(t, F.lit(1), F.length(t) - F.length(quad))
        return F.when(~F.contains(t, F.lit(".")) | (quad == ""), t).otherwise(F.concat(head, let(v4_int(quad), words)))
    return let(text, rewrite)


def canonical_v6(text) -> Column:
    """RFC 5952 text of an IPv6 address in any spelling; anything else unchanged."""
    raw = _as_col(text)
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"^\[|\]$", ""), "%.*$", "")
    # Groups may carry extra leading zeros here; "::" must stand for at least one group.
    t = F.regexp_replace(_embedded_v4(t), "(^|:)0+([0-9a-f]{1,4})(?=:|$)", "$1$2")

    def read(x):
        full = F.contains(x, F.lit("::")) & (F.size(F.array_remove(F.split(x, ":"), "")) >= 8)
        return F.when(~full, wide_text(wide_from_hex(_groups_hex(_v6_groups(x)))))

    return F.coalesce(let(t, read), raw)


def normalize_ip(text) -> Column:
    return let(_as_col(text), lambda t: F.when(F.contains(t, F.lit(":")), canonical_v6(t)).otherwise(canonical_v4(t)))


def is_private(text) -> Column:
    """Private, loopback, link-local, shared or malformed address text."""
    def four(octets):
        # An empty octet reads as zero.
        a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
        bad = (F.size(octets) != 4) | F.exists(octets, lambda o: o.isNull())
        return (bad | a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
                | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))

    def test(t):
        octets = F.transform(F.split(t, r"\."), lambda o: F.when(F.trim(o) == "", F.lit(0.0)).otherwise(o.try_cast("double")))
        six = F.lower(t).rlike("^(?:::1$|fe[89ab]|f[cd])")
        return (F.when(F.coalesce(t, F.lit("")) == "", F.lit(True))
                .when(F.contains(t, F.lit(":")), six).otherwise(let(octets, four)))

    return F.coalesce(let(_as_col(text), test), F.lit(True))


_GROUP = "[0-9a-f]{1,4}+"
_SOME = f"(?:{_GROUP}(?::{_GROUP})*+)?+"
#: Eight groups, or at most eight around one cut.
_V6_RE = f"^(?:{_GROUP}(?::{_GROUP}){{7}}|(?!:*(?:[0-9a-f]++:++){{8}}[0-9a-f]){_SOME}::{_SOME})\\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _digits(six: Column) -> Column:
    """32 hex digits of lower-case IPv6 text, or NULL."""
    padded = lambda x: F.array_join(F.transform(F.array_remove(F.split(x, ":"), ""), lambda g: F.lpad(g, 4, "0")), "")

    def write(h):
        cut = let(padded(F.split_part(h, F.lit("::"), F.lit(2))),
                  lambda rest: F.concat(F.rpad(padded(F.split_part(h, F.lit("::"), F.lit(1))), F.lit(32) - F.length(rest), F.lit("0")), rest))
        return F.when(h.rlike(_V6_RE), F.when(F.contains(h, F.lit("::")), cut).otherwise(padded(h)))

    return let(six, write)


def cidr_bounds(text) -> Column:
    """Network text of either family to ``struct(family, plen, ip_start, ip_end)`` (wide form).

    Host bits are cleared; a bare address is a full-length network; NULL when malformed.
    """
    def parse(t):
        tail = F.split_part(t, F.lit("/"), F.lit(2))

        def address(a):
            o = [F.split_part(a, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
            four = F.when(a.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), wide_from_v4(o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]))
            spelt = F.when(F.contains(a, F.lit(".")), _embedded_v4(a)).otherwise(a)
            v6 = F.contains(a, F.lit(":"))
            return F.when(v6, F.struct(F.lit(6).alias("f"), wide_from_hex(_digits(spelt)).alias("p"))).otherwise(F.struct(F.lit(4).alias("f"), four.alias("p")))

        def build(x):
            f, p = x["f"], x["p"]
            plen = F.when(~F.contains(t, F.lit("/")), family_width(f)).otherwise(F.when(tail.rlike(r"^\d{1,3}$"), tail.try_cast("int")))

            def write(n):
                bits = n["n"] + n["o"]
                return F.when(p.isNotNull() & (bits <= 128), F.struct(
                    f.alias("family"), n["n"].alias("plen"), _wide_mask(p, bits).alias("ip_start"), _wide_last(p, bits).alias("ip_end")))

            return let(F.struct(plen.alias("n"), (F.lit(128) - family_width(f)).alias("o")), write)

        return let(let(F.split_part(t, F.lit("/"), F.lit(1)), address), build)

    return let(F.lower(F.trim(_as_col(text))), parse)


def point_of(text, axis: Axis) -> Column:
    """Address text of either family to ``struct(family, ip)``; on a narrow axis IPv6 has no point. NULL point when malformed."""
    def parse(t):
        six = F.contains(t, F.lit(":"))
        four = v4_int(t) if axis is NARROW else wide_from_v4(v4_int(t))
        far = F.lit(None).cast(axis.type) if axis is NARROW else F.when(~F.contains(t, F.lit("/")), cidr_bounds(t)["ip_start"])
        return F.struct(F.when(six, 6).otherwise(4).alias("family"), F.when(six, far).otherwise(four).alias("ip"))

    return let(_as_col(text), parse)


def network_text(family, point, plen) -> Column:
    """CIDR text of a wide network address."""
    addr = F.when(_as_col(family) == 4, v4_text(v4_from_wide(point))).otherwise(wide_text(point))
    return F.concat(addr, F.lit("/"), _as_col(plen).cast("string"))


# ---------------------------------------------------------------- 128-bit CIDR lists

def _trailing_zeros(hi: Column, lo: Column) -> Column:
    """Zero bits at the end of a raw 128-bit number; 128 for zero."""
    ends = lambda x: F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0")))
    return F.when(lo != 0, ends(lo)).when(hi != 0, ends(hi) + 64).otherwise(F.lit(128))


def _bit(hi: Column, lo: Column, k: Column) -> Column:
    """Bit ``k`` of a raw 128-bit number, counted from its end."""
    return F.call_function("shiftright", F.when(k < 64, lo).otherwise(hi), k).bitwiseAND(F.lit(1).cast("bigint"))


def _span(a: Column, b: Column) -> Column:
    """Whole numbers from a to b, none when b is smaller."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def wide_blocks(start, end) -> Column:
    """Closed interval in wide form to its minimal list of blocks, ascending: structs (at, bits), a block having 2^bits addresses.

    Let d be the highest bit in which the ends differ. Below it the start climbs to the middle and the end descends from it: the
    start's own block spans its trailing zeros, and every further zero bit of the start below d is a block to its right; the end's block spans
    its trailing ones, and every further one bit of the end is a block to its left. Only bits of the two words are read, so
    nothing carries and the ends of the space are no special case.
    """
    def words(p):
        x = _as_col(p)
        return x["hi"].bitwiseXOR(F.lit(SIGN)), x["lo"].bitwiseXOR(F.lit(SIGN))

    (sh, sl), (eh, el) = words(start), words(end)
    raw = F.struct(sh.alias("sh"), sl.alias("sl"), eh.alias("eh"), el.alias("el"))

    def measure(r):
        xh, xl = r["sh"].bitwiseXOR(r["eh"]), r["sl"].bitwiseXOR(r["el"])
        d = F.when(xh != 0, F.length(F.bin(xh)) + 63).when(xl != 0, F.length(F.bin(xl)) - 1).otherwise(F.lit(-1))
        ones = _trailing_zeros(F.bitwise_not(r["eh"]), F.bitwise_not(r["el"]))
        return F.struct(r.alias("r"), d.alias("d"), F.least(d, _trailing_zeros(r["sh"], r["sl"])).alias("t"), F.least(d, ones).alias("u"))

    def block(point, bits):
        return F.struct(point.alias("at"), bits.cast("int").alias("bits"))

    def cover(m):
        r, d, t, u = m["r"], m["d"], m["t"], m["u"]
        s, e = wide(r["sh"], r["sl"]), wide(r["eh"], r["el"])

        def beside(p, k):
            # Bit k turned over and all below it cleared, which is the same in the flipped words; a shift by k + 64 is one by k.
            turned = lambda x: _shl(F.call_function("shiftright", x, k).bitwiseXOR(F.lit(1).cast("bigint")), k)
            at = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))
            return block(F.when(k < 64, at(p["hi"], turned(p["lo"]))).otherwise(at(turned(p["hi"]), F.lit(SIGN))), k)

        up = F.transform(F.filter(_span(t + 1, d - 1), lambda k: _bit(r["sh"], r["sl"], k) == 0), lambda k: beside(s, k))
        down = F.transform(F.filter(F.reverse(_span(u + 1, d - 1)), lambda k: _bit(r["eh"], r["el"], k) == 1), lambda k: beside(e, k))
        ends = F.concat(F.array(block(s, t)), up, down, F.array(block(_wide_mask(e, F.lit(128) - u), u)))
        return F.when(d < 0, F.array(block(s, F.lit(0)))).when((t == d) & (u == d), F.array(block(s, d + 1))).otherwise(ends)

    good = _as_col(start).isNotNull() & _as_col(end).isNotNull() & (_as_col(start) <= _as_col(end))
    return F.when(good, let(let(raw, measure), cover))


def wide_cidrs(family, start, end) -> Column:
    """Closed interval in wide form to its minimal CIDR list (at most 254 entries a row), in built-in functions alone."""
    width = family_width(family)

    def write(ends):
        def text(b):
            # Most blocks share the upper word of an end, whose text is made once.
            hi, lo = b["at"]["hi"], b["at"]["lo"]
            upper = F.when(hi == ends["sh"], ends["st"]).when(hi == ends["eh"], ends["et"]).otherwise(_half_text(hi))
            at = F.when(_as_col(family) == 4, v4_text(v4_from_wide(b["at"]))).otherwise(_shortened(F.concat(upper, _half_text(lo))))
            return F.concat(at, F.lit("/"), (width - b["bits"]).cast("string"))

        return F.transform(wide_blocks(start, end), text)

    s, e = _as_col(start)["hi"], _as_col(end)["hi"]
    return let(F.struct(s.alias("sh"), _half_text(s).alias("st"), e.alias("eh"), _half_text(e).alias("et")), write)


def interval_cidrs(axis: Axis, family, start, end) -> Column:
    return v4_cidrs(start, end) if axis is NARROW else wide_cidrs(family, start, end)

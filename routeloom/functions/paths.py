"""AS_PATH columns and the path pattern language.

A path is ``ARRAY<BIGINT>`` from the collector side (first) to the origin (last). Its text form has one
blank between numbers; the padded text form also starts and ends with one.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .fixed import TIER1


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_path(asns) -> Column:
    """Collapse consecutive repeats (prepending); later returns of an AS stay."""
    a = _as_col(asns)
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def path_key(asns) -> Column:
    return F.array_join(_as_col(asns).cast("array<string>"), " ")


def padded(path_text) -> Column:
    return F.concat(F.lit(" "), _as_col(path_text), F.lit(" "))


def path_array(path_text) -> Column:
    """Path text to numbers; unreadable tokens become NULL."""
    return F.transform(F.split(_as_col(path_text), " "), lambda t: t.try_cast("bigint"))


def is_tier1(asn) -> Column:
    return _as_col(asn).isin(TIER1)


def passes_tier1(asns) -> Column:
    return F.exists(_as_col(asns), is_tier1)


def first_tier1(asns) -> Column:
    """1-based place of the first Tier-1, NULL when there is none."""
    places = F.transform(_as_col(asns), is_tier1)
    return F.nullif(F.array_position(places, True).cast("int"), F.lit(0))


def from_first_tier1(asns) -> Column:
    """The part from the first Tier-1 on; without one, everything but the first hop of a longer path."""
    a = _as_col(asns)
    at = first_tier1(a)
    return (F.when(at.isNotNull(), F.slice(a, at, F.size(a)))
            .when(F.size(a) > 1, F.slice(a, F.lit(2), F.size(a)))
            .otherwise(a))


def contains_sequence(asns, sequence: list[int]) -> Column:
    """Are the numbers adjacent and in this order somewhere on the path?"""
    a, m = _as_col(asns), len(sequence)
    if m == 0:
        return F.lit(True)
    want = F.array(*[F.lit(int(x)).cast("bigint") for x in sequence])
    starts = F.sequence(F.lit(1), F.size(a) - (m - 1))
    return F.when(F.size(a) >= m, F.exists(starts, lambda i: F.slice(a, i, F.lit(m)) == want)).otherwise(False)


def hop_before_origin(asns) -> Column:
    """Nearest hop on the collector side that is not the origin itself."""
    a = _as_col(asns)
    return F.try_element_at(F.filter(a, lambda x: x != F.try_element_at(a, F.lit(-1))), F.lit(-1))


def named_asn(asn, name) -> Column:
    a, n = _as_col(asn).cast("string"), _as_col(name)
    return F.when(F.coalesce(n, F.lit("")) != "", F.concat(a, F.lit("("), n, F.lit(")"))).otherwise(a)


# ---------------------------------------------------------------- pattern language

@dataclass(frozen=True)
class PathPattern:
    """A compiled path query.

    ``include`` alternates numbers and gaps; a gap is ``"*"`` (any number of hops) or a hop count.
    ``exclude`` holds networks the whole prefix must avoid.
    """

    include: tuple
    exclude: tuple[int, ...]

    @property
    def has_include(self) -> bool:
        return bool(self.include)

    @property
    def empty(self) -> bool:
        return not self.include and not self.exclude

    @property
    def regex(self) -> str | None:
        """Regular expression over padded path text; it cannot leave the path it starts on."""
        if not self.include:
            return None
        piece = {True: lambda t: f"{t[1]} ", False: lambda t: "(?:[0-9]+ )*" if t[1] == "*" else f"(?:[0-9]+ ){{{t[1]}}}"}
        return " " + "".join(piece[t[0] == "asn"](t) for t in self.include)

    def matches(self, padded_path) -> Column:
        """Does one padded path hold the include part? True when there is none."""
        p = _as_col(padded_path)
        if not self.include:
            return F.lit(True)
        if all(kind == "asn" for kind, _ in self.include):
            return F.contains(p, F.lit(self.regex))
        return p.rlike(self.regex)

    def any_path(self, padded_paths) -> Column:
        """Some path of the array holds the include part."""
        return F.exists(_as_col(padded_paths), self.matches) if self.include else F.lit(True)

    def avoids(self, padded_paths) -> Column:
        """No path of the array passes an excluded network."""
        arr = _as_col(padded_paths)
        cond = F.lit(True)
        for asn in self.exclude:
            word = F.lit(f" {asn} ")
            cond = cond & ~F.exists(arr, lambda p: F.contains(p, word))
        return cond

    def accepts(self, padded_paths) -> Column:
        return self.any_path(padded_paths) & self.avoids(padded_paths)

    def best_hit(self, best_path) -> Column:
        """Does the best path hold the include part? False without an include part or a path."""
        if not self.include:
            return F.lit(False)
        return F.coalesce(self.matches(best_path), F.lit(False))

    def summary(self) -> str:
        show = [str(v) if k == "asn" else ("*" if v == "*" else "?" * v) for k, v in self.include]
        return " ".join([*([" ".join(show)] if show else []), *[f"!{x}" for x in self.exclude]])


_WORD = re.compile(r"(?P<any>\*+)|(?P<hops>\?+)|[!-](?P<out>\d+)|(?P<asn>\d+)")


def compile_pattern(query: str | None) -> PathPattern:
    """Compile ``1299 * 4809 !174`` and the like.

    Numbers are hops, ``*`` any gap, each ``?`` one hop, ``!N`` or ``-N`` an exclusion; ``->`` and commas
    separate; anything else is ignored. Gaps at either end say nothing and are dropped, neighbouring gaps
    fuse.
    """
    words = (_WORD.fullmatch(w) for w in re.sub(r"->|,", " ", query or "").split())
    steps, exclude = [], []
    for m in filter(None, words):
        if m["out"]:
            exclude.append(int(m["out"]))
        elif m["asn"]:
            steps.append(("asn", int(m["asn"])))
        else:
            steps.append(("gap", "*" if m["any"] else len(m["hops"])))
    include = []
    for kind, run in itertools.groupby(steps, key=lambda s: s[0]):
        values = [v for _, v in run]
        include += [("asn", v) for v in values] if kind == "asn" else [("gap", "*" if "*" in values else sum(values))]
    if include and include[0][0] == "gap":
        include = include[1:]
    if include and include[-1][0] == "gap":
        include = include[:-1]
    return PathPattern(tuple(include), tuple(exclude))


def parse_sequence(text: str | None) -> list[int]:
    """The plain numbers of a path query."""
    return [int(w) for w in re.sub(r"->|,", " ", text or "").split() if w.isdigit()]

"""Names, labels, dates and query texts as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import addr
from .fixed import (AUTHORITATIVE, COUNTRY_OVERRIDE, IRR_LABELS, RPKI_LABELS, SECOND_LEVEL)

_CJK = "\\u3400-\\u9fff\\uf900-\\ufaff\\u3040-\\u30ff"
_TLD = {"public": r"(?:\p{L}{2,}|xn--[\p{L}\p{N}-]{2,})",
        "private": r"(?:\p{L}[\p{L}\p{N}]+|xn--[\p{L}\p{N}-]{2,})"}


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


# ---------------------------------------------------------------- domains and query texts

def is_domain(text, network: str = "public") -> Column:
    t = F.trim(_as_col(text))
    label = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
    return t.rlike(rf"^(?=.{{1,253}}\.?$)(?:{label}\.)+{_TLD[network]}\.?$")


def registrable_domain(text) -> Column:
    """The last two labels, or three when the second-last is a known second-level suffix."""
    labels = F.array_remove(F.split(F.regexp_replace(F.lower(_as_col(text)), r"\.$", ""), r"\."), "")
    n = F.size(labels)
    keep = F.when(F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL), F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(labels, F.greatest(n - keep, F.lit(0)) + 1, F.greatest(keep, F.lit(1))), ".")


def is_set_name(text) -> Column:
    u = F.upper(F.trim(_as_col(text)))
    hierarchical = F.when(F.contains(u, F.lit("::")), u.rlike(r"::AS-?\w")).otherwise(u.rlike(r"^AS-|^AS\d+:AS|:AS-"))
    return u.rlike(r"^[A-Z0-9:_.-]+$") & ~u.rlike(r"^AS\d+$") & hierarchical


def query_kind(text, network: str = "public") -> Column:
    """What a search text asks for: empty, asset, ipv6, ipv4, domain, text, asn or name."""
    t = F.trim(F.coalesce(_as_col(text), F.lit("")))
    dotted = F.contains(t, F.lit(".")) | F.contains(t, F.lit("/"))
    return (F.when(t == "", "empty")
            .when(is_set_name(t), "asset")
            .when(F.contains(t, F.lit(":")), F.when(addr.v6_range(t).isNotNull(), "ipv6").otherwise("text"))
            .when(dotted & addr.v4_range(t).isNotNull(), "ipv4")
            .when(dotted & is_domain(t, network), "domain")
            .when(dotted, "text")
            .when(t.rlike(r"(?i)^(?:asn?\s*)?[0-4]?\d{1,9}$"), "asn")
            .otherwise("name"))


def query_asn(text) -> Column:
    """The number of an ``asn`` query."""
    return F.regexp_extract(F.trim(_as_col(text)), r"(?i)^(?:asn?\s*)?([0-4]?\d{1,9})$", 1).try_cast("bigint")


def iso_date(text) -> Column:
    """The first year-month-day in dash, slash or dot form as YYYY-MM-DD; otherwise the trimmed text."""
    t = _as_col(text)
    dash, other = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})[./]\s*(\d{1,2})[./]\s*(\d{1,2})"

    def form(rx):
        return F.concat_ws("-", F.regexp_extract(t, rx, 1), *[F.lpad(F.regexp_extract(t, rx, i), 2, "0") for i in (2, 3)])

    return F.when(t.rlike(dash), form(dash)).when(t.rlike(other), form(other)).otherwise(F.trim(t))


# ---------------------------------------------------------------- names

def has_cjk(text) -> Column:
    return F.coalesce(_as_col(text), F.lit("")).rlike(f"[{_CJK}]")


def strip_cjk(text) -> Column:
    t = F.regexp_replace(F.coalesce(_as_col(text), F.lit("")), f"[{_CJK}]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\(\s*\)", ""), r"\s{2,}", " "))


def _present(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def asn_name(lang: str, registry_name, registry_name_en, full_name) -> Column:
    """Display name from the registry entry, its English alias and the public full name."""
    reg, en, full = (_present(_as_col(c)) for c in (registry_name, registry_name_en, full_name))
    if lang == "zh":
        return F.coalesce(reg, full, F.lit(""))
    base = F.coalesce(reg, full, F.lit(""))
    return F.coalesce(en, F.when(~has_cjk(full), full), _present(strip_cjk(base)), full, base)


def country_label(lang: str, cc, name) -> Column:
    """``Name (CC)``; a few names are fixed, an unnamed country shows its code."""
    c = _as_col(cc)
    fixed = F.element_at(literal_map(COUNTRY_OVERRIDE["zh" if lang == "zh" else "en"]), c)
    return F.concat(F.coalesce(fixed, _present(_as_col(name)), c), F.lit(" ("), c, F.lit(")"))


def place_label(lang: str, province, city, cc, country_name) -> Column:
    """Province and city; outside Chinese, parts in CJK script drop out; empty falls back to the country."""
    parts = F.array_compact(F.array(_present(_as_col(province)), _present(_as_col(city))))
    if lang != "zh":
        parts = F.filter(parts, lambda p: ~has_cjk(p))
    joined = F.array_join(parts, " ")
    code = _present(_as_col(cc))
    return F.coalesce(_present(joined), country_label(lang, code, country_name), F.lit(""))


def rpki_label(code) -> Column:
    return F.element_at(literal_map(RPKI_LABELS), F.coalesce(_as_col(code).cast("int"), F.lit(0)))


def irr_label(code) -> Column:
    return F.element_at(literal_map(IRR_LABELS), F.coalesce(_as_col(code).cast("int"), F.lit(0)))


def any_authoritative(sources) -> Column:
    """Is any of the registry names run by an address registry itself?"""
    return F.arrays_overlap(_as_col(sources), F.array(*[F.lit(s) for s in AUTHORITATIVE]))


def place_slug(cc, city) -> Column:
    t = F.lower(F.concat_ws("-", _as_col(cc), _as_col(city)))
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-|-$", "")


def place_key(cc, city) -> Column:
    part = lambda c: F.coalesce(_as_col(c), F.lit(""))
    return F.concat(F.upper(part(cc)), F.lit("|"), F.lower(F.trim(part(city))))

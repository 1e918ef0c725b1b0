"""Column functions whose null, tie and boundary rules are fixed here rather than left to engine defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Unicode space separators (category Zs); tabs and line ends are not among them. Fixed values.
ZS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null where den is not positive."""
    return F.when(den > 0, num / den)


def ne_missing(a: Column, b: Column) -> Column:
    """Inequality in which two nulls are equal."""
    return ~a.eqNullSafe(b)


def trim_zs(x: Column) -> Column:
    return F.btrim(x, F.lit(ZS))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def lookup(x: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Dictionary replacement; x itself where the mapping has no entry, unless a default is given."""
    m = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(F.try_element_at(m, x), default if default is not None else x)


def null_markers(x: Column, markers: Sequence[str] = ("", "-", "--", "N/A", "n/a", "NA")) -> Column:
    """Null for vendor markers of a missing value."""
    return F.when(~F.trim(x).isin(*markers), x)


def vendor_number(x: Column) -> Column:
    """A vendor's number: markers are null, parentheses negate, thousands separators go."""
    body = F.trim(null_markers(x))
    bare = F.regexp_replace(body, r"[(),\s]", "").try_cast("double")
    return F.when(body.startswith("("), -bare).otherwise(bare)


def pct_rank(value: Column, *by: Column | str) -> Column:
    """Average-tie percentile rank in (0, 1] among the non-null values of a partition."""
    within = Window.partitionBy(*by, value.isNull())
    below = F.rank().over(within.orderBy(value))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), (below + (peers - 1) / 2) / F.count(F.lit(1)).over(within))


def ffill(value: Column, order: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (pattern, label) whose pattern is found in text."""
    out: Column | None = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default)


def lexicon_pattern(terms: Sequence[str]) -> str:
    """Any of the terms, not inside a longer word, where words are ASCII letters and digits."""
    import re

    return "(?:^|[^a-z0-9])(?:" + "|".join(re.escape(t.lower()) for t in terms) + ")(?:[^a-z0-9]|$)"


def fold_lower(x: Column) -> Column:
    """Lower case that maps the dotted capital I and the capital sigma first, as engines differ on them."""
    return F.lower(F.translate(x, "İΣ", "iσ"))


# Divisions by upper bound of the four-digit code, sectors by ranges of its first two digits (first match).
DIVISIONS = (
    (2000, "Mining & Construction"), (4000, "Manufacturing"), (5000, "Transport & Utilities"), (6000, "Wholesale & Retail"), (6800, "Finance, Ins. & Real Estate"), (9000, "Services"),
)
SECTORS = (
    ("Technology", ((73, 73), (35, 36))), ("Communications", ((48, 48),)), ("Healthcare & Pharma", ((28, 28), (38, 38), (80, 80))), ("Financial Services", ((60, 67),)), ("Industrials & Mfg", ((20, 39),)),
    ("Transportation", ((40, 47),)), ("Utilities", ((49, 49),)), ("Energy & Mining", ((10, 14), (29, 29))), ("Retail & Wholesale", ((50, 59),)), ("Business Services", ((70, 89),)),
)
OTHER_SECTOR = "Other / Diversified"


def sic_division(sic: Column) -> Column:
    """Broad division of an industry code given as text or number; what is no number is diversified."""
    out, code = F.lit(OTHER_SECTOR), sic.cast("string").try_cast("int")
    for high, name in reversed(DIVISIONS):
        out = F.when(code < high, name).otherwise(out)
    return out


def sic_sector(sic: Column) -> Column:
    """Economic sector by the first two digits of the code, padded to four."""
    group = F.substring(F.lpad(sic.cast("string"), 4, "0"), 1, 2).try_cast("int")
    out = F.lit(OTHER_SECTOR)
    for name, spans in reversed(SECTORS):
        hit = F.lit(False)
        for low, high in spans:
            hit = hit | group.between(low, high)
        out = F.when(hit, name).otherwise(out)
    return out


def months_ordinal(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def quarter_ordinal(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1

"""Scalar functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CVE, FRESHNESS, MS_PER_DAY, SEVERITY


def unescaped(value: Column) -> Column:
    """Attribute JSON with its quotes unescaped."""
    return F.replace(value, F.lit('\\"'), F.lit('"'))


def cve_list(value: Column) -> Column:
    """CVE entries of an attribute; null where the text is no such object."""
    return F.from_json(unescaped(value), CVE)["cve"]


def freshness(value: Column) -> Column:
    return F.from_json(unescaped(value), FRESHNESS)["freshness"]


def whole(value: Column) -> Column:
    return value.try_cast("bigint")


def real(value: Column) -> Column:
    return value.try_cast("double")


def when_ms(timestamp: Column) -> Column:
    """Epoch milliseconds, 0 where absent or no number."""
    return F.coalesce(whole(timestamp), F.lit(0))


def days(ms: Column) -> Column:
    return ms / F.lit(MS_PER_DAY)


def severity_score(severity: Column) -> Column:
    out = F.lit(0)
    for name, score in SEVERITY.items():
        out = F.when(severity == name, score).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("bigint")


def cwe_ids(text: Column) -> Column:
    """CWE names in a bracketed list; text without any gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"CWE-\d+"), F.lit(0)), F.array().cast("array<string>"))


def last_tokens(name: Column, n: int = 2, sep: str = ":") -> Column:
    return F.substring_index(name, sep, -n)


def without_last(name: Column, sep: str = ":") -> Column:
    parts = F.split(name, sep)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), sep)


def stacked(name: Column, sep: str = ":") -> Column:
    """Tokens on lines of their own."""
    return F.replace(name, F.lit(sep), F.lit("\n"))


def split_at_dots(name: Column) -> Column:
    """A line break for each of the last two dots."""
    parts = F.split(name, r"\.")
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)))
    tail = F.filter(parts, lambda _, i: i >= F.greatest(F.size(parts) - 2, F.lit(1)))
    return F.array_join(F.concat(F.array(F.array_join(head, ".")), tail), "\n")


def min_max(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); null where there is no spread."""
    return F.try_divide(x - low, high - low)


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Standardised; only centred where the deviation is 0."""
    return F.when(std > 0, (x - mean) / std).otherwise(x - mean)


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """From the sizes of the intersection and of the two sets; null for two empty sets."""
    return F.try_divide(both, a + b - both)


def jaccard_of(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, null for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out

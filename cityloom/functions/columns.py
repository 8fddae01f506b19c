"""Column functions.  All stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they are without (fixed values).
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_text(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 without marks, joined by one space; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), "[^a-z0-9]+", " ")), F.lit(""))


def slugify(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit("_"))


def compact_name(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def name_matches(a: Column, b: Column) -> Column:
    """Equal, or either holds the other; empty names match nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def osm_version(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"@(\d+)$", 1), F.lit("")).cast("int")


def pipe_merge(a: Column, b: Column) -> Column:
    """Ordered distinct union of the tokens of two |-joined lists."""
    tokens = F.array_distinct(F.concat(F.split(F.coalesce(a, F.lit("")), r"\|"), F.split(F.coalesce(b, F.lit("")), r"\|")))
    return F.array_join(F.filter(tokens, lambda x: x != ""), "|")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def settlement_intensity(built: Column, density: Column) -> Column:
    return 0.5 * clamp(built / 100) + 0.5 * clamp(density / 1000)


def classify_breaks(c: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; values not over 0 have none, values over the last break the last label."""
    out = F.when(c <= 0, None)
    for b, name in zip(breaks, labels, strict=False):
        out = out.when(c <= b, name)
    return out.when(c > breaks[-1], labels[len(breaks)])


def first_valid(values: Sequence[Column], low: float = 0.5, high: float = 100.0) -> Column:
    return F.coalesce(*(F.when(v.between(low, high), v) for v in values))


def valid_values(values: Sequence[Column], low: float = 0.5, high: float = 100.0) -> Column:
    return F.filter(F.array(*values), lambda v: v.between(low, high))


def count_of_valid(values: Sequence[Column], **limits: float) -> Column:
    return F.size(valid_values(values, **limits))


def range_of_valid(values: Sequence[Column], least: int = 2, **limits: float) -> Column:
    """Largest less smallest valid value; null where fewer than ``least`` are valid."""
    v = valid_values(values, **limits)
    return F.when(F.size(v) >= least, F.array_max(v) - F.array_min(v))


def row_median(values: Sequence[Column], least: int = 1) -> Column:
    v = F.sort_array(F.filter(F.array(*values), lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n >= least, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def compactness(area: Column, perimeter: Column) -> Column:
    return clamp(F.try_divide(4 * F.pi() * area, perimeter * perimeter))


def rel_diff(a: Column, b: Column, floor: float = 1.0) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


def overlap_area(a: str, b: str) -> Column:
    """Area shared by two rectangles with columns x0, y0, x1, y1 under two prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    return F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))) * F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))

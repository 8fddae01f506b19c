"""Rules of the domain as column functions: coercions, keys, filters, flags, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean true (fixed values).
TRUE = ("true", "t", "1", "yes", "y")
#: Road classes (fixed values).
MAIN, LINKS = ("motorway", "trunk", "primary"), ("motorway_link", "trunk_link", "primary_link")


def no(c: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(c, F.lit(False))


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    return no(F.lower(F.trim(c)).isin(*TRUE))


def get_year(c: Column) -> Column:
    return to_float(c).cast("int")


def normalize_join_key(c: Column) -> Column:
    """'7', '7.0' and ' 7 ' are '7'; other texts are trimmed, empty ones null."""
    d = to_float(c)
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(F.nullif(F.trim(c), F.lit("")))


def block_number(c: Column) -> Column:
    """The number in blk_14484 or _401: the first run of digits after an underscore."""
    return F.nullif(F.regexp_extract(c, r"_(\d+)", 1), F.lit("")).cast("long")


def zone_key(parts: Sequence[Column]) -> Column:
    return F.concat_ws("_", *(F.coalesce(F.replace(p, F.lit("_"), F.lit("-")), F.lit("NULL")) for p in parts))


def keeps_main_roads(highway: Column) -> Column:
    """Main classes, and lists that mix a link class with another; plain link classes go."""
    base = no(F.contains(highway, F.lit(MAIN[0])) | F.contains(highway, F.lit(MAIN[1])) | F.contains(highway, F.lit(MAIN[2])))
    has = [F.contains(highway, F.lit(x)) for x in LINKS]
    mixed = [h & (highway != x) for h, x in zip(has, LINKS, strict=True)]
    return base & (~(has[0] | has[1] | has[2]) | mixed[0] | mixed[1] | mixed[2])


def vehicle_road(highway: Column, area: Column, allowed: Sequence[str]) -> Column:
    return no(highway.isin(*allowed)) & ~area.eqNullSafe("yes")


def osm_water(geom: Column, waterway: Column, natural: Column, water: Column, ways: Sequence[str], waters: Sequence[str]) -> Column:
    """'line', 'polygon' or null, by geometry type and tags."""
    way, body = no(waterway.isin(*ways)), no(natural == "water") & (water.isNull() | water.isin(*waters))
    return F.when(geom.isin("LineString", "MultiLineString") & way, "line").when(geom.isin("Polygon", "MultiPolygon") & (body | no(natural == "wetland") | way), "polygon")


def false_positive_a(year: Column, outlier: Column, cls: Column, prob: Column, g25: Column, confidence: Column, provider: Column) -> Column:
    """Protective checks first, then the outlier rule or the rule of low support."""
    text = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    built = text(cls) == "built"
    recent = (text(provider) != "3d-globfp") & no(year >= 2023)
    strong = built & (F.coalesce(prob, F.lit(0.0)) >= 0.60)
    weak = ~built | prob.isNull() | (prob < 0.60)
    rule_a = to_bool(outlier) & weak & (text(confidence) != "high")
    rule_b = no(g25 <= 0.10) & no(year < 2024)
    return ~recent & ~strong & (rule_a | rule_b)


def false_positive_b1(outlier: Column, cls: Column, prob: Column, confidence: Column) -> Column:
    unlike = lambda c, v: ~c.eqNullSafe(v)
    return (no(outlier) & unlike(confidence, "high") & unlike(cls, "built")) | (no(cls == "built") & no(prob < 0.6))


def false_positive_b2(g25: Column, provider: Column, year: Column) -> Column:
    return no(g25 < 0.1) & (~provider.eqNullSafe("OSM") | no(year > 2023))


def screening(hh: Column, cc: Column, area: Column, population: Column) -> dict[str, Column]:
    """The flags of large blocks of one kind, of both kinds, and of many people."""
    big = no(area > 100_000)
    return {"hh_cc": (hh & cc).cast("int"), "hh_big": (hh & ~cc & big).cast("int"), "cc_big": (cc & ~hh & big).cast("int"), "large_pop": no(population > 1000).cast("int")}


def heterogeneity(hh_cc: Column, hh_big: Column, cc_big: Column) -> Column:
    return F.when(hh_cc == 1, 1).when(hh_big == 1, 2).when(cc_big == 1, 3).otherwise(0)


def confidence(osm: Column, support: Column, version: Column, height: Column) -> Column:
    """Later rules go before earlier ones."""
    fill = ~osm & height.isNotNull()
    return F.when(fill & ~no(support), "medium").when(~osm & no(support), "medium").when(osm & (no(support) | no(version >= 2)), "high").when(osm, "medium").otherwise("low")


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def n_pct(n: Column, total: Column) -> Column:
    """Such as '1,234 (5.6%)'."""
    return F.concat(F.format_number(F.round(n), 0), F.lit(" ("), F.format_number(100 * n / total, 1), F.lit("%)"))


def smoothed(label: Column, best: Column, own_share: Column, best_share: Column, prob: Column) -> tuple[Column, Column]:
    """The label and the reason, by the two rules of neighbour shares."""
    own, alt = F.coalesce(own_share, F.lit(0.0)), F.coalesce(best_share, F.lit(0.0))
    one = best.isNotNull() & (own <= 0.15) & (alt >= 0.85)
    two = best.isNotNull() & (own <= 0.25) & (alt >= 0.75) & no(prob <= 0.50)
    return F.when(one | two, best).otherwise(label), F.when(one, "rule1").when(two, "rule2").otherwise("kept")

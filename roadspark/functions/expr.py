"""Scalar rules of the domain as Column expressions; all stay inside code generation but :func:`safe_id`."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

# Synonyms of road types, and label priorities from lowest to highest.
HIGHWAY_SYNONYMS = {
    "motorway_link": "motorway", "trunk_link": "trunk", "primary_link": "primary", "secondary_link": "secondary",
    "tertiary_link": "tertiary", "living_street": "residential", "unclassified": "residential", "track": "service",
    "footway": "non_motorised", "pedestrian": "non_motorised", "path": "non_motorised", "busway": "non_motorised",
}
HIGHWAY_PRIORITY = ["service", "residential", "pedestrian", "tertiary", "secondary", "primary", "trunk", "track", "cycleway"]
BICYCLE_PRIORITY = ["None", "permissive", "yes", "private", "designated"]
CYCLEWAY_PRIORITY = ["None", "no", "crossing", "shared", "shared_lane", "lane", "track"]


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*values.items())))


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, and ``default`` where b is zero or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that depends on the seed and keys alone, so it is the same on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def missing(c: Column) -> Column:
    """Null or NaN."""
    return c.isNull() | F.isnan(c)


# -- tags ----------------------------------------------------------------------------------------------------------


def fold_highway(tags: Column) -> Column:
    """Each road type of a list replaced by its base type."""
    known = literal_map(HIGHWAY_SYNONYMS)
    return F.transform(tags, lambda x: F.coalesce(F.try_element_at(known, x), x))


def primary_label(tags: Column, priority: list[str]) -> Column:
    """The label of highest priority, the first on ties; the first label if none is known; null of null or nothing."""
    ranked = F.transform(tags, lambda x, i: F.struct(F.coalesce(F.array_position(F.lit(priority), x), F.lit(0)).alias("p"), (-i).alias("i"), x.alias("x")))
    return F.when(F.size(tags) > 0, F.array_max(ranked)["x"])


def primary_label_of_known(tags: Column, priority: list[str]) -> Column:
    """As :func:`primary_label`, without null, empty and NaN labels."""
    return primary_label(F.filter(tags, lambda x: x.isNotNull() & ~x.isin("", "nan", "NaN")), priority)


def clean_lanes(raw: Column) -> Column:
    """Lanes by the strict rule: a list of several adds its all-digit items, a single text counts if it is all digits,
    else 1; null stays null."""
    digits = lambda x: x.rlike("^[0-9]+$")
    added = F.aggregate(F.filter(raw, digits), F.lit(0), lambda s, x: s + x.cast("int"))
    single = F.try_element_at(raw, F.lit(1))
    return F.when(raw.isNull(), None).when(F.size(raw) == 1, F.when(digits(single), single.try_cast("int")).otherwise(1)).otherwise(added)


def lane_count(raw: Column, default: int = 1) -> Column:
    """Lanes by the lenient rule: items split at ";", each truncated, added up; nothing or no number is ``default``."""

    def one(x: Column) -> Column:
        parts = F.transform(F.split(F.trim(x), ";"), lambda p: F.trim(p).try_cast("double").try_cast("int"))
        bad = F.exists(parts, lambda p: p.isNull())
        return F.when(bad, None).otherwise(F.aggregate(parts, F.lit(0), lambda s, p: s + p))

    several = F.aggregate(F.transform(raw, lambda x: F.coalesce(one(x), F.lit(0))), F.lit(0), lambda s, x: s + x)
    value = F.when(F.size(raw) == 1, one(F.try_element_at(raw, F.lit(1)))).otherwise(F.nullif(several, F.lit(0)))
    return F.coalesce(F.when(raw.isNotNull() & (F.size(raw) > 0), value), F.lit(default))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


# -- safety and costs ----------------------------------------------------------------------------------------------


def infra_type(highway: Column, bicycle: Column, cycleway: Column) -> Column:
    track = F.coalesce(cycleway == "track", F.lit(False)) | F.coalesce(highway == "cycleway", F.lit(False)) | F.coalesce(bicycle == "designated", F.lit(False))
    return (
        F.when(track, "cycle_track")
        .when(cycleway == "lane", "bike_lane")
        .when(cycleway.isin("shared", "shared_lane"), "mixed")
        .when(highway == "residential", "mixed")
        .otherwise("car")
    )


def safety_class(infra: Column, highway: Column) -> Column:
    """The safety class; a shared lane on a road that is not residential falls through to the road's own rule."""
    return (
        F.when(infra == "cycle_track", "very_safe")
        .when(infra == "bike_lane", "safe")
        .when((infra == "mixed") & (highway == "residential"), "moderate")
        .when(highway.isin("primary", "secondary", "trunk", "tertiary"), "dangerous")
        .when(highway.isin("track", "service", "non_motorised"), "moderate")
        .otherwise("unclassified")
    )


def risk_factor(safety: Column) -> Column:
    return F.try_element_at(literal_map(dims.RISK), safety)


def bike_cost_base(length: Column, grade: Column) -> Column:
    """Length made longer uphill and shorter downhill; a missing grade counts as the steepest climb."""
    percent = F.lit(100.0) * F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.coalesce(grade, F.lit(1.0))))
    return length * F.when(percent >= 0, F.lit(1.0) + F.lit(0.08) * percent).otherwise(F.lit(1.0) / (F.lit(1.0) - F.lit(0.03) * percent))


def normalise_safety(c: Column) -> Column:
    """The value of a safety class given by value or name; anything else stays."""
    names = literal_map({name: value for value, name in dims.SAFETY.items()})
    return F.coalesce(F.try_element_at(names, F.regexp_replace(c, "^SafetyClass\\.", "")), c)


def safety_colour(safety: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(dims.SAFETY_COLOURS), normalise_safety(safety)), F.lit("gray"))


def status_colour(safety: Column, reallocatable: Column) -> Column:
    return F.when(normalise_safety(safety).isin(*dims.PROTECTED), "green").when(reallocatable == F.lit(False), "red").otherwise("gray")


def safety_width(safety: Column) -> Column:
    return F.when(normalise_safety(safety).isin(*dims.PROTECTED), 1.2).otherwise(0.5)


# -- demand and export ---------------------------------------------------------------------------------------------


def destination_type(office: Column, shop: Column, amenity: Column) -> Column:
    return F.when(office.isNotNull(), "work").when(shop.isNotNull(), "shop").when(amenity.isin(*dims.AMENITIES), amenity).otherwise("other")


def hex_to_rgb(colour: Column) -> Column:
    """"#rrggbb" as "r,g,b"."""
    part = lambda at: F.conv(F.substring(F.regexp_replace(colour, "^#", ""), at, 2), 16, 10)
    return F.concat_ws(",", part(1), part(3), part(5))


def safe_id(name: Column) -> Column:
    """Names as ASCII identifiers: accents dropped, spaces to underscores. Compatibility decomposition has no built-in
    function, so this takes Arrow batches; apply it to distinct names."""

    def run(col: pa.Array) -> pa.Array:
        out = []
        for x in col.to_pylist():
            plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().replace(" ", "_") if x is not None else None
            out.append(re.sub(r"[^A-Za-z0-9_]", "", plain) if x is not None else None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="string")(name)


def title_case(names: list[str]) -> list[str]:
    return [n.replace("_", " ").title() for n in names]

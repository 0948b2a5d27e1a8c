"""Segments: undirected road pieces that own the lanes, and what taking a lane from one would do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, geom
from .views import is_true

ARC_STRUCT = "struct<u:bigint,v:bigint,k:bigint>"
NO_ARCS = f"array<{ARC_STRUCT}>"


def _arc():
    return F.struct(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("k").cast("long").alias("k"))


def with_segments(arcs: DataFrame) -> DataFrame:
    """``arcs`` with seg: arcs of one pair of ends and one geometry, whichever way, named by their smallest arc. Arcs
    without a geometry belong together by k."""
    shape = geom.canonical(F.col("geometry")).cast("string") if "geometry" in arcs.columns else F.lit(None).cast("string")
    key = F.coalesce(shape, F.concat(F.lit("k"), F.col("k").cast("string")))
    by = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), key)
    first = F.min(_arc()).over(by)
    return arcs.withColumn("seg", F.struct(F.least(first["u"], first["v"]).alias("u"), F.greatest(first["u"], first["v"]).alias("v"), first["k"].alias("k")))


def inventory(arcs: DataFrame, rule: str = "rep") -> DataFrame:
    """(seg, lanes_total, lanes_remaining, reallocatable, highway) of arcs with seg; lanes are those of the smallest
    arc ("rep") or the most of any arc ("max")."""
    lanes = F.col("car_lanes") if "car_lanes" in arcs.columns else expr.lane_count(F.array(F.col("lanes").cast("string")))
    total = F.max(lanes) if rule == "max" else F.min_by(lanes, _arc())
    return arcs.groupBy("seg").agg(total.cast("int").alias("lanes_total"), F.min_by(is_true("reallocatable"), _arc()).alias("reallocatable"), F.min_by("highway", _arc()).alias("highway")).select(
        "seg", "lanes_total", F.col("lanes_total").alias("lanes_remaining"), "reallocatable", "highway"
    )


def refresh_flags(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """reallocatable of every arc: cycleways never, others if cars may use them and the segment has a lane to give."""
    own = segments.select("seg", (F.col("lanes_remaining") > 0).alias("_left"), F.coalesce("reallocatable", F.lit(True)).alias("_may"))
    met = arcs.join(own, "seg", "left")
    flag = F.when(F.col("seg").isNull() & (F.col("highway") != "cycleway"), F.col("reallocatable")).otherwise(
        (F.coalesce(F.col("highway"), F.lit("")) != "cycleway") & is_true("car_allowed") & is_true("_left") & is_true("_may")
    )
    return met.withColumn("reallocatable", flag).select(*arcs.columns)


def candidates(arcs: DataFrame) -> DataFrame:
    """(seg): segments with an arc that may give a lane."""
    return arcs.where(is_true("reallocatable") & F.col("seg").isNotNull()).select("seg").distinct()


def drive_arcs(arcs: DataFrame) -> DataFrame:
    """The first arc of each direction of each segment, cycleways apart."""
    rank = F.row_number().over(Window.partitionBy("seg", "u", "v").orderBy("k"))
    return arcs.where((F.coalesce(F.col("highway"), F.lit("")) != "cycleway") & F.col("seg").isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def actions(arcs: DataFrame, segments: DataFrame, wanted: DataFrame | None = None, policy: str = "first", scores: DataFrame | None = None, seed: int = 12) -> DataFrame:
    """(seg, remaining, remaining_after, oneway, keep_arc, bike_arcs, lost_car_arcs): taking one lane from each segment.

    A one-way segment loses its car arcs with its last lane; a two-way one with one lane left keeps the direction of
    keep_arc: the first, a random one, or that of the best score (u, v, k, score), missing scores last.
    """
    if policy not in ("first", "random", "score"):
        raise ValueError("policy must be first, random or score")
    own = drive_arcs(arcs)
    own = own.join(wanted.select("seg"), "seg", "left_semi") if wanted is not None else own
    oneway = F.coalesce(F.min_by("oneway", F.struct("u", "v", "k")), F.lit(True)) if "oneway" in arcs.columns else F.lit(True)
    if policy == "score":
        if scores is None:
            raise ValueError("the score policy needs scores")
        own = own.join(scores.select("u", "v", "k", "score"), ["u", "v", "k"], "left")
        order = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.col("u"), F.col("v"), F.col("k"))
    elif policy == "random":
        order = F.struct(expr.uniform(seed, F.col("u"), F.col("v"), F.col("k")).alias("s"), F.col("u"), F.col("v"), F.col("k"))
    else:
        order = F.struct("u", "v", "k")
    bike = arcs.where("highway = 'cycleway'").select("u", "v").distinct().withColumn("_cycle", F.lit(True))
    own = own.join(bike, ["u", "v"], "left").join(segments.select("seg", F.col("lanes_remaining").alias("remaining")), "seg")
    grouped = own.groupBy("seg", "remaining").agg(
        oneway.alias("oneway"), F.min_by(_arc(), order).alias("keep"),
        F.array_sort(F.collect_list(F.when(F.col("_cycle").isNull(), _arc()))).alias("bike_arcs"),
        F.array_sort(F.collect_list(F.when(is_true("car_allowed"), _arc()))).alias("_car"),
    )
    after = F.greatest(F.lit(0), F.col("remaining") - 1)
    needs = ~F.col("oneway") & (after == 1)
    keep = F.when(needs, F.col("keep"))
    none = F.array().cast(NO_ARCS)
    lost = (
        F.when(F.col("remaining") <= 0, none)
        .when(F.col("oneway"), F.when(after <= 0, F.col("_car")).otherwise(none))
        .when(after >= 2, none)
        .when(after == 1, F.filter("_car", lambda a: (a["u"] != F.col("keep.u")) | (a["v"] != F.col("keep.v"))))
        .otherwise(F.col("_car"))
    )
    return grouped.select("seg", "remaining", after.alias("remaining_after"), "oneway", keep.alias("keep_arc"), "bike_arcs", lost.alias("lost_car_arcs"))


def without_lost(arcs: DataFrame, action: DataFrame) -> DataFrame:
    """The arcs with car access taken from those that the actions lose."""
    lost = action.select(F.explode("lost_car_arcs").alias("a")).select("a.u", "a.v", "a.k").withColumn("_lost", F.lit(True))
    met = arcs.join(lost, ["u", "v", "k"], "left")
    return met.withColumn("car_allowed", is_true("car_allowed") & F.col("_lost").isNull()).select(*arcs.columns)


def apply_action(arcs: DataFrame, segments: DataFrame, action: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, segments, created) after the actions, one for each segment at most.

    Car lanes and access follow the remaining lanes; access is only ever closed, unless ``parity`` also opens it. Every
    other arc of the segment gives way to bikes, and each direction without a cycleway gets a new parallel one, with
    the next k and no segment.
    """
    act = action.select("seg", "remaining_after", F.col("oneway").alias("_oneway"), "keep_arc")
    first = drive_arcs(arcs).select("u", "v", "k", F.lit(True).alias("_first"))
    met = arcs.join(act, "seg", "left").join(first, ["u", "v", "k"], "left")
    hit = F.col("remaining_after").isNotNull() & F.col("_first")
    left = F.col("remaining_after")
    kept = (F.col("keep_arc.u") == F.col("u")) & (F.col("keep_arc.v") == F.col("v"))
    single = ~F.col("_oneway") & (left == 1)
    open_ = F.when(single, F.coalesce(kept, F.lit(False))).otherwise(left > 0)
    lanes = F.when(single, F.when(F.coalesce(kept, F.lit(False)), 1).otherwise(0)).otherwise(left)
    allowed = open_ if parity else open_ & is_true("car_allowed")
    touched = F.col("remaining_after").isNotNull() & (F.coalesce(F.col("highway"), F.lit("")) != "cycleway")
    changed = met.withColumns({
        "car_lanes": F.when(hit, lanes).otherwise(F.col("car_lanes")).cast("int"),
        "car_allowed": F.when(hit, allowed).otherwise(F.col("car_allowed")),
        "_was": F.col("bike_lanes"),
        "bike_allowed": F.when(touched, False).otherwise(F.col("bike_allowed")),
    })
    cycle = arcs.where("highway = 'cycleway'").select("u", "v").distinct()
    base = changed.where(touched).withColumn("_n", F.row_number().over(Window.partitionBy("u", "v").orderBy("k"))).where("_n = 1").join(cycle, ["u", "v"], "left_anti")
    top = arcs.join(base.select("u", "v").distinct(), ["u", "v"], "left_semi").groupBy("u", "v").agg(F.max("k").alias("_top"))
    kinds = dict(arcs.dtypes)
    new = {
        "k": F.col("_top") + 1, "car_allowed": F.lit(False), "bike_allowed": F.lit(True), "highway": F.lit("cycleway"), "bicycle": F.lit("designated"),
        "infra_type": F.lit("dedicated_bike_lane"), "bike_lanes": F.coalesce("_was", F.lit(0)) + 1, "safety": F.lit("very_safe"), "risk_factor": F.lit(1.0),
        "reallocatable": F.lit(False), "bike_cost_base": expr.bike_cost_base(F.col("length"), F.col("grade") if "grade" in kinds else F.lit(None).cast("double")),
        "seg": F.lit(None),
    }
    new["bike_cost_penalty"] = new["bike_cost_base"]
    created = base.join(top, ["u", "v"]).select(*((new[c].cast(kinds[c]).alias(c) if c in new else F.col(c)) for c in arcs.columns))
    own = segments.join(act.select("seg", "remaining_after"), "seg", "left").withColumn("lanes_remaining", F.coalesce("remaining_after", "lanes_remaining")).select(*segments.columns)
    return refresh_flags(changed.select(*arcs.columns).unionByName(created), own), own, created

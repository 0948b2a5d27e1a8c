"""Event logs: normalising, projecting onto another network, replaying, and differences between networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import expr, geom
from ..operators import segments as seg
from ..operators.views import ARC


def normalise_log(log: DataFrame, column: str | None = None) -> DataFrame:
    """One row for each event, numbered in order: from a column of event lists, or from rows that are events."""
    if column:
        rows = log.select("iteration", F.posexplode(column).alias("pos", "event")).where("event is not null")
        order = Window.orderBy("iteration", "pos")
        out = rows.select(F.row_number().over(order).alias("n"), "event.*")
    else:
        out = log.where("segment is not null").withColumn("n", F.row_number().over(Window.orderBy("iteration", F.col("segment").cast("string"))))
    return out


def taken(events: DataFrame) -> DataFrame:
    """Events that took a lane; a missing type counts as one."""
    return events.where(F.coalesce("event_type", F.lit("reallocated_segment")) == "reallocated_segment")


def event_arcs(events: DataFrame, arcs: DataFrame) -> DataFrame:
    """(n, u, v, k): arcs of each event's segment in either direction."""
    s = events.select("n", F.col("segment.u").alias("a"), F.col("segment.v").alias("b"), F.col("segment.k").alias("k"))
    both = s.selectExpr("n", "a as u", "b as v", "k").unionByName(s.selectExpr("n", "b as u", "a as v", "k")).distinct()
    return both.join(arcs.select(*ARC), ARC).select("n", *ARC)


def fine_arcs(simple: DataFrame, fine: DataFrame, chosen: DataFrame) -> DataFrame:
    """(n, u, v, k) of the fine network: what the chosen arcs were merged from, their own pair if nothing."""
    pairs = simple.select(*ARC, F.explode(F.coalesce("merged_edges", F.array(F.struct("u", "v")))).alias("e")) if "merged_edges" in simple.columns else simple.select(*ARC, F.struct("u", "v").alias("e"))
    met = chosen.join(pairs, ARC).select("n", F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    return met.distinct().join(fine.select(*ARC), ["u", "v"]).select("n", *ARC).distinct()


def fine_segments(fine: DataFrame) -> DataFrame:
    """The fine arcs that are no cycleways, with seg and lanes: the most lanes of any arc of the segment."""
    own = seg.with_segments(fine.where(F.coalesce(F.col("highway"), F.lit("")) != "cycleway"))
    lanes = F.col("car_lanes") if "car_lanes" in fine.columns else expr.lane_count(F.array(F.col("lanes").cast("string")))
    return own.withColumn("lanes_total", F.max(lanes).over(Window.partitionBy("seg")).cast("int"))


def project(simple: DataFrame, fine: DataFrame, log: DataFrame) -> DataFrame:
    """The fine network after all events. Lowering by one, never below zero, commutes, so the lanes that are left are
    the total less the number of events that touch the segment: no replay is needed."""
    own = fine_segments(fine)
    touched = fine_arcs(simple, fine, event_arcs(taken(log), simple))
    hits = touched.join(own.select(*ARC, "seg"), ARC).groupBy("seg").agg(F.countDistinct("n").alias("hits"))
    left = own.join(hits, "seg").select(*ARC, F.greatest(F.lit(0), F.col("lanes_total") - F.col("hits")).cast("int").alias("_left"))
    return _write(fine.join(left, ARC, "left"), fine.columns)


def _write(met: DataFrame, columns: list[str]) -> DataFrame:
    """Simulator-facing attributes of the arcs with ``_left`` car lanes."""
    hit, none = F.col("_left").isNotNull(), F.col("_left") == 0
    new = {
        "car_lanes": F.col("_left"), "car_allowed": F.col("_left") > 0, "bike_allowed": F.lit(True), "bike_lanes": F.greatest(F.lit(1), F.coalesce(F.col("bike_lanes") if "bike_lanes" in columns else F.lit(None), F.lit(0))),
        "bicycle": F.lit("designated"), "cycleway": F.when(none, "track").otherwise("lane"), "safety": F.lit("very_safe"), "risk_factor": F.lit(1.0), "lanes": F.greatest(F.lit(1), F.col("_left")),
    }
    out = met
    for c, value in new.items():
        out = out.withColumn(c, F.when(hit, value).otherwise(F.col(c) if c in columns else F.lit(None)))
    road = F.when(hit & none, "cycleway").otherwise(F.col("highway"))
    return out.withColumn("highway", road).drop("_left")


def projection_stats(simple: DataFrame, fine: DataFrame, log: DataFrame) -> DataFrame:
    """One row: events seen and applied, segments touched, events without a simple arc, and without a fine one."""
    events = taken(log)
    arcs_ = event_arcs(events, simple)
    touched = fine_arcs(simple, fine, arcs_).join(fine_segments(fine).select(*ARC, "seg"), ARC)
    a = events.agg(F.count(F.lit(1)).alias("events_seen"))
    b = touched.agg(F.countDistinct("n").alias("events_applied"), F.countDistinct("seg").alias("segments_touched"))
    c = events.join(arcs_.select("n").distinct(), "n", "left_anti").agg(F.count(F.lit(1)).alias("missing_simplified"))
    d = arcs_.select("n").distinct().join(touched.select("n").distinct(), "n", "left_anti").agg(F.count(F.lit(1)).alias("missing_unsimplified"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def lanes_after(segments: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """(seg, lanes_remaining) after the first ``n`` events; a mark as not reallocatable leaves no lane."""
    own = events.where(F.col("n") <= n).groupBy(F.col("segment").alias("seg")).agg(
        F.count_if(F.coalesce("event_type", F.lit("reallocated_segment")) == "reallocated_segment").alias("hits"), F.bool_or(F.col("event_type") == "marked_segment_not_reallocatable").alias("dead")
    )
    left = F.greatest(F.lit(0), F.col("lanes_total") - F.coalesce("hits", F.lit(0)))
    return segments.join(own, "seg", "left").select("seg", F.when(F.col("dead"), 0).otherwise(left).cast("int").alias("lanes_remaining"))


def frames(events: DataFrame, step: int = 1, initial: bool = True) -> DataFrame:
    """(frame, events, iteration): how many events each frame shows and the iteration of its last one. Frames come
    every ``step`` events; the last is always there."""
    if step < 1:
        raise ValueError("step must be at least 1")
    total = events.agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = total.select(F.explode(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)) if initial else F.array().cast("array<int>"), F.when(F.col("n") >= step, F.sequence(F.lit(step), F.col("n"), F.lit(step))).otherwise(F.array().cast("array<int>")), F.array("n"))))).alias("events"))
    met = counts.join(events.select(F.col("n").alias("events"), "iteration"), "events", "left")
    return met.select(F.row_number().over(Window.orderBy("events")).alias("frame"), "events", F.coalesce("iteration", F.lit(0)).cast("int").alias("iteration"))


def snapshots(total: int, n: int) -> list[int]:
    """Evenly spaced numbers of events from none to all, each once, in whole numbers."""
    return sorted({i * total // max(1, n - 1) for i in range(n)}) if n > 1 else [total]


def network_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(u, v, k, status): initial and proposed protected arcs, fixed ones (not reallocatable, no cycleways) that were
    so or became so."""
    keep = lambda df: df.where(F.col("safety").isin(*dims.PROTECTED)).select(*ARC)
    road = F.coalesce(F.col("highway"), F.lit("")) != "cycleway"
    fixed = lambda df: df.where(road & (F.col("reallocatable") == F.lit(False))).select(*ARC)
    movable = before.where(F.col("reallocatable")).select(*ARC)
    parts = {
        "initial": keep(before).intersect(keep(after)), "proposed": keep(after).exceptAll(keep(before)),
        "initial_fixed": fixed(before).intersect(fixed(after)), "newly_fixed": movable.intersect(fixed(after)),
    }
    out = None
    for status, df in parts.items():
        own = df.withColumn("status", F.lit(status))
        out = own if out is None else out.unionByName(own)
    return out


def clip(arcs: DataFrame, ring) -> DataFrame:
    """Arcs with a positive length inside the polygon, and that length."""
    return arcs.withColumn("clipped_length", geom.clipped_length(F.col("geometry"), ring)).where("clipped_length > 0")

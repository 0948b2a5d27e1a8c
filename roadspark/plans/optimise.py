"""The greedy optimiser: a loop on the driver over plans; every state is a checkpointed snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.expr import safe_div
from ..operators import heuristics, segments as seg, views
from ..operators.evaluate import evaluate
from ..operators.graph import edge_betweenness, edge_importance, is_strongly_connected, od_paths
from ..state import cut

EVENT = (
    f"iteration int, event_type string, segment {seg.ARC_STRUCT}, remaining_after int, keep_arc {seg.ARC_STRUCT}, "
    f"bike_arcs {seg.NO_ARCS}, lost_car_arcs {seg.NO_ARCS}, created_edges {seg.NO_ARCS}"
)


@dataclass
class Run:
    """The state of a run: snapshots of arcs and segments, the event log, and the evaluations so far."""

    arcs: DataFrame
    segments: DataFrame
    events: list[tuple] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    pending: int = 0
    streak: int = 0


def progress(run: Run, row: dict) -> dict:
    """Gain and harm against the first evaluation; the streak counts gains against the last one below the threshold."""
    bike, car = row["bike_full_total_cost"], row["car_total_cost"]
    if not run.rows:
        return row | {"bike_gain_vs_baseline": 0.0, "car_harm_vs_baseline": 0.0}
    base, before = run.rows[0], run.rows[-1]
    base_bike, base_car = base["bike_full_total_cost"], base["car_total_cost"]
    step = (before["bike_full_total_cost"] - bike) / base_bike if base_bike > 0 else 0.0
    run.streak = run.streak + 1 if step < dims.MIN_BIKE_GAIN else 0
    gain = (base_bike - bike) / base_bike if base_bike > 0 else 0.0
    harm = (car - base_car) / base_car if base_car > 0 else 0.0
    return row | {"bike_gain_vs_baseline": gain, "car_harm_vs_baseline": harm}


def stop_reason(run: Run, row: dict) -> str | None:
    if row["car_harm_vs_baseline"] > dims.MAX_CAR_HARM:
        return "car_budget_exceeded"
    return "bike_benefit_flattened" if run.streak >= dims.PATIENCE else None


def _evaluate(run: Run, od: DataFrame, iteration: int, dry: bool, clear: bool) -> dict:
    """One evaluation row; it carries the events since they were last cleared."""
    diff = run.events[run.pending :]
    if clear:
        run.pending = len(run.events)
    if dry:
        row = {"bike_full_total_cost": 0.0, "car_total_cost": 0.0, "bike_gain_vs_baseline": 0.0, "car_harm_vs_baseline": 0.0}
    else:
        row = progress(run, evaluate(run.arcs, od).first().asDict())
    run.rows.append(row | {"iteration": iteration, "n_events": len(diff), "stop_reason": None, "diff_log": diff})
    return run.rows[-1]


def _context(run: Run, od: DataFrame, rule: heuristics.Rule, cache: dict, k: int | None) -> dict:
    """The parts a rule needs; kept until the cache is cleared."""
    if "bike_importance" in rule.needs and "bike_importance" not in cache:
        net = views.bikeable(run.arcs)
        cache["bike_importance"] = cut(edge_importance(net, od_paths(net, od, "bike_cost_penalty"), "bike_cost_penalty"))
    if "car_importance" in rule.needs and "car_importance" not in cache:
        net = views.drive(run.arcs)
        cache["car_importance"] = cut(edge_importance(net, od_paths(net, od, "length"), "length"))
    if "betweenness" in rule.needs and "betweenness" not in cache:
        cache["betweenness"] = cut(edge_betweenness(views.bikeable(run.arcs), "bike_cost_penalty", k))
    return cache


def feasible(arcs: DataFrame, action: DataFrame) -> bool:
    """Whether the drive network stays strongly connected; without a lost arc it stays as it was."""
    row = action.select("remaining", F.size("lost_car_arcs").alias("n")).first()
    if row["remaining"] <= 0:
        return False
    return row["n"] == 0 or is_strongly_connected(views.drive(seg.without_lost(arcs, action)))


def optimise(
    arcs: DataFrame, nodes: DataFrame, od: DataFrame, heuristic: str = "od_aware", iterations: int = 10, every: int = 10,
    beta: float = 1.0, k: int | None = None, seed: int = 12, dry: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, evaluations, events): take lanes one by one until a budget, a plateau or the last candidate is reached.

    ``arcs`` need car_lanes, bike_lanes and reallocatable. Each iteration is one plan for all candidates, one argmax
    and one feasibility test; a segment whose action would part the drive network is marked and costs its iteration.
    """
    spark, rule = arcs.sparkSession, heuristics.REGISTRY[heuristic]
    own = cut(seg.with_segments(arcs))
    stock = cut(seg.inventory(own))
    run = Run(cut(seg.refresh_flags(own, stock)), stock)
    _evaluate(run, od, 0, dry, False)
    cache: dict = {}
    reason = None
    for i in range(1, iterations + 1):
        if i % every == 0:
            cache.clear()
        wanted = cut(seg.candidates(run.arcs))
        if wanted.isEmpty():
            reason = "no_candidates"
            break
        parts = _context(run, od, rule, cache, k)
        scores = parts.get(rule.keep_score) if rule.keep_score else None
        if scores is not None:
            scores = scores.withColumnRenamed("importance" if "importance" in scores.columns else "betweenness", "score")
        acts = cut(seg.actions(run.arcs, run.segments, wanted, rule.keep_policy, scores, seed))
        ranked = rule.score(heuristics.Context(run.arcs, nodes, acts, parts.get("bike_importance"), parts.get("car_importance"), parts.get("betweenness"), beta, i, seed))
        choice = cut(acts.join(heuristics.argmax(ranked), "seg", "left_semi")) if ranked is not None else None
        if choice is None or choice.isEmpty():
            reason = "no_choice"
            break
        row = choice.first()
        made = None
        if feasible(run.arcs, choice):
            new, stock, created = seg.apply_action(run.arcs, run.segments, choice)
            made = [(r["u"], r["v"], r["k"]) for r in created.select("u", "v", "k").orderBy("u", "v", "k").collect()]  # of one segment
            run.arcs, run.segments = cut(new), cut(stock)
            for name in ("bike_importance", "betweenness"):
                if i % every == 0:
                    cache.pop(name, None)
            kind = "reallocated_segment"
        else:
            hit = F.col("seg") == F.struct(*(F.lit(row["seg"][c]).cast("long").alias(c) for c in "uvk"))
            run.segments = cut(run.segments.withColumn("reallocatable", F.when(hit, False).otherwise(F.col("reallocatable"))))
            run.arcs = cut(seg.refresh_flags(run.arcs, run.segments))
            kind = "marked_segment_not_reallocatable"
        arcs_of = lambda x: [(a["u"], a["v"], a["k"]) for a in x]
        run.events.append((i, kind, tuple(row["seg"]), row["remaining_after"], tuple(row["keep_arc"]) if row["keep_arc"] else None, arcs_of(row["bike_arcs"]), arcs_of(row["lost_car_arcs"]), made))
        if i % every == 0:
            reason = stop_reason(run, _evaluate(run, od, i, dry, True))
            if reason:
                break
    else:
        reason = "max_iterations"
    if run.pending < len(run.events):
        _evaluate(run, od, run.events[-1][0], dry, False)
    run.rows[-1]["stop_reason"] = reason
    numbers = sorted({c for r in run.rows for c, v in r.items() if isinstance(v, (int, float)) and c not in ("iteration", "n_events")})
    kinds = {c: "double" if any(isinstance(r.get(c), float) for r in run.rows) else "long" for c in numbers}
    schema = "heuristic string, iteration int, n_events int, stop_reason string, " + ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", diff_log array<struct<{EVENT.replace(' int', ':int').replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>"
    table = spark.createDataFrame([(heuristic, r["iteration"], r["n_events"], r["stop_reason"], *(r.get(c) for c in numbers), r["diff_log"]) for r in run.rows], schema)
    return run.arcs, table, spark.createDataFrame(run.events, EVENT)


def progress_table(evaluations: DataFrame, bike: str = "bike_full_total_cost", car: str = "car_total_cost") -> DataFrame:
    """Gain, harm and streak of each evaluation of each heuristic as windows over its run."""
    by = Window.partitionBy("heuristic").orderBy("iteration")
    base = lambda c: F.first(c).over(by.rowsBetween(Window.unboundedPreceding, 0))
    step = safe_div(F.lag(bike).over(by) - F.col(bike), base(bike))
    weak = F.when(F.lag(bike).over(by).isNull(), 0).otherwise((step < dims.MIN_BIKE_GAIN).cast("int"))
    out = evaluations.withColumns({
        "bike_gain_vs_baseline": safe_div(base(bike) - F.col(bike), base(bike)), "car_harm_vs_baseline": safe_div(F.col(car) - base(car), base(car)), "_weak": weak,
    }).withColumn("_island", F.sum(1 - F.col("_weak")).over(by))
    return out.withColumn("streak", F.sum("_weak").over(Window.partitionBy("heuristic", "_island").orderBy("iteration"))).drop("_weak", "_island")

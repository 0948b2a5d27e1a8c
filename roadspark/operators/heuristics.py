"""Which segment gives up a lane next: a registry of scoring rules, each a plan over all candidates at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import uniform
from ..state import cut
from . import views
from .demand import nearest_node
from .graph import cheapest, distances, edge_betweenness, strong_components
from .views import ARC


@dataclass
class Context:
    """What a rule may ask for; unused parts stay unevaluated."""

    arcs: DataFrame
    nodes: DataFrame
    actions: DataFrame
    bike_importance: DataFrame | None = None
    car_importance: DataFrame | None = None
    betweenness: DataFrame | None = None
    beta: float = 1.0
    iteration: int = 0
    seed: int = 12


def _score(actions: DataFrame, arcs_column: str, values: DataFrame, value: str) -> DataFrame:
    """(seg, s): the sum of a value over the arcs of each action; segments without any are absent."""
    each = actions.select("seg", F.explode(arcs_column).alias("a")).select("seg", "a.u", "a.v", "a.k")
    return each.join(values.select(*ARC, F.col(value).alias("s")), ARC).groupBy("seg").agg(F.sum("s").alias("s"))


def _net(ctx: Context, gain: DataFrame, harm: DataFrame | None) -> DataFrame:
    out = ctx.actions.select("seg").join(gain, "seg", "left").select("seg", F.coalesce("s", F.lit(0.0)).alias("score"))
    if harm is not None:
        out = out.join(harm, "seg", "left").select("seg", (F.col("score") - F.lit(ctx.beta) * F.coalesce("s", F.lit(0.0))).alias("score"))
    return out


def od_aware(ctx: Context) -> DataFrame:
    """Demand on the bike arcs less beta times demand on the lost car arcs."""
    return _net(ctx, _score(ctx.actions, "bike_arcs", ctx.bike_importance, "importance"), _score(ctx.actions, "lost_car_arcs", ctx.car_importance, "importance"))


def bike_centrality(ctx: Context) -> DataFrame:
    """Betweenness of the bike arcs."""
    return _net(ctx, _score(ctx.actions, "bike_arcs", ctx.betweenness, "betweenness"), None)


def bike_car_aware(ctx: Context) -> DataFrame:
    """Betweenness of the bike arcs less beta times demand on the lost car arcs."""
    return _net(ctx, _score(ctx.actions, "bike_arcs", ctx.betweenness, "betweenness"), _score(ctx.actions, "lost_car_arcs", ctx.car_importance, "importance"))


def random_choice(ctx: Context) -> DataFrame:
    """A draw that depends on the seed, the iteration and the segment."""
    return ctx.actions.select("seg", uniform(ctx.seed, F.lit(ctx.iteration), F.col("seg.u"), F.col("seg.v"), F.col("seg.k")).alias("score"))


def argmax(scores: DataFrame) -> DataFrame:
    """The best segment; ties go to the first by its text, so that (10, ...) comes before (2, ...)."""
    name = F.format_string("(%d, %d, %d)", "seg.u", "seg.v", "seg.k")
    return scores.orderBy(F.desc("score"), name).limit(1).select("seg")


def closest_pairs(left: DataFrame, right: DataFrame, nodes: DataFrame, pairs: int) -> DataFrame:
    """(a, b, far): the ``pairs`` closest pairs of nodes of two node sets (node), ties by their ids.

    The nearest partners of so many nodes bound the distance: only pairs within it, which meet by an equi-join on grid
    cells of that size, are ranked. A set of fewer nodes than ``pairs`` meets all of the other one.
    """
    at = nodes.where("x is not null and y is not null").select(F.col("node_id").alias("node"), "x", "y")
    a, b = cut(left.join(at, "node").toDF("a", "ax", "ay")), cut(right.join(at, "node").toDF("b", "bx", "by"))
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("far")
    top = lambda met: cut(met.orderBy("far", "a", "b").limit(pairs))
    if b.isEmpty() or len(a.limit(pairs).collect()) < pairs:
        return top(F.broadcast(a).crossJoin(b).select("a", "b", far))  # a few rows
    near = nearest_node(a.toDF("a", "x", "y"), b.toDF("node_id", "x", "y"), ["a"]).join(a, "a").join(b.withColumnRenamed("b", "node"), "node")
    bound = max(r["far"] for r in near.select(far).orderBy("far").limit(pairs).collect())
    size = max(bound, 1.0)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    wide = a.withColumn("i", F.explode(F.transform(around, lambda k: cell("ax") + k))).withColumn("j", F.explode(F.transform(around, lambda k: cell("ay") + k)))
    met = wide.join(b.withColumn("i", cell("bx")).withColumn("j", cell("by")), ["i", "j"]).select("a", "b", far)
    return top(met.where(F.col("far") <= bound))


def bridge_path(arcs: DataFrame, nodes: DataFrame, left: DataFrame, right: DataFrame, pairs: int = 5, weight: str = "length") -> DataFrame:
    """(pos, u, v) of the cheapest shortest path between the closest pairs of nodes of two node sets (node).

    The candidates are the ``pairs`` closest pairs as the crow flies, ties by their ids.
    """
    close = closest_pairs(left, right, nodes, pairs)
    reach = cut(distances(cheapest(arcs, weight), close.select(F.col("a").alias("src")), paths=True))
    best = close.join(reach.select(F.col("src").alias("a"), F.col("node").alias("b"), "dist"), ["a", "b"]).orderBy("dist", "far", "a", "b").limit(1)
    row = best.select("a", "b").first()
    steps, at_, spark = [], (row["b"] if row else None), arcs.sparkSession
    tree = {r["node"]: r["prev"] for r in reach.where((F.col("src") == row["a"]) & F.col("prev").isNotNull()).select("node", "prev").toLocalIterator()} if row else {}
    while row and at_ != row["a"]:
        steps.append((tree[at_], at_))
        at_ = tree[at_]
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(reversed(steps))], "pos int, u long, v long")


def bridge_segment(arcs: DataFrame, path: DataFrame, allowed: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(seg): the first segment of the path that may give a lane and has both ends outside both node sets, or else the
    first that may give one."""
    inside = left.union(right).distinct()
    met = path.join(cheapest(arcs).select("u", "v", "k"), ["u", "v"]).join(arcs.select(*ARC, "seg"), ARC).join(allowed, "seg", "left_semi")
    met = met.join(inside.select(F.col("node").alias("u"), F.lit(1).alias("_u")), "u", "left").join(inside.select(F.col("node").alias("v"), F.lit(1).alias("_v")), "v", "left")
    outside = F.col("_u").isNull() & F.col("_v").isNull()
    return met.orderBy(F.desc(outside), "pos", "k").limit(1).select("seg")


def largest_to_closest(ctx: Context) -> DataFrame | None:
    """Scores 1 for the segment that connects the largest protected component to the nearest one that a path reaches.

    Fewer than 3 protected arcs: betweenness of a sample of 50 nodes instead. Fewer than 2 components: null, the end.
    """
    net = cut(views.protected(ctx.arcs))
    if net.limit(3).count() < 3:
        central = edge_betweenness(views.bikeable(ctx.arcs), "bike_cost_penalty", k=50)
        return _net(ctx, _score(ctx.actions, "bike_arcs", central, "betweenness"), None)
    comp = cut(strong_components(net))
    size = cut(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component"))
    if size.limit(2).count() < 2:
        return None
    largest = size.first()["component"]
    at = ctx.nodes.select(F.col("node_id").alias("node"), "x", "y")
    centre = comp.join(at, "node").groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    home = centre.where(F.col("component") == largest).select(F.col("x").alias("hx"), F.col("y").alias("hy"))
    far = F.sqrt((F.col("x") - F.col("hx")) ** 2 + (F.col("y") - F.col("hy")) ** 2)
    near = centre.where(F.col("component") != largest).crossJoin(home).select("component", far.alias("far")).orderBy("far", "component")
    own = comp.where(F.col("component") == largest).select("node")
    for r in near.toLocalIterator():  # the nearest is nearly always the one
        other = comp.where(F.col("component") == r["component"]).select("node")
        path = bridge_path(views.bikeable(ctx.arcs), ctx.nodes, own, other)
        found = cut(bridge_segment(ctx.arcs, path, ctx.actions.select("seg"), own, other))
        if not found.isEmpty():
            return found.withColumn("score", F.lit(1.0))
    return None


@dataclass(frozen=True)
class Rule:
    score: Callable[[Context], DataFrame | None]
    keep_policy: str
    keep_score: str | None
    needs: tuple[str, ...]


REGISTRY: dict[str, Rule] = {
    "od_aware": Rule(od_aware, "score", "car_importance", ("bike_importance", "car_importance")),
    "bike_centrality": Rule(bike_centrality, "score", "betweenness", ("betweenness",)),
    "bike_car_aware": Rule(bike_car_aware, "score", "car_importance", ("betweenness", "car_importance")),
    "random": Rule(random_choice, "random", None, ()),
    "largest_to_closest": Rule(largest_to_closest, "first", None, ()),
}
REGISTRY["betweenness_od"] = REGISTRY["od_aware"]
REGISTRY["betweenness"] = REGISTRY["bike_centrality"]


def register(name: str, rule: Rule) -> None:
    """Add a rule: any function of a context that returns (seg, score)."""
    REGISTRY[name] = rule



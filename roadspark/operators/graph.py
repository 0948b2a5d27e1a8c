"""Graph operators as fixpoints of DataFrame plans; every round is checkpointed, and no round collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import uniform
from ..state import cut
from . import search
from .views import induced, nodes_of

#: Rounds after which distances that still fall are an error, as on a cycle of negative cost.
ROUNDS = 10_000


def cheapest(arcs: DataFrame, weight: str = "length") -> DataFrame:
    """(u, v, w, k): the cheapest parallel arc of each pair, the smallest k on ties; a missing weight counts 1."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in arcs.columns else F.lit(1.0)
    best = F.min(F.struct(w.alias("w"), F.col("k").alias("k")))
    return arcs.groupBy("u", "v").agg(best.alias("b")).select("u", "v", "b.w", "b.k")


def distances(hops: DataFrame, sources: DataFrame, paths: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, node, dist[, prev]): least cost from each source over hops (*by, u, v, w), the source itself at 0.

    All sources advance together: only pairs that the last round improved are extended. ``by`` keeps several networks
    apart in one loop. prev is the smallest predecessor on a shortest path; ties are settled once distances stand.
    """
    hops = cut(hops.select(*by, "u", "v", "w"))
    reached = cut(sources.select(*by, "src", F.col("src").alias("node"), F.lit(0.0).alias("dist")).distinct())
    frontier = reached
    for _ in range(ROUNDS):
        step = frontier.withColumnRenamed("node", "u").join(hops, [*by, "u"]).groupBy(*by, "src", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        known = reached.withColumnRenamed("dist", "old")
        better = step.join(known, [*by, "src", "node"], "left").where("old is null or new < old").select(*by, "src", "node", F.col("new").alias("dist"))
        frontier = cut(better)
        if frontier.isEmpty():
            break
        rest = reached.join(frontier.select(*by, "src", "node"), [*by, "src", "node"], "left_anti")
        reached = cut(rest.unionByName(frontier))
    else:
        raise RuntimeError(f"distances are not final after {ROUNDS} rounds")
    if not paths:
        return reached
    before = reached.select(*by, "src", F.col("node").alias("u"), F.col("dist").alias("d0")).join(hops, [*by, "u"])
    prev = before.withColumnRenamed("v", "node").join(reached, [*by, "src", "node"]).where("d0 + w = dist and node <> src").groupBy(*by, "src", "node").agg(F.min("u").alias("prev"))
    return reached.join(prev, [*by, "src", "node"], "left")


def priced_od(arcs: DataFrame, od: DataFrame, weight: str = "length") -> DataFrame:
    """(o, d, w, cost) of each pair; cost is null if there is no path, w is not above 0 or o is d.

    A network of bounded size goes to the tasks, which search it for their origins. In a larger one all origins advance
    by joins, whose state has a row for each origin and node that it reaches.
    """
    hops = cut(cheapest(arcs, weight).select("u", "v", "w"))
    if nets := search.networks({"cost": hops}):
        return search.routed(nets, od)
    asked = od.where("w > 0 and o <> d")
    found = distances(hops, asked.select(F.col("o").alias("src")).join(nodes_of(hops).withColumnRenamed("node", "src"), "src", "left_semi"))
    costs = found.select(F.col("src").alias("o"), F.col("node").alias("d"), F.col("dist").alias("cost"))
    met = od.join(costs, ["o", "d"], "left")
    return met.select("o", "d", "w", F.when((F.col("w") > 0) & (F.col("o") != F.col("d")), F.col("cost")).alias("cost"))


def od_costs(arcs: DataFrame, od: DataFrame, weight: str = "length") -> DataFrame:
    """(o, d, cost) of each reachable pair with w > 0 and o <> d; others are absent."""
    return priced_od(arcs, od, weight).where("cost is not null").select("o", "d", "cost")


def od_paths(arcs: DataFrame, od: DataFrame, weight: str = "length") -> DataFrame:
    """(o, d, w, path): node list of a shortest path of each pair that has one; self pairs have the node alone."""
    hops = cut(cheapest(arcs, weight).select("u", "v", "w"))
    if nets := search.networks({"net": hops}):
        return search.paths(nets["net"], od)
    return joined_paths(hops, od)


def joined_paths(hops: DataFrame, od: DataFrame) -> DataFrame:
    """:func:`od_paths` over hops (u, v, w) by joins alone, for networks of any size."""
    found = cut(distances(hops, od.select(F.col("o").alias("src")), paths=True))
    ends = nodes_of(hops)
    both = od.join(ends.withColumnRenamed("node", "o"), "o", "left_semi").join(ends.withColumnRenamed("node", "d"), "d", "left_semi").select("o", "d", "w")
    step = found.select(F.col("src").alias("o"), F.col("node").alias("at"), "prev")
    open_ = cut(both.join(found.select(F.col("src").alias("o"), F.col("node").alias("d")), ["o", "d"]).select("o", "d", "w", F.col("d").alias("at"), F.array("d").alias("path")))
    done = []
    while True:
        done.append(open_.where("at = o").drop("at"))
        left = open_.where("at <> o").join(step, ["o", "at"]).select("o", "d", "w", F.col("prev").alias("at"), F.concat(F.array("prev"), "path").alias("path"))
        open_ = cut(left)
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hops_of(paths: DataFrame) -> DataFrame:
    """(o, d, w, pos, u, v) of each step of each path."""
    n = F.size("path")
    pairs = F.when(n > 1, F.zip_with(F.slice("path", 1, n - 1), F.slice("path", 2, n - 1), lambda a, b: F.struct(a.alias("u"), b.alias("v"))))
    return paths.select("o", "d", "w", F.posexplode(pairs).alias("pos", "hop")).select("o", "d", "w", "pos", "hop.u", "hop.v")


def path_cost(arcs: DataFrame, paths: DataFrame, weight: str) -> DataFrame:
    """(o, d, w, hops, cost) by the cheapest parallel arc of each hop; a hop without an arc is an error."""
    own = cut(cheapest(arcs, weight).select("u", "v", "w"))
    if nets := search.networks({"net": own}):
        return search.priced(nets["net"], paths)
    met = hops_of(paths).join(own.withColumnRenamed("w", "c"), ["u", "v"], "left")
    cost = F.when(F.col("c").isNull(), F.raise_error(F.lit("a path has a hop without an arc"))).otherwise(F.col("c"))
    summed = met.groupBy("o", "d", "w").agg(F.sum(cost).alias("cost"))
    each = paths.select("o", "d", "w", (F.size("path") - 1).alias("hops")).distinct()
    return each.join(summed, ["o", "d", "w"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def edge_importance(arcs: DataFrame, paths: DataFrame, weight: str = "length") -> DataFrame:
    """(u, v, k, importance): demand over the cheapest parallel arc of each hop, added up before the arcs are joined."""
    used = hops_of(paths).groupBy("u", "v").agg(F.sum("w").alias("importance"))
    return used.join(cheapest(arcs, weight).select("u", "v", "k"), ["u", "v"]).select("u", "v", "k", "importance")


def od_importance(arcs: DataFrame, od: DataFrame, weight: str = "length") -> DataFrame:
    """:func:`edge_importance` of the paths of :func:`od_paths`. Tasks that search the network add the demand up, so that
    no path leaves them."""
    hops = cut(cheapest(arcs, weight))
    if nets := search.networks({"net": hops.select("u", "v", "w")}):
        used = search.loads(nets["net"], od).groupBy("u", "v").agg(F.sum("load").alias("importance"))
        return used.join(hops.select("u", "v", "k"), ["u", "v"]).select("u", "v", "k", "importance")
    return edge_importance(arcs, joined_paths(hops.select("u", "v", "w"), od), weight)


def _spread(hops: DataFrame, start: DataFrame, best) -> DataFrame:
    """(node, label): the best label that reaches each node along the hops; labels start as given."""
    labels, frontier = cut(start), None
    frontier = labels
    while True:
        came = frontier.withColumnRenamed("node", "u").join(hops, "u").groupBy(F.col("v").alias("node")).agg(best("label").alias("new"))
        met = came.join(labels, "node")
        frontier = cut(met.where("new > label" if best is F.max else "new < label").select("node", F.col("new").alias("label")))
        if frontier.isEmpty():
            return labels
        labels = cut(labels.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))


def reachable(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(node): all nodes reached from the start nodes, themselves included."""
    seen = frontier = cut(start.select("node").distinct())
    hops = cut(arcs.select("u", "v").distinct())
    while True:
        frontier = cut(frontier.withColumnRenamed("node", "u").join(hops, "u").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their largest node.

    Every node takes the largest id that reaches it; those that reach that id back, among nodes of the same colour, are
    its component. Nodes without arcs in or out are components of their own and leave first. A network of bounded size is
    left to one task.
    """
    pairs = cut(arcs.select("u", "v").distinct())
    if pairs.count() <= search.HOPS and pairs.where("u is null or v is null").isEmpty():
        return search.components(pairs)
    left = cut(arcs.where("u <> v").select("u", "v").distinct())
    todo = cut(nodes_of(arcs))
    done: list[DataFrame] = []
    while not todo.isEmpty():
        inner = left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        core = cut(nodes_of(inner).join(left.select(F.col("u").alias("node")).distinct(), "node", "left_semi").join(left.select(F.col("v").alias("node")).distinct(), "node", "left_semi"))
        trimmed = cut(todo.join(core, "node", "left_anti"))
        if not trimmed.isEmpty():
            done.append(trimmed.select("node", F.col("node").alias("component")))
            todo, left = core, cut(induced(left, core))
            continue
        colour = _spread(left, todo.select("node", F.col("node").alias("label")), F.max)
        c = colour.select("node", F.col("label").alias("colour"))
        same = left.join(c.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(c.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v").where("cu = cv")
        back = reachable(same.select(F.col("v").alias("u"), F.col("u").alias("v")), c.where("node = colour").select("node"))
        found = cut(c.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")))
        done.append(found)
        todo = cut(todo.join(found, "node", "left_anti"))
        left = cut(induced(left, todo))
    out = nodes_of(arcs).limit(0).select("node", F.col("node").alias("component"))
    for part in done:
        out = out.unionByName(part)
    return out


def is_strongly_connected(arcs: DataFrame) -> bool:
    """Whether one node reaches all others and all reach it; an empty network is not."""
    nodes = cut(nodes_of(arcs))
    start = nodes.agg(F.min("node").alias("node"))
    total = nodes.count()
    if not total:
        return False
    return reachable(arcs, start).count() == total and reachable(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")), start).count() == total


def largest_strong_component(arcs: DataFrame, by_length: bool = False) -> DataFrame:
    """Arcs within the component of most nodes, or of the greatest length of inner arcs; the smallest name on ties."""
    comp = cut(strong_components(arcs))
    inner = arcs.join(comp.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u").join(comp.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").where("cu = cv")
    if by_length:
        size = inner.groupBy("cu").agg(F.sum("length").alias("size")).select(F.col("cu").alias("component"), "size")
    else:
        size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    best = size.orderBy(F.desc("size"), "component").limit(1)
    return inner.join(best.select(F.col("component").alias("cu")), "cu", "left_semi").select(*arcs.columns)


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): components of the undirected edges (u, v), named by their smallest node."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct().toDF("u", "v"))
    nodes = nodes_of(edges)
    return _spread(both, nodes.select("node", F.col("node").alias("label")), F.min).select("node", F.col("label").alias("component"))


def bridges(arcs: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs whose removal parts the undirected multigraph; parallel arcs (of either direction but the
    reverse of one road) keep a pair from being one.

    A breadth-first forest is laid, and each edge outside it gets a random tag; a tree edge is a bridge if the tags of
    the edges that leave its subtree cancel out. Two tags of 63 bits in all make a false bridge practically impossible.
    """
    a, b = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    pairs = cut(arcs.where("u <> v").select(a, b, "k", (F.col("u") < F.col("v")).alias("up")).groupBy("a", "b").agg(F.countDistinct("k").alias("n")))
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = cut(edges.union(edges.select("v", "u")).toDF("u", "v"))
    comp = weak_components(edges)
    level = cut(comp.where("node = component").select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    frontier, depth = level, 0
    while True:
        depth += 1
        new = frontier.select(F.col("node").alias("u")).join(both, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        frontier = cut(new.join(level.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        level = cut(level.unionByName(frontier))
    tree = level.where("parent is not null").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), F.lit(1).alias("tree"))
    marked = pairs.join(tree, ["a", "b"], "left")
    tag = lambda salt: (uniform(salt, F.col("a"), F.col("b")) * F.lit(2.0**31)).cast("long")
    loose = marked.where("tree is null or n > 1").select("a", "b", (F.shiftleft(tag(1), 32).bitwiseOR(tag(2))).alias("t"))
    own = loose.select(F.col("a").alias("node"), "t").union(loose.select(F.col("b").alias("node"), "t"))
    value = cut(level.join(own.groupBy("node").agg(F.bit_xor("t").alias("t")), "node", "left").select("node", "depth", "parent", F.coalesce("t", F.lit(0)).alias("t")))
    for d in range(depth - 1, 0, -1):  # subtrees fold into their parents, the deepest first
        up = value.where(F.col("depth") == d).groupBy(F.col("parent").alias("node")).agg(F.bit_xor("t").alias("more"))
        value = cut(value.join(up, "node", "left").select("node", "depth", "parent", F.col("t").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("t")))
    return value.where("parent is not null and t = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))


def edge_betweenness(arcs: DataFrame, weight: str = "length", k: int | None = None, seed: int = 12, normalised: bool = True) -> DataFrame:
    """(u, v, k, betweenness) of each arc by weighted shortest paths from all nodes, or from a sample of ``k``.

    On the shortest-path graph of a source the number of paths spreads forward and x = sum over successors of
    (1/paths + ...) backward; both are linear, so each hop is one join. An arc's credit is paths(u) * x(v), shared
    equally by its cheapest parallels.
    """
    hops = cut(cheapest(arcs, weight).select("u", "v", "w").where("u <> v"))
    nodes = cut(nodes_of(arcs))
    n = nodes.count()
    chosen = nodes if k is None or k >= n else nodes.orderBy(uniform(seed, F.col("node")), "node").limit(k)
    sources = min(k or n, n)
    dist = cut(distances(hops, chosen.select(F.col("node").alias("src"))))
    d = lambda at, to: dist.select("src", F.col("node").alias(at), F.col("dist").alias(to))
    dag = cut(d("u", "du").join(hops, "u").join(d("v", "dv"), ["src", "v"]).where("du + w = dv").select("src", "u", "v"))
    ways = cut(dist.where("node = src").select("src", "node", F.lit(1.0).alias("x")))
    sigma = step = ways
    while True:
        step = cut(step.withColumnRenamed("node", "u").join(dag, ["src", "u"]).groupBy("src", F.col("v").alias("node")).agg(F.sum("x").alias("x")))
        if step.isEmpty():
            break
        sigma = cut(sigma.unionByName(step).groupBy("src", "node").agg(F.sum("x").alias("x")))
    back = step = cut(sigma.select("src", "node", (F.lit(1.0) / F.col("x")).alias("x")))
    while True:
        step = cut(step.withColumnRenamed("node", "v").join(dag, ["src", "v"]).groupBy("src", F.col("u").alias("node")).agg(F.sum("x").alias("x")))
        if step.isEmpty():
            break
        back = cut(back.unionByName(step).groupBy("src", "node").agg(F.sum("x").alias("x")))
    credit = dag.join(sigma.select("src", F.col("node").alias("u"), F.col("x").alias("s")), ["src", "u"]).join(back.select("src", F.col("node").alias("v"), F.col("x").alias("t")), ["src", "v"])
    per_pair = credit.groupBy("u", "v").agg(F.sum(F.col("s") * F.col("t")).alias("c"))
    scale = (1.0 / (n * (n - 1)) if normalised and n > 1 else 1.0) * (n / sources if sources else 1.0)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in arcs.columns else F.lit(1.0)
    tied = arcs.select("u", "v", "k", w.alias("aw")).join(hops.select("u", "v", "w"), ["u", "v"], "left")
    ties = tied.where("aw = w").groupBy("u", "v").agg(F.count(F.lit(1)).alias("ties"))
    out = tied.join(per_pair, ["u", "v"], "left").join(ties, ["u", "v"], "left")
    share = F.when(F.col("aw") == F.col("w"), F.col("c") / F.col("ties") * scale)
    return out.select("u", "v", "k", F.coalesce(share, F.lit(0.0)).alias("betweenness"))


def impute_by_neighbours(nodes: DataFrame, arcs: DataFrame, column: str = "elevation", rounds: int = 10) -> DataFrame:
    """Missing or NaN values become the median of the neighbours' values, all at once in each round, until none changes."""
    both = cut(arcs.select("u", "v").union(arcs.select("v", "u")).where("u <> v").distinct().toDF("u", "v"))
    value = F.when(~F.isnan(column), F.col(column))
    now = cut(nodes.withColumn(column, value))
    for _ in range(rounds):
        near = both.join(now.select(F.col("node_id").alias("v"), F.col(column).alias("near")).where("near is not null"), "v")
        new = near.groupBy(F.col("u").alias("node_id")).agg(F.median("near").alias("new"))
        open_ = now.where(F.col(column).isNull()).select("node_id").join(new, "node_id")
        open_ = cut(open_)
        if open_.isEmpty():
            break
        now = cut(now.join(open_, "node_id", "left").withColumn(column, F.coalesce(column, "new")).drop("new"))
    return now

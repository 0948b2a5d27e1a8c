"""Travel demand: random pairs, home-based tours with gravity choice, hourly timelines, calibration.

Every draw is a hash of the seed and the row's key, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import expr, geom
from ..functions.expr import uniform
from ..state import cut
from .aggregates import mean_path_length, od_matrix, row_shares
from .graph import od_costs, priced_od

BUCKETS = 1024
#: Nodes whose cells are broadcast at most, nine times each.
SENT = 200_000


def indexed(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Numbers from 0 by (key modulo 1024, key): counts of the buckets are added up, rows are ranked within theirs."""
    own = df.withColumn("_b", F.pmod(F.col(key), F.lit(BUCKETS)))
    base = own.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # 1024 rows at most
    base = base.withColumn("_base", F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_base", F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return own.withColumn("_r", rank).join(F.broadcast(base), "_b").withColumn(name, F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def pick(draws: DataFrame, items: DataFrame, seed: int, draw: str, keys: list[str], prefix: str) -> DataFrame:
    """One item for each draw, uniformly; items have idx from 0. Columns of the item get the prefix."""
    n = items.agg(F.count(F.lit(1)).alias("_n"))
    own = draws.crossJoin(n).withColumn("_i", F.floor(uniform(seed, F.lit(draw), *(F.col(k) for k in keys)) * F.col("_n")).cast("long")).drop("_n")
    return own.join(items.select(F.col("idx").alias("_i"), *(F.col(c).alias(f"{prefix}{c}") for c in items.columns if c != "idx")), "_i").drop("_i")


def random_od(nodes: DataFrame, n: int, least: float = 500.0, seed: int = 12) -> DataFrame:
    """(o, d, w): ``n`` random pairs of different nodes at least so far apart, from 50 n tries at most, counted."""
    items = indexed(nodes.select("node_id", "x", "y"), "node_id")
    tries = nodes.sparkSession.range(50 * n).withColumnRenamed("id", "try")
    both = pick(pick(tries, items, seed, "o", ["try"], "a_"), items, seed, "d", ["try"], "b_")
    far = geom.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    kept = both.where((F.col("a_node_id") != F.col("b_node_id")) & (far >= least)).orderBy("try").limit(n)
    return kept.groupBy(F.col("a_node_id").alias("o"), F.col("b_node_id").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def cumulative(df: DataFrame, weight: str, by: list[str], order: list[str]) -> DataFrame:
    """lo and hi of each row in [0, 1): its share of the weight of its group, in order."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    hi = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    out = df.withColumn("hi", hi)
    return out.withColumn("lo", F.coalesce(F.lag("hi").over(w.orderBy(*order)), F.lit(0.0)))


def weighted_pick(draws: DataFrame, table: DataFrame, u: str, by: list[str], grid: int = 256) -> DataFrame:
    """Join each draw to the row whose [lo, hi) holds it, by an equi-join on cells of [0, 1) and the exact test."""
    cell = F.explode(F.sequence(F.floor(F.col("lo") * grid).cast("int"), F.least(F.lit(grid - 1), F.floor(F.col("hi") * grid).cast("int"))))
    spread = table.withColumn("_c", cell)
    own = draws.withColumn("_c", F.floor(F.col(u) * grid).cast("int"))
    return own.join(spread, [*by, "_c"]).where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("_c", "lo", "hi", u)


def point_in(ring: Column, seed: int, keys: list[Column], tries: int = 100) -> Column:
    """A uniform point of the polygon by rejection; no hit within the tries is an error."""
    b = geom.bounds(ring)
    at = lambda i, c, lo, hi: lo + uniform(seed, F.lit(c), i, *keys) * (hi - lo)
    points = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: geom.point(at(i, "x", b["x0"], b["x1"]), at(i, "y", b["y0"], b["y1"])))
    hit = F.filter(points, lambda p: geom.contains(ring, p["x"], p["y"]))
    return F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(1))).otherwise(F.raise_error(F.lit("no point found in a polygon")))


def nearest_node(points: DataFrame, nodes: DataFrame, keys: list[str], size: float | None = None) -> DataFrame:
    """(*keys, node) of each point (keys, x, y), the smaller id on ties. Each point meets one row, the list of the nodes
    in its cell and the eight around it; those whose best is farther than a cell try again with cells four times as wide.
    The first cells hold about two nodes each, if ``size`` is not given. Points are not copied for their cells."""
    at = cut(nodes.where("x is not null and y is not null").select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")))
    e = at.agg(F.count(F.lit(1)).alias("n"), (F.max("nx") - F.min("nx")).alias("w"), (F.max("ny") - F.min("ny")).alias("h")).first()
    if not e["n"]:
        raise ValueError("there are no nodes with coordinates")
    size = size or max(1e-3, (2.0 * max(e["w"], 1.0) * max(e["h"], 1.0) / e["n"]) ** 0.5)
    grid = lambda c, by: F.floor(F.col(c) / by).cast("long")
    left, done, around = points.select(*keys, "x", "y"), None, F.sequence(F.lit(-1), F.lit(1))
    while True:
        spread = at.withColumn("cx", F.explode(F.transform(around, lambda k: grid("nx", size) + k))).withColumn("cy", F.explode(F.transform(around, lambda k: grid("ny", size) + k)))
        near = spread.groupBy("cx", "cy").agg(F.collect_list(F.struct("node_id", "nx", "ny")).alias("near"))
        near = F.broadcast(near) if e["n"] <= SENT else near
        far = lambda p: F.struct(geom.distance(F.col("x"), F.col("y"), p["nx"], p["ny"]).alias("far"), p["node_id"].alias("node"))  # noqa: B023, E731
        met = left.withColumn("cx", grid("x", size)).withColumn("cy", grid("y", size)).join(near, ["cx", "cy"], "left")
        met = cut(met.select(*keys, "x", "y", F.array_min(F.transform("near", far)).alias("m")))
        within = F.coalesce(F.col("m.far") <= size, F.lit(False))
        found = met.where(within).select(*keys, F.col("m.node").alias("node"))
        done = found if done is None else done.unionByName(found)
        left, size = met.where(~within & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "x", "y"), size * 4
        if left.isEmpty():
            return done


def purpose_shares(counts: DataFrame) -> DataFrame:
    """(region, purpose, share) of trips (region, purpose, trips); a region without trips is an error."""
    total = F.sum("trips").over(Window.partitionBy("region"))
    return counts.withColumn("share", F.when(total > 0, F.col("trips") / total).otherwise(F.raise_error(F.lit("a region has no trips"))))


def fitting(destinations: DataFrame, types: DataFrame) -> DataFrame:
    """``destinations`` with each purpose (purpose, types) that they serve; "*" stands for every type. The purposes are
    a literal table of nine rows."""
    fits = F.array_contains("types", "*") | F.array_contains("types", F.col("dest_type"))
    return destinations.crossJoin(F.broadcast(types)).where(fits).drop("types")


def tours(draws: DataFrame, residential: DataFrame, destinations: DataFrame, nodes: DataFrame, seed: int = 12, beta: Column | float = dims.DEFAULT_BETA, max_dist: float | None = None) -> DataFrame:
    """(*keys, o, d): both legs of each home-based tour; tours whose ends snap to one node vanish.

    Keys are the columns of ``draws``, such as hour, beta and tour. The home is a polygon of ``residential`` (res_id,
    ring, region, prob) by probability and a point in it; the destination's region follows the home's, the purpose the
    destination's region, and the destination, of ``destinations`` (dest_id, x, y, dest_type, region), the weight
    exp(-beta distance): the least of -ln(draw) / weight has the right chances and needs no sorted sums. A tour without
    a candidate is an error.
    """
    keys = draws.columns
    spark, k = draws.sparkSession, [F.col(c) for c in draws.columns]
    u = lambda name: uniform(seed, F.lit(name), *k)
    homes = cumulative(residential.select("res_id", "ring", F.col("region").alias("origin"), "prob"), "prob", [], ["res_id"])
    own = weighted_pick(draws.withColumn("_u", u("home")), homes, "_u", [])
    own = own.withColumn("_p", point_in(F.col("ring"), seed, k)).withColumn("hx", F.col("_p.x")).withColumn("hy", F.col("_p.y")).drop("_p", "ring")
    regions = cumulative(dims.region_counts(spark).withColumnRenamed("destination", "region"), "trips", ["origin"], ["region"])
    own = weighted_pick(own.withColumn("_u", u("region")), regions.drop("trips"), "_u", ["origin"])
    purposes = cumulative(dims.purpose_counts(spark), "trips", ["region"], ["purpose"])
    own = weighted_pick(own.withColumn("_u", u("purpose")), purposes.drop("trips"), "_u", ["region"])
    types = dims.purpose_types(spark)
    fits = fitting(destinations, types).select("dest_id", F.col("x").alias("dx"), F.col("y").alias("dy"), "region", "purpose")
    met = own.join(fits, ["region", "purpose"], "left")
    far = geom.distance(F.col("hx"), F.col("hy"), F.col("dx"), F.col("dy"))
    met = met.withColumn("_far", far) if max_dist is None else met.withColumn("_far", F.when(far <= max_dist, far))
    b = F.lit(beta) if isinstance(beta, float) else beta
    key = -F.ln(1.0 - uniform(seed, F.lit("dest"), *k, F.col("dest_id"))) / F.exp(-b * F.col("_far"))
    best = met.groupBy(*keys, "hx", "hy").agg(F.min_by(F.struct("dx", "dy"), F.when(F.col("_far").isNotNull(), F.struct(key, F.col("dest_id")))).alias("p"))
    checked = F.when(F.col("p").isNull(), F.raise_error(F.lit("a tour has no destination within reach"))).otherwise(F.col("p"))
    ends = cut(best.withColumn("p", checked).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("hx").alias("x"), F.col("hy").alias("y")), F.struct(F.lit(1).alias("leg"), F.col("p.dx").alias("x"), F.col("p.dy").alias("y")))).alias("e")).select(*keys, "e.*"))
    snapped = nearest_node(ends, nodes, [*keys, "leg"])
    pair = snapped.groupBy(*keys).agg(F.max(F.when(F.col("leg") == 0, F.col("node"))).alias("h"), F.max(F.when(F.col("leg") == 1, F.col("node"))).alias("t")).where("h <> t")
    out = pair.select(*keys, F.col("h").alias("o"), F.col("t").alias("d"))
    return out.unionByName(pair.select(*keys, F.col("t").alias("o"), F.col("h").alias("d")))


def count_od(legs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return legs.groupBy(*by, "o", "d").agg(F.count(F.lit(1)).cast("double").alias("w"))


def add_od(*parts: DataFrame) -> DataFrame:
    """Demand added up; pairs without positive weight go."""
    out = parts[0].select("o", "d", "w")
    for p in parts[1:]:
        out = out.unionByName(p.select("o", "d", "w"))
    return out.groupBy("o", "d").agg(F.sum("w").alias("w")).where("w > 0")


def gen_od(nodes: DataFrame, residential: DataFrame, destinations: DataFrame, n: int, random_frac: float = 0.0, seed: int = 12, beta: float = dims.DEFAULT_BETA, max_dist: float | None = None, least: float = 500.0) -> DataFrame:
    """(o, d, w) of ``n`` trips: floor(n * random_frac) random pairs, and tours of two trips each for the rest."""
    if not 0 <= random_frac <= 1:
        raise ValueError("random_frac must lie between 0 and 1")
    n_random = int(n * random_frac)
    n_tours = -(-(n - n_random) // 2)
    parts = []
    if n_tours:
        draws = nodes.sparkSession.range(n_tours).withColumnRenamed("id", "tour")
        parts.append(count_od(tours(draws, residential, destinations, nodes, seed, beta, max_dist)))
    if n_random:
        parts.append(random_od(nodes, n_random, least, seed))
    return add_od(*parts) if parts else nodes.sparkSession.createDataFrame([], "o long, d long, w double")


def gen_timeline(trips_per_hour: list[int], nodes: DataFrame, residential: DataFrame, destinations: DataFrame, seed: int = 12, beta: float = dims.DEFAULT_BETA) -> DataFrame:
    """(begin, end, o, d, w) by the hour, seconds from midnight; one plan for all hours."""
    spark = nodes.sparkSession
    hours = spark.createDataFrame([(h, -(-n // 2)) for h, n in enumerate(trips_per_hour) if n > 0], "hour int, n int")
    draws = hours.select("hour", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("tour"))
    legs = count_od(tours(draws, residential, destinations, nodes, seed, beta), ("hour",))
    return legs.select((F.col("hour") * 3600).alias("begin"), ((F.col("hour") + 1) * 3600).alias("end"), "o", "d", "w")


def auxiliary_chain(od: DataFrame, nodes: DataFrame, seed: int | None = None) -> DataFrame:
    """Zero-weight pairs along a chain of the distinct nodes and back to its start, where the demand lacks them; fewer
    than two nodes change nothing. A seed shuffles the chain."""
    order = [F.col("node_id")] if seed is None else [uniform(seed, F.col("node_id")), F.col("node_id")]
    w = Window.orderBy(*order)
    own = nodes.select("node_id").distinct()
    ends = own.agg(F.count(F.lit(1)).alias("n"), F.min_by("node_id", F.struct(*order)).alias("first"))
    chain = own.withColumn("next", F.lead("node_id").over(w)).crossJoin(ends).where("n > 1").select(F.col("node_id").alias("o"), F.coalesce("next", "first").alias("d"))
    new = chain.where("o <> d").distinct().join(od.select("o", "d"), ["o", "d"], "left_anti")
    return od.select("o", "d", "w").unionByName(new.withColumn("w", F.lit(0.0)))


def calibration(arcs: DataFrame, od: DataFrame, nodes: DataFrame, target: float = dims.TARGET_LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix by region, its row shares, one row of avg_length and abs_error against the target)."""
    matrix = od_matrix(od, nodes, "region", (), dims.REGIONS if set(r["region"] for r in nodes.select("region").distinct().limit(6).collect()) <= set(dims.REGIONS) else None)
    length = mean_path_length(priced_od(arcs, od)).select(F.col("avg_length_all").alias("avg_length"), F.abs(F.lit(target) - F.col("avg_length_all")).alias("abs_error"))
    return matrix, row_shares(matrix), length


def random_baseline(arcs: DataFrame, nodes: DataFrame, n: int = 50_000, least: float = 3000.0, seed: int = 12, target: float = dims.TARGET_LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The calibration tables of ``n`` random trips of nodes at least so far apart, to hold the gravity model against."""
    return calibration(arcs, cut(random_od(nodes, n, least, seed)), nodes, target)


def beta_sweep(betas: list[float], n_tours: int, arcs: DataFrame, residential: DataFrame, destinations: DataFrame, nodes: DataFrame, seed: int = 12, target: float = dims.TARGET_LENGTH) -> DataFrame:
    """(beta, avg_length, abs_error) of each beta. All share their draws and one plan, with beta as a key."""
    spark = nodes.sparkSession
    draws = spark.createDataFrame([(b,) for b in betas], "beta double").crossJoin(spark.range(n_tours).withColumnRenamed("id", "tour"))
    legs = tours(draws, residential, destinations, nodes, seed, F.col("beta"))
    demand = cut(count_od(legs, ("beta",)))
    costs = od_costs(arcs, demand.groupBy("o", "d").agg(F.sum("w").alias("w")))
    met = demand.join(costs, ["o", "d"], "left")
    return met.groupBy("beta").agg(expr.safe_div(F.sum(F.col("w") * F.col("cost")), F.sum("w")).alias("avg_length")).withColumn("abs_error", F.abs(F.lit(target) - F.col("avg_length")))


# -- spatial preparation -------------------------------------------------------------------------------------------


def residential_probability(joined: DataFrame) -> DataFrame:
    """``joined`` (res_id, ring, locality, population) with res_area, raw_weight and prob: residents spread over the
    area of their locality's polygons. Localities without a population go."""
    own = joined.where("population is not null").withColumn("res_area", geom.area(F.col("ring")))
    raw = F.col("population") * expr.safe_div(F.col("res_area"), F.sum("res_area").over(Window.partitionBy("locality")))
    own = own.withColumn("raw_weight", raw)
    total = own.agg(F.sum("raw_weight").alias("_t"))
    return own.crossJoin(total).withColumn("prob", expr.safe_div(F.col("raw_weight"), F.col("_t"))).drop("_t")


def attach_locality(residential: DataFrame, localities: DataFrame, populations: DataFrame, size: float = 1000.0) -> DataFrame:
    """Residential polygons with the first locality by name that they meet, its region and population."""
    from .prep import lines_in_polygons

    met = lines_in_polygons(residential.select("res_id", F.col("ring").alias("geometry")), localities, ["res_id"], size)
    first = met.groupBy("res_id").agg(F.min("name").alias("locality"))
    named = residential.select("res_id", "ring").join(first, "res_id").join(localities.select(F.col("name").alias("locality"), "region"), "locality")
    return residential_probability(named.join(populations, "locality", "left"))


def residential_polygons(features: DataFrame) -> DataFrame:
    """(res_id, ring) of features (id, ring): those that touch or overlap are one residence, under the smallest id.

    The rings stay apart, one row each: areas, centroids and points are taken ring by ring."""
    from .prep import merge_touching

    return merge_touching(features).select(F.col("part").alias("res_id"), "ring")


def destinations_of(pois: DataFrame, localities: DataFrame, size: float = 1000.0, edges: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, x, y, dest_type, locality, region) of points of interest; one may lie in several localities, and localities
    without a region go. A point on the edge of a locality lies in it, unless ``edges`` is false."""
    from .prep import cells

    kind = expr.destination_type(F.col("office"), F.col("shop"), F.col("amenity"))
    a = pois.select(*keys, "x", "y", kind.alias("dest_type"), F.struct(F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy")).alias("cell"))
    b = localities.where("region is not null").select("name", "region", "ring", geom.bounds(F.col("ring")).alias("_b"), F.explode(cells(F.col("ring"), size)).alias("cell"))
    near = F.col("x").between(F.col("_b.x0"), F.col("_b.x1")) & F.col("y").between(F.col("_b.y0"), F.col("_b.y1"))
    at = (F.col("ring"), F.col("x"), F.col("y"))
    inside = geom.contains(*at) | geom.on_ring(*at) if edges else geom.contains(*at) & ~geom.on_ring(*at)
    return a.join(b, "cell").where(near & inside).select(*keys, "x", "y", "dest_type", F.col("name").alias("locality"), "region")


def residential_destinations(joined: DataFrame) -> DataFrame:
    """The centroids of residential polygons as destinations of their own type."""
    c = geom.centroid(F.col("ring"))
    return joined.select(c["x"].alias("x"), c["y"].alias("y"), F.lit("residential").alias("dest_type"), "locality", "region")


def od_lines(od: DataFrame, nodes: DataFrame) -> DataFrame:
    """(o, d, w, line) of straight lines between the ends."""
    at = nodes.select("node_id", "x", "y")
    met = od.join(at.toDF("o", "ax", "ay"), "o").join(at.toDF("d", "bx", "by"), "d")
    return met.select("o", "d", "w", geom.straight(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("line"))

"""Cleaning and enrichment of raw arcs and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import expr, geom
from ..state import cut
from .graph import bridges, impute_by_neighbours, largest_strong_component, weak_components
from .views import ARC, is_true


def merge_modes(drive: DataFrame, bike: DataFrame, truncate: bool = False) -> DataFrame:
    """Full outer union of two networks on (u, v, k); the bike network's attributes win, flags say who may use an arc."""
    drive = largest_strong_component(drive) if truncate else drive
    columns = list(dict.fromkeys([*bike.columns, *drive.columns]))
    a, b = drive.withColumn("_d", F.lit(True)).alias("a"), bike.withColumn("_b", F.lit(True)).alias("b")
    met = a.join(b, ARC, "full_outer")

    def pick(c: str):
        have = [F.col(f"{t}.{c}") for t, df in (("b", bike), ("a", drive)) if c in df.columns]
        return F.coalesce(*have).alias(c)

    rest = [pick(c) for c in columns if c not in (*ARC, "car_allowed", "bike_allowed")]
    return met.select(*ARC, *rest, F.col("a._d").isNotNull().alias("car_allowed"), F.col("b._b").isNotNull().alias("bike_allowed"))


def ensure_reverse(arcs: DataFrame) -> DataFrame:
    """One synthetic arc back for each arc whose pair has none: bikes may use it as they may use the arc, cars not."""
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
    alone = arcs.join(back, ["u", "v"], "left_anti")
    changed = {"u": F.col("v"), "v": F.col("u"), "car_allowed": F.lit(False), "car_lanes": F.lit(0), "bike_lanes": F.lit(0), "reallocatable": F.lit(False)}
    kinds = dict(arcs.dtypes)
    made = alone.select(*((changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(c)) for c in arcs.columns))
    return arcs.unionByName(made)


def fill_geometry(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Straight lines between the ends where an arc has no geometry."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    line = geom.straight(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    own = arcs if "geometry" in arcs.columns else arcs.withColumn("geometry", F.lit(None).cast(f"array<{geom.POINT}>"))
    return own.join(a, "u", "left").join(b, "v", "left").withColumn("geometry", F.coalesce("geometry", line)).drop("ux", "uy", "vx", "vy").select(*own.columns)


def add_elevation(nodes: DataFrame, table: DataFrame | None = None, default: float = 0.0) -> DataFrame:
    """Elevations from a table (node_id, elevation); without one the default for every node."""
    bare = nodes.drop("elevation")
    return bare.join(table.select("node_id", "elevation"), "node_id", "left") if table is not None else bare.withColumn("elevation", F.lit(default))


def add_grades(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """grade: rise over length, clamped to ±0.2, and grade_abs."""
    e = nodes.select(F.col("node_id"), "elevation")
    met = arcs.join(e.toDF("u", "eu"), "u", "left").join(e.toDF("v", "ev"), "v", "left")
    grade = F.try_divide(F.col("ev") - F.col("eu"), F.col("length"))
    clamped = F.when(grade.isNotNull(), F.greatest(F.lit(-0.2), F.least(F.lit(0.2), grade)))
    return met.withColumn("grade", clamped).withColumn("grade_abs", F.abs("grade")).drop("eu", "ev").select(*[c for c in arcs.columns if c not in ("grade", "grade_abs")], "grade", "grade_abs")


def fold_tags(arcs: DataFrame) -> DataFrame:
    """Synonyms folded, then one label for each of highway, bicycle and cycleway."""
    out = arcs.withColumn("highway", expr.fold_highway(F.col("highway")))
    for c, order in (("highway", expr.HIGHWAY_PRIORITY), ("bicycle", expr.BICYCLE_PRIORITY), ("cycleway", expr.CYCLEWAY_PRIORITY)):
        out = out.withColumn(c, expr.primary_label(F.col(c), order))
    return out


def standard_lanes(arcs: DataFrame) -> DataFrame:
    """car_lanes and bike_lanes from the raw lanes, which go: at least the default where the mode is allowed."""
    raw = expr.clean_lanes(F.col("lanes"))
    car = F.when(is_true("car_allowed"), F.coalesce(raw, F.lit(1))).otherwise(1)
    bike = F.when(is_true("bike_allowed"), F.coalesce(raw, F.lit(0))).otherwise(0)
    return arcs.withColumn("car_lanes", car.cast("int")).withColumn("bike_lanes", bike.cast("int")).drop("lanes")


def roundabouts_oneway(arcs: DataFrame) -> DataFrame:
    return arcs.withColumn("oneway", F.when(F.col("junction") == "roundabout", True).otherwise(F.col("oneway")))


def classify_safety(arcs: DataFrame) -> DataFrame:
    out = arcs.withColumn("infra_type", expr.infra_type(F.col("highway"), F.col("bicycle"), F.col("cycleway")))
    out = out.withColumn("safety", expr.safety_class(F.col("infra_type"), F.col("highway")))
    return out.withColumn("risk_factor", expr.risk_factor(F.col("safety")))


def bike_costs(arcs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """bike_cost_base and bike_cost_penalty of all arcs, or of those in ``only`` (u, v, k)."""
    grade = F.col("grade") if "grade" in arcs.columns else F.lit(None).cast("double")
    base = expr.bike_cost_base(F.col("length"), grade)
    if only is None:
        return arcs.withColumn("bike_cost_base", base).withColumn("bike_cost_penalty", F.col("bike_cost_base") * F.col("risk_factor"))
    met = arcs.join(only.select(*ARC).distinct().withColumn("_hit", F.lit(True)), ARC, "left")
    new = F.when(F.col("_hit"), base).otherwise(F.col("bike_cost_base"))
    penalty = F.when(F.col("_hit"), base * F.col("risk_factor")).otherwise(F.col("bike_cost_penalty"))
    return met.withColumns({"bike_cost_base": new, "bike_cost_penalty": penalty}).drop("_hit").select(*arcs.columns)


def car_costs(arcs: DataFrame) -> DataFrame:
    return arcs.withColumn("car_cost_current", F.col("length"))


def set_attribute(arcs: DataFrame, arc: tuple[int, int, int], name: str, value) -> DataFrame:
    """One attribute of one arc."""
    u, v, k = arc
    hit = (F.col("u") == u) & (F.col("v") == v) & (F.col("k") == k)
    old = F.col(name) if name in arcs.columns else F.lit(None)
    return arcs.withColumn(name, F.when(hit, F.lit(value)).otherwise(old))


RULES = ("bridge", "existing_bike_infra", "no_car_allowed", "roundabouts", "reallocatable")


def tag_reallocatable(arcs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """reallocatable and rule, by the first rule that holds: bridge, bike infrastructure, no cars, roundabout, else yes."""
    pairs = (found if found is not None else bridges(arcs)).withColumn("_bridge", F.lit(True))
    met = arcs.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(pairs, ["a", "b"], "left")
    junction = F.col("junction") if "junction" in arcs.columns else F.lit(None).cast("string")
    rule = (
        F.when(F.col("_bridge"), RULES[0])
        .when(F.col("infra_type").isin("cycle_track", "bike_lane"), RULES[1])
        .when(~is_true("car_allowed"), RULES[2])
        .when(junction == "roundabout", RULES[3])
        .otherwise(RULES[4])
    )
    kept = [c for c in arcs.columns if c not in ("reallocatable", "rule")]
    return met.select(*kept, (rule == RULES[4]).alias("reallocatable"), rule.alias("rule"))


def rule_counts(tagged: DataFrame) -> DataFrame:
    """(rule, n) with a total."""
    return tagged.rollup("rule").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("rule", F.lit("total")).alias("rule"), "n")


def audit(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: nodes without elevation, arcs without grade, arcs with a grade that is not finite."""
    n = nodes.agg(F.count_if(expr.missing(F.col("elevation"))).alias("nodes_without_elevation"), F.count(F.lit(1)).alias("nodes"))
    a = arcs.agg(F.count_if(F.col("grade").isNull()).alias("arcs_without_grade"), F.count_if(F.isnan("grade") | (F.abs("grade") == float("inf"))).alias("arcs_with_bad_grade"), F.count(F.lit(1)).alias("arcs"))
    return n.crossJoin(a)  # one row each


def largest_part(places: DataFrame) -> DataFrame:
    """(name, region, ring): the largest ring of each named place, the first row of a name; null names and rings go."""
    parts = places.where("name is not null and ring is not null")
    return parts.groupBy("name").agg(F.max_by(F.struct("region", "ring"), geom.area(F.col("ring"))).alias("m")).select("name", "m.region", "m.ring")


def admin_areas(features: DataFrame, level: str = "8") -> tuple[DataFrame, DataFrame]:
    """(localities with region, regions as sets of rings) from features (admin_level, name, ring)."""
    own = features.where(F.col("admin_level") == level).select("name", F.lit(None).cast("string").alias("region"), "ring")
    mapped = F.broadcast(dims.locality_regions(features.sparkSession).toDF("name", "region"))  # a literal table
    local = largest_part(own).drop("region").join(mapped, "name", "left").select("name", "region", "ring")
    return local, local.where("region is not null").select(F.col("region").alias("name"), "ring")


def cells(ring, size: float):
    """The grid cells that the bounds of a line or ring touch."""
    b = geom.bounds(ring)
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return F.flatten(F.transform(span(b["x0"], b["x1"]), lambda i: F.transform(span(b["y0"], b["y1"]), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def lines_in_polygons(lines: DataFrame, polygons: DataFrame, keys: list[str], size: float = 1000.0) -> DataFrame:
    """(*keys, name): every polygon that a line meets, by an equi-join on grid cells and the exact test behind it."""
    a = lines.where("geometry is not null").select(*keys, "geometry", F.explode(cells(F.col("geometry"), size)).alias("cell"))
    b = polygons.where("ring is not null").select("name", "ring", F.explode(cells(F.col("ring"), size)).alias("cell"))
    return a.join(b, "cell").where(geom.meets_polygon(F.col("geometry"), F.col("ring"))).select(*keys, "name").distinct()


def nearest_polygon(points: DataFrame, polygons: DataFrame, keys: list[str], size: float = 1000.0) -> DataFrame:
    """(*keys, name) of the nearest polygon to each point (keys, x, y), the first name on ties. Points meet the polygons
    of their own and the neighbouring cells; those whose best is farther than a cell try again with cells four times as
    wide. Points without coordinates are left out, and so are all if there are no polygons."""
    left = cut(points.where("x is not null and y is not null").select(*keys, "x", "y"))
    areas = polygons.where("ring is not null and size(ring) > 3").select("name", "ring")
    done = left.select(*keys, F.lit(None).cast("string").alias("name")).limit(0)
    if areas.isEmpty():
        return done
    far = geom.polygon_distance(F.col("x"), F.col("y"), F.col("ring"))
    while not left.isEmpty():
        near = lambda c: F.sequence(F.floor(F.col(c) / size).cast("long") - 1, F.floor(F.col(c) / size).cast("long") + 1)
        around = F.flatten(F.transform(near("x"), lambda i: F.transform(near("y"), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
        met = left.withColumn("cell", F.explode(around)).join(areas.withColumn("cell", F.explode(cells(F.col("ring"), size))), "cell")
        best = met.groupBy(*keys).agg(F.min(F.struct(far.alias("far"), F.col("name"))).alias("m")).where(F.col("m.far") <= size)
        found = cut(best.select(*keys, "m.name"))
        done, left, size = done.unionByName(found), cut(left.join(found, keys, "left_anti")), size * 4
    return done


def dissolve(polygons: DataFrame, by: str) -> DataFrame:
    """(by, rings, area): the polygons of each value as one set of rings; null rings go. What lies in one of the rings
    lies in the set (:func:`geom.any_contains`). Administrative areas have tens of parts."""
    parts = polygons.where("ring is not null")
    return parts.groupBy(by).agg(F.array_sort(F.collect_list("ring")).alias("rings"), F.sum(geom.area(F.col("ring"))).alias("area"))


def merge_touching(polygons: DataFrame, size: float = 1000.0) -> DataFrame:
    """``polygons`` (id, ring) with ``part``: the smallest id of those that touch or overlap each other, directly or
    through others. Candidates share a grid cell; an exact test follows."""
    own = cut(polygons.where("ring is not null and size(ring) > 3").select("id", "ring"))
    at = own.withColumn("cell", F.explode(cells(F.col("ring"), size)))
    met = at.select(F.col("id").alias("u"), F.col("ring").alias("a"), "cell").join(at.select(F.col("id").alias("v"), F.col("ring").alias("b"), "cell"), "cell").where("u < v")
    edges = cut(met.where(geom.polygons_meet(F.col("a"), F.col("b"))).select("u", "v").distinct())
    part = weak_components(edges).toDF("id", "part")
    return own.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))


def reproject(nodes: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Degrees in x and y as metres of a zone of the universal transverse Mercator grid."""
    at = geom.utm(F.col("x"), F.col("y"), zone, south)
    return nodes.withColumn("_at", at).withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")


def assign_context(items: DataFrame, polygons: DataFrame, keys: list[str], column: str, several: bool, size: float = 1000.0) -> DataFrame:
    """``items`` (keys, geometry) with the sorted names of the polygons they meet, or with the first of them; what meets
    none takes the nearest polygon to its middle. Null geometries get null."""
    met = cut(lines_in_polygons(items, polygons, keys, size))
    rest = items.where("geometry is not null").join(met, keys, "left_anti")
    b = geom.bounds(F.col("geometry"))
    near = nearest_polygon(rest.select(*keys, ((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y")), polygons, keys, size)
    names = met.unionByName(near).groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("_names"))
    value = F.col("_names") if several else F.array_min("_names")
    return items.join(names, keys, "left").withColumn(column, value).drop("_names")


def with_places(items: DataFrame, localities: DataFrame, keys: list[str], several: bool) -> DataFrame:
    """``items`` (keys, geometry) with the localities (name, region, ring) they meet and those localities' regions: as
    sorted lists, or the first locality and its region. Columns are localities and regions, or locality and region."""
    name = "localities" if several else "locality"
    met = assign_context(items, localities, keys, name, several)
    known = localities.select("name", "region").distinct()
    if not several:
        return met.join(known.toDF(name, "region"), name, "left").select(*items.columns, name, "region")
    own = met.select(*keys, F.explode(name).alias("name")).join(known, "name").groupBy(*keys).agg(F.array_sort(F.collect_set("region")).alias("regions"))
    return met.join(own, keys, "left").select(*items.columns, name, "regions")


def clean_simplified(arcs: DataFrame, nodes: DataFrame, elevation: DataFrame | None = None, localities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning of a simplified network: (arcs, nodes). With ``localities`` (name, region, ring) arcs get the
    lists of those that they meet, nodes the first one."""
    nodes = impute_by_neighbours(add_elevation(nodes, elevation), arcs)
    out = ensure_reverse(standard_lanes(fold_tags(fill_geometry(arcs, nodes))))
    out = car_costs(bike_costs(classify_safety(add_grades(out, nodes))))
    if localities is not None:
        out = with_places(cut(out), localities, list(ARC), True)
        at = nodes.drop("locality", "region").withColumn("geometry", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array(geom.point(F.col("x"), F.col("y")))))
        nodes = with_places(at, localities, ["node_id"], False).drop("geometry")
    return tag_reallocatable(cut(out)), nodes


def clean_unsimplified(arcs: DataFrame, nodes: DataFrame, elevation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaning of the simulator-facing network: (arcs, nodes)."""
    nodes = impute_by_neighbours(add_elevation(nodes, elevation), arcs)
    out = add_grades(fill_geometry(roundabouts_oneway(arcs), nodes), nodes)
    return bike_costs(classify_safety(out)), nodes



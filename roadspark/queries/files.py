"""Queries that write tables as files and read them back, and spatial preparation, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import expr, geom
from ..operators import charts, prep
from ..plans import project as pj
from ..sources import osm, simio
from ..state import scratch
from .more import AREAS, _areas
from .network import ARC, WITH, _square

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str = WITH):
    """Register a query under the function's name, with its SQL if that can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_ + sql
        return f

    return put


def _xml(df: DataFrame, name: str, tag: str, root: str = "root") -> str:
    """Write rows as elements of XML files; returns the folder."""
    path = scratch(df.sparkSession, name)
    df.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)
    return path


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


# -- simulator output ----------------------------------------------------------------------------------------------


@query("""select cast(event_id as double) as time, cast(user_id as int) as running, cast(case when event_id % 3 = 0 then 0 else event_id % 7 end as int) as arrived,
 cast(user_id as double) / 4 as "meanSpeed", cast(0 as int) as halting, cast(event_id % 5 as int) as "meanTravelTime" from events""", "")
def src_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a step; an attribute that is absent is 0."""
    e = fx.with_views(spark, d).table("events")
    arrived = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7)
    step = e.select(F.col("event_id").alias("_time"), F.col("user_id").alias("_running"), arrived.alias("_arrived"), (F.col("user_id") / 4).alias("_meanSpeed"), (F.col("event_id") % 5).alias("_meanTravelTime"))
    return simio.load_summary(spark, _xml(step, "summary", "step")).select("time", "running", "arrived", "meanSpeed", "halting", "meanTravelTime")


@query("""select cast(o_orderkey as double) as duration, cast(o_custkey as double) as "routeLength", o_custkey / 8.0e0 as "waitingTime", cast(o_orderkey % 60 as double) as "timeLoss" from orders""", "")
def src_tripinfo(spark, d):
    o = fx.with_views(spark, d).table("orders")
    trip = o.select(F.col("o_orderkey").alias("_duration"), F.col("o_custkey").alias("_routeLength"), (F.col("o_custkey") / 8).alias("_waitingTime"), (F.col("o_orderkey") % 60).alias("_timeLoss"))
    return simio.load_tripinfo(spark, _xml(trip, "tripinfo", "tripinfo"))


_EDGE_ID = "u || '_' || v || '_' || k"


def _intervals(spark, d):
    """Each arc as an edge of its junction's interval."""
    e = F.struct(F.concat_ws("_", *ARC).alias("_id"), (F.col("length") / 16).cast("string").alias("_speed"), F.when(F.col("lanes") > 1, F.col("lanes").cast("string")).alias("_flow"), F.col("k").cast("string").alias("_entered"))
    return fx.arcs(spark, d).groupBy((F.col("u") * 60.0).alias("_begin"), (F.col("u") * 60.0 + 60).alias("_end")).agg(F.array_sort(F.collect_list(e)).alias("edge"))


@query(f"""select {_EDGE_ID} as edge, u * 60.0e0 as time, length / 16 as speed, case when lanes > 1 then cast(lanes as double) else 0.0e0 end as flow, cast(k as double) as entered, 0.0e0 as "waitingTime" from fx_arcs""")
def src_edgedata(spark, d):
    return simio.load_edgedata(spark, _xml(_intervals(spark, d), "edgedata", "interval")).select("edge", "time", "speed", "flow", "entered", "waitingTime")


@query(f"""select u * 60.0e0 as begin, u * 60.0e0 + 60 as "end", id, length / 16 as speed, length / 16 * 3.6e0 as speed_kmh, u * 60.0e0 / 3600 as time_hr, cast(k as double) as entered, 'bike' as mode
 from (select *, {_EDGE_ID} as id, row_number() over (partition by u order by {_EDGE_ID}) as n from fx_arcs) a where n = 1""")
def src_meandata(spark, d):
    """The first edge of each interval."""
    return simio.load_meandata(spark, _xml(_intervals(spark, d), "meandata", "interval"), "bike").select("begin", "end", "id", "speed", "speed_kmh", "time_hr", "entered", "mode")


@query("select cast(o_orderkey as varchar) as id, cast(o_custkey + o_orderkey % 3 as double) as m, (o_custkey + o_orderkey % 3) / 1000.0e0 as km from orders where o_orderkey % 2 = 1", "")
def src_perceived_lengths(spark, d):
    """Bikes whose route is their own, the first of a distribution, or one that they name."""
    way = F.col("o_orderkey") % 3
    cost = F.struct(F.lit(None).cast("string").alias("_id"), (F.col("o_custkey") + way).cast("string").alias("_cost"))
    other = F.struct(F.lit(None).cast("string").alias("_id"), F.lit("0").alias("_cost"))
    own = fx.with_views(spark, d).table("orders")
    named = own.where(way == 2).select(F.concat(F.lit("r"), "o_orderkey").alias("_id"), (F.col("o_custkey") + 2).cast("string").alias("_cost"))
    vehicle = own.select(
        F.col("o_orderkey").cast("string").alias("_id"), F.when(F.col("o_orderkey") % 2 == 1, "bike").otherwise("car").alias("_type"), F.when(way == 2, F.concat(F.lit("r"), "o_orderkey")).alias("_route"),
        F.when(way == 0, cost).alias("route"), F.when(way == 1, F.struct(F.array(cost, other).alias("route"))).alias("routeDistribution"),
    )
    path = scratch(spark, "routes")
    for tag, df in (("vehicle", vehicle), ("route", named)):
        df.write.mode("append").format("xml").option("rootTag", "routes").option("rowTag", tag).save(path)
    return simio.load_perceived_lengths(spark, path, "bike")


@query("select avg(cast(o_custkey as double)) as mean_m, count(*) as trips from orders", "")
def agg_perceived_mean(spark, d):
    """Mean length over trips read from routes of their own."""
    own = fx.with_views(spark, d).table("orders")
    vehicle = own.select(F.col("o_orderkey").cast("string").alias("_id"), F.struct(F.col("o_custkey").cast("string").alias("_cost")).alias("route"))
    return simio.mean_perceived_length(simio.load_perceived_lengths(spark, _xml(vehicle, "trips", "vehicle")))


# -- simulator input -----------------------------------------------------------------------------------------------


@query("""select cast(begin as double) as begin, cast("end" as double) as "end", cast(o as varchar) as origin, cast(d as varchar) as destination, cast(sum(w) as bigint) as n from fx_time group by begin, "end", o, d""")
def snk_od_matrix(spark, d):
    """The counts of a written matrix; half trips are cut off and rows without trips are not written."""
    flow = fx.timeline(spark, d).groupBy("begin", "end", F.col("o").cast("string").alias("origin"), F.col("d").cast("string").alias("destination")).agg((F.sum("w") + 0.5).alias("flow"))
    none = flow.select("begin", "end", "destination", F.col("origin").alias("o"), F.lit(0.5).alias("flow")).toDF("begin", "end", "origin", "destination", "flow")
    path = scratch(spark, "matrix")
    simio.write_od_matrix(flow.unionByName(none.withColumn("origin", F.concat(F.lit("x"), "origin"))), path)
    each = _read(spark, path, "interval", "_begin double, _end double, tazRelation array<struct<_from:string,_to:string,_count:long>>").select("_begin", "_end", F.explode("tazRelation").alias("r"))
    return each.select(F.col("_begin").alias("begin"), F.col("_end").alias("end"), F.col("r._from").alias("origin"), F.col("r._to").alias("destination"), F.col("r._count").alias("n"))


@query("""select 'zone ' || node_id as id, 'taz' as type, '255,128,0' as color, 1 as fill, 5 as points, x || ',' || y as first from fx_nodes""")
def snk_zones(spark, d):
    path, colour = scratch(spark, "zones"), spark.range(1).select(expr.hex_to_rgb(F.lit("#ff8000"))).first()[0]
    n = fx.nodes(spark, d)
    simio.write_zones(n.select(F.concat(F.lit("zone "), F.col("node_id")).alias("name"), _square(F.col("x"), F.col("y"), 9.0).alias("ring")), path, colour)
    z = _read(spark, path, "poly", "_id string, _type string, _color string, _fill int, _shape string")
    at = F.split("_shape", " ")
    return z.select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_color").alias("color"), F.col("_fill").alias("fill"), F.size(at).alias("points"), at[0].alias("first"))


@query(f"select {_EDGE_ID} as id, case when lanes = 1 then length else length / 8 end as effort from fx_arcs where highway <> 'cycleway'")
def snk_bike_weights(spark, d):
    """The cost of each edge, or its length where the cost is no number; inner edges are not written."""
    inner = F.col("highway") == "cycleway"
    edges = fx.arcs(spark, d).select(F.concat(F.when(inner, ":").otherwise(""), F.concat_ws("_", *ARC)).alias("id"), F.when(F.col("lanes") == 1, "none").otherwise((F.col("length") / 8).cast("string")).alias("cost"), "length")
    path = scratch(spark, "weights")
    simio.write_bike_weights(edges, path)
    return _read(spark, path, "edge", "_id string, _effort double").toDF("id", "effort")


@query("select u, v, k, length, highway, lanes, car_allowed, bike_allowed from fx_arcs where car_allowed or bike_allowed")
def snk_network(spark, d):
    """A saved network as it is loaded again."""
    path = scratch(spark, "network")
    simio.save_network(fx.arcs(spark, d), fx.nodes(spark, d), path)
    arcs, _ = simio.load_network(spark, path)
    return arcs.select(*ARC, "length", "highway", "lanes", "car_allowed", "bike_allowed")


@query("""select 'evaluation' as part, o_orderkey as id, cast(o_custkey as double) as value from orders union all select 'event', o_orderkey, cast(o_custkey as double) from orders
 union all select 'arc', u * 1000000 + v * 100 + k, length from fx_arcs""")
def snk_run(spark, d):
    """The three parts of a saved run as they are read again."""
    own = fx.with_views(spark, d).table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("value"))
    path = scratch(spark, "run")
    simio.save_run(own.withColumn("diff_log", F.lit("x")), own, fx.arcs(spark, d), path)
    row = "id long, value double"
    a = spark.read.option("header", True).schema(row).csv(f"{path}/evaluations").select(F.lit("evaluation").alias("part"), "id", "value")
    b = spark.read.schema(row).json(f"{path}/events").select(F.lit("event").alias("part"), "id", "value")
    c = spark.read.parquet(f"{path}/arcs").select(F.lit("arc").alias("part"), (F.col("u") * 1000000 + F.col("v") * 100 + F.col("k")).alias("id"), F.col("length").alias("value"))
    return a.unionByName(b).unionByName(c)


# -- maps ----------------------------------------------------------------------------------------------------------


@query("select locality || ' ' || node_id as name, x + side / 2.0e0 as cx, y + side / 2.0e0 as cy, side * side as area from (select *, 10.0e0 + node_id % 7 as side from fx_nodes) n where node_id % 5 <> 0")
def src_polygons(spark, d):
    """GeoJSON files of one feature each: every third is a multipolygon, every fifth has no geometry."""
    side = 10.0 + F.col("node_id") % 7
    corner = lambda i, j: F.array(F.col("x") + i * side, F.col("y") + j * side)
    rings = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    n = fx.nodes(spark, d)
    many = F.col("node_id") % 3 == 0
    shape = F.when(F.col("node_id") % 5 == 0, "null").otherwise(F.concat(F.lit('{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(many, F.to_json(F.array(rings))).otherwise(F.to_json(rings)), F.lit("}")))
    name = F.to_json(F.struct(F.concat_ws(" ", "locality", "node_id").alias("name")))
    path = scratch(spark, "areas")
    n.select(F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), name, F.lit(',"geometry":'), shape, F.lit("}]}"))).write.option("maxRecordsPerFile", 1).text(path)
    c = geom.centroid(F.col("ring"))
    return simio.load_polygons(spark, path).select("name", F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"), F.round(geom.area(F.col("ring")), 3).alias("area"))


_MAP = """, parts as (select *, u || '_' || v || '_' || k as way, lanes = 2 as one from fx_arcs where not (lanes = 3 and highway = 'service')),
 both_ as (select u, v, way, false as back, one, lanes, highway from parts union all select v, u, way, true, one, lanes, highway from parts where not one),
 numbered as (select *, row_number() over (partition by u, v order by way, back) - 1 as n from both_)"""


def _map(spark, d):
    """The arcs as a map file: two lanes are one-way streets, service roads of three lanes are private."""
    arcs = fx.arcs(spark, d).where("not (lanes = 3 and highway = 'service')").withColumn("oneway", F.when(F.col("lanes") == 2, "yes"))
    path = scratch(spark, "map")
    n = fx.nodes(spark, d).withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000})
    simio.write_osm(n, arcs, path)
    return path


@query(_MAP + "\n select u, v, n as k, highway, cast(lanes as varchar) as lanes, one as oneway, highway <> 'cycleway' as car_allowed, true as bike_allowed from numbered")
def src_osm(spark, d):
    arcs, _ = osm.load_osm(spark, _map(spark, d))
    return arcs.select(*ARC, "highway", "lanes", "oneway", "car_allowed", "bike_allowed")


@query(_MAP + "\n select u, v, row_number() over (partition by u, v order by way) - 1 as k, highway from parts")
def src_osm_simulator(spark, d):
    """Every way in its drawn direction alone."""
    arcs, _ = osm.load_simulator_network(spark, _map(spark, d))
    return arcs.select(*ARC, "highway")


@query("""select node_id, n.x / 1000 as x, n.y / 1000 as y from fx_nodes n where node_id in (select u from fx_arcs where not (lanes = 3 and highway = 'service') union select v from fx_arcs where not (lanes = 3 and highway = 'service'))""")
def src_osm_nodes(spark, d):
    _, nodes = osm.load_osm(spark, _map(spark, d))
    return nodes.select("node_id", "x", "y")


# -- spatial preparation -------------------------------------------------------------------------------------------

_UTM = """, k as (select 1 / 298.257223563e0 as f), c as (select f / (2 - f) as n from k),
 p as (select *, 2 * sqrt(n) / (1 + n) as e, 6378137.0e0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) as a from c),
 q as (select node_id, radians(x / 100 - 50 - 9) as dl, sin(radians(y / 150)) as s, n, e, a from fx_nodes, p),
 r as (select *, sinh(atanh(s) - e * atanh(e * s)) as t from q), z as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from r)
 select node_id, round(500000 + 0.9996e0 * a * (eta + (n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16) * cos(2 * xi) * sinh(2 * eta) + (13 * n * n / 48 - 3 * n * n * n / 5) * cos(4 * xi) * sinh(4 * eta) + 61 * n * n * n / 240 * cos(6 * xi) * sinh(6 * eta)), 4) as east,
  round(0.9996e0 * a * (xi + (n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16) * sin(2 * xi) * cosh(2 * eta) + (13 * n * n / 48 - 3 * n * n * n / 5) * sin(4 * xi) * cosh(4 * eta) + 61 * n * n * n / 240 * sin(6 * xi) * cosh(6 * eta)), 4) as north from z"""


@query(_UTM)
def geo_reproject(spark, d):
    """The nodes' coordinates, taken for degrees, in zone 32."""
    n = fx.nodes(spark, d).select("node_id", (F.col("x") / 100 - 50).alias("x"), (F.col("y") / 150).alias("y"))
    return prep.reproject(n, 32).select("node_id", F.round("x", 4).alias("east"), F.round("y", 4).alias("north"))


@query("""select region, count(*) as parts, round(sum((10.0e0 + node_id) * (10 + node_id)), 3) as area,
 bool_or(x < 5000.5e0 and x + 10 + node_id > 5000.5e0 and y < 5000.5e0 and y + 10 + node_id > 5000.5e0) as covers from fx_nodes group by region""")
def geo_dissolve(spark, d):
    """Squares by region, and whether their union covers the middle of the plane."""
    own = fx.nodes(spark, d).select("region", _square(F.col("x"), F.col("y"), F.lit(10.0) + F.col("node_id")).alias("ring"))
    out = prep.dissolve(own, "region")
    return out.select("region", F.size("rings").cast("long").alias("parts"), F.round("area", 3).alias("area"), geom.any_contains(F.col("rings"), F.lit(5000.5), F.lit(5000.5)).alias("covers"))


@query(""", near as (select a.node_id as a, b.node_id as b from fx_nodes a join fx_nodes b on abs(a.x - b.x) <= 300 and abs(a.y - b.y) <= 300),
 reach(a, b) as (select a, b from near union select reach.a, near.b from reach join near on reach.b = near.a)
 select a as id, min(b) as part from reach group by a""", WITH.replace("with ", "with recursive ", 1))
def geo_merge_touching(spark, d):
    """Squares of 300 units at the nodes: those that touch, directly or through others, are one."""
    own = fx.nodes(spark, d).select(F.col("node_id").alias("id"), _square(F.col("x"), F.col("y"), 300.0).alias("ring"))
    return prep.merge_touching(own).select("id", "part")


_SQUARE_FAR = "sqrt(power(greatest(s.x - (n.x + 0.25e0), 0, n.x + 0.25e0 - s.x - 40), 2) + power(greatest(s.y - (n.y + 0.25e0), 0, n.y + 0.25e0 - s.y - 40), 2))"


@query(f""", squares as (select * from fx_nodes where node_id % 3 = 0) select n.node_id, arg_min('square ' || s.node_id, (round({_SQUARE_FAR}, 6), 'square ' || s.node_id)) as name
 from fx_nodes n cross join squares s group by n.node_id""")
def geo_nearest_polygon(spark, d):
    """The nearest of the squares at every third node to each node."""
    n = fx.nodes(spark, d)
    squares = n.where("node_id % 3 = 0").select(F.concat(F.lit("square "), F.col("node_id")).alias("name"), _square(F.col("x"), F.col("y"), 40.0).alias("ring"))
    return prep.nearest_polygon(n.select("node_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y")), squares, ["node_id"])


@query(f""", {AREAS}, met as (select node_id, min(name) as locality, min('r' || n % 3) as any_region from fx_nodes join areas on x >= x0 and x <= x0 + 2600 and y >= y0 and y <= y0 + 2600 group by node_id)
 select node_id, locality, any_region as region from met""")
def jn_with_places(spark, d):
    """Nodes with their locality and its region."""
    n = fx.nodes(spark, d).select("node_id", F.array(geom.point(F.col("x"), F.col("y"))).alias("geometry"))
    places = _areas(spark).withColumn("region", F.concat(F.lit("r"), F.col("n") % 3))
    return prep.with_places(n, places, ["node_id"], False).select("node_id", "locality", "region")


@query("select node_id as name, nullif(node_id % 4, 0) as population, case when node_id % 4 <> 0 then round((node_id % 4) / 900.0e0, 9) end as density, x + 15 as lx, y + 15 as ly from fx_nodes")
def pl_population_map(spark, d):
    """Each square's residents and density, and where its label stands."""
    own = fx.nodes(spark, d).select(F.col("node_id").alias("name"), _square(F.col("x"), F.col("y"), 30.0).alias("ring"))
    people = fx.nodes(spark, d).select(F.col("node_id").alias("locality"), (F.col("node_id") % 4).alias("population"))
    seen = charts.population_map(own, people).select("name", "population", F.round("density", 9).alias("density"))
    return seen.join(charts.locality_overlay(own).select("name", F.round("x", 3).alias("lx"), F.round("y", 3).alias("ly")), "name")


@query("""select 'ASIA' as "row", t.c as "column", t.s as share from (values ('Work Trips', 0.25e0), ('Shop', 0.75e0)) t(c, s)""", "")
def pl_share_cells(spark, d):
    wide = fx.with_views(spark, d).table("region").where("r_name = 'ASIA'").select(F.col("r_name").alias("region"), F.lit(0.25).alias("work_trips"), F.lit(0.75).alias("shop"))
    return charts.share_cells(wide, "region")


@query("""select u, v, k, case when highway in ('service', 'primary', 'residential') then highway end as label from fx_arcs""")
def prj_label_of_known(spark, d):
    """Empty texts and labels that say nothing are passed over."""
    said = F.array(F.lit(""), F.lit("nan"), F.when(F.col("highway").isin("service", "primary", "residential"), F.col("highway")))
    return fx.arcs(spark, d).select(*ARC, expr.primary_label_of_known(said, expr.HIGHWAY_PRIORITY).alias("label"))


@query("""select least(u, v) as a, greatest(u, v) as b, count(*) as n from fx_arcs group by 1, 2""")
def geo_canonical(spark, d):
    """Arcs of either direction by one key of their line."""
    own = prep.fill_geometry(fx.arcs(spark, d), fx.nodes(spark, d))
    return own.groupBy(geom.canonical(F.col("geometry")).alias("line")).agg(F.min(F.least("u", "v")).alias("a"), F.max(F.greatest("u", "v")).alias("b"), F.count(F.lit(1)).alias("n")).drop("line")


@query("""select node_id, round(least(x + 80, 5000.5e0) - greatest(x, 2000.5e0), 6) as inside from fx_nodes where y > 1000.5e0 and y < 9000.5e0 and least(x + 80, 5000.5e0) > greatest(x, 2000.5e0)""")
def geo_clip(spark, d):
    """Lines of 80 units east of the nodes, within a rectangle."""
    line = geom.straight(F.col("x"), F.col("y"), F.col("x") + 80, F.col("y"))
    corner = lambda x, y: geom.point(F.lit(x), F.lit(y))
    ring = F.array(corner(2000.5, 1000.5), corner(5000.5, 1000.5), corner(5000.5, 9000.5), corner(2000.5, 9000.5), corner(2000.5, 1000.5))
    return pj.clip(fx.nodes(spark, d).withColumn("geometry", line), ring).select("node_id", F.round("clipped_length", 6).alias("inside"))

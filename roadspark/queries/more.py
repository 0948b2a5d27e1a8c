"""Queries for single rules, context joins and shortest paths, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import expr, geom
from ..operators import aggregates as ag, charts, demand as dm, graph, prep, views
from .network import ARC, DIST, RULE, WITH, _square

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


@query(f"select u, v, k from fx_clean where {RULE} = 'reallocatable'")
def flt_reallocatable(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "a long, b long")
    return views.reallocatable(prep.tag_reallocatable(fx.clean_arcs(spark, d), none)).select(*ARC)


@query("""select u, v, k, 'list' as kind from fx_arcs join fx_nodes a on u = a.node_id join fx_nodes b on v = b.node_id where a.region = 'ASIA' or b.region = 'ASIA'
 union all select u, v, k, 'text' from fx_arcs join fx_nodes a on u = a.node_id where a.region = 'ASIA'""")
def flt_of_place(spark, d):
    at = fx.nodes(spark, d).select("node_id", "region")
    a = fx.arcs(spark, d).join(at.toDF("u", "ru"), "u").join(at.toDF("v", "rv"), "v").withColumn("regions", F.array("ru", "rv"))
    by_list = views.of_place(a, "ASIA").select(*ARC, F.lit("list").alias("kind"))
    return by_list.unionByName(views.of_place(a, "ASIA", "ru").select(*ARC, F.lit("text").alias("kind")))


@query("select u, v, k, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as far from fx_arcs join fx_nodes a on u = a.node_id join fx_nodes b on v = b.node_id")
def prj_fill_geometry(spark, d):
    out = prep.fill_geometry(fx.arcs(spark, d), fx.nodes(spark, d))
    return out.select(*ARC, F.round(geom.line_length(F.col("geometry")), 6).alias("far"))


@query("select node_id, case when node_id % 2 = 0 then node_id * 1.5e0 end as given, 7.0e0 as otherwise from fx_nodes")
def prj_add_elevation(spark, d):
    n = fx.nodes(spark, d)
    table = n.where("node_id % 2 = 0").select("node_id", (F.col("node_id") * 1.5).alias("elevation"))
    given = prep.add_elevation(n, table).select("node_id", F.col("elevation").alias("given"))
    return given.join(prep.add_elevation(n, default=7.0).select("node_id", F.col("elevation").alias("otherwise")), "node_id")


@query("select u, v, k, case when highway = 'service' then true when lanes = 2 then false end as oneway from fx_arcs")
def prj_roundabouts(spark, d):
    a = fx.arcs(spark, d).withColumn("junction", F.when(F.col("highway") == "service", "roundabout")).withColumn("oneway", F.when(F.col("lanes") == 2, False))
    return prep.roundabouts_oneway(a).select(*ARC, "oneway")


@query("select u, v, k, case when u = 1 and v = 48 and k = 0 then 99 else lanes end as lanes, case when u = 1 and v = 48 and k = 1 then 'new' end as note, length as car_cost_current from fx_arcs")
def prj_set_attribute(spark, d):
    a = prep.set_attribute(fx.arcs(spark, d), (1, 48, 0), "lanes", 99)
    return prep.car_costs(prep.set_attribute(a, (1, 48, 1), "note", "new")).select(*ARC, "lanes", "note", "car_cost_current")


@query("""select (select count(*) filter (where elevation is null) from fx_nodes) as nodes_without_elevation, (select count(*) from fx_nodes) as nodes,
 count(*) filter (where a.elevation is null or b.elevation is null) as arcs_without_grade, cast(0 as bigint) as arcs_with_bad_grade, count(*) as arcs
 from fx_arcs left join fx_nodes a on u = a.node_id left join fx_nodes b on v = b.node_id""")
def agg_audit(spark, d):
    n = fx.nodes(spark, d)
    return prep.audit(n, prep.add_grades(fx.arcs(spark, d), n))


@query("select locality as name, max(cast(10 + node_id as double) * (10 + node_id)) as area from fx_nodes where node_id % 9 <> 0 group by locality")
def agg_largest_part(spark, d):
    ring = F.when(F.col("node_id") % 9 != 0, _square(F.col("x"), F.col("y"), F.lit(10.0) + F.col("node_id")))
    own = prep.largest_part(fx.nodes(spark, d).select(F.col("locality").alias("name"), "region", ring.alias("ring")))
    return own.select("name", F.round(geom.area(F.col("ring")), 3).alias("area"))


@query("select node_id, case when node_id % 4 <> 0 then round((node_id % 4) / 2500.0e0, 9) end as density from fx_nodes")
def pl_density(spark, d):
    own = fx.nodes(spark, d).select("node_id", (F.col("node_id") % 4).alias("people"), _square(F.col("x"), F.col("y"), 50.0).alias("ring"))
    return charts.density(own, "people").select("node_id", F.round("density", 9).alias("density"))


@query("select x + 20.0e0 as x, y + 20.0e0 as y, 'residential' as dest_type, locality, region from fx_nodes")
def jn_residential_destinations(spark, d):
    own = fx.nodes(spark, d).select("locality", "region", _square(F.col("x"), F.col("y"), 40.0).alias("ring"))
    out = dm.residential_destinations(own)
    return out.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


#: Sixteen square areas that cover the plane of the nodes, borders off the whole numbers.
AREAS = "areas as (select i * 4 + j as n, printf('area %02d', i * 4 + j) as name, i * 2600.0e0 - 100.5e0 as x0, j * 2600.0e0 - 100.5e0 as y0 from (select unnest(range(0, 4)) as i) a, (select unnest(range(0, 4)) as j) b)"


def _areas(spark):
    ij = spark.range(16).select(F.col("id").alias("n"), F.format_string("area %02d", "id").alias("name"), (F.floor(F.col("id") / 4) * 2600.0 - 100.5).alias("x0"), (F.col("id") % 4 * 2600.0 - 100.5).alias("y0"))
    return ij.select("n", "name", F.lit("r").alias("region"), _square(F.col("x0"), F.col("y0"), 2600.0).alias("ring"))


MEETS = "x + 30 >= x0 and x <= x0 + 2600 and y >= y0 and y <= y0 + 2600"


@query(f""", {AREAS} select node_id, array_to_string(list(name order by name), ',') as every_one, min(name) as first_one from fx_nodes join areas on {MEETS} group by node_id""")
def jn_assign_context(spark, d):
    """The areas that a line of 30 units east of each node meets."""
    line = geom.straight(F.col("x"), F.col("y"), F.col("x") + 30, F.col("y"))
    items = fx.nodes(spark, d).select("node_id", line.alias("geometry"))
    every = prep.assign_context(items, _areas(spark), ["node_id"], "names", True).select("node_id", F.array_join("names", ",").alias("every_one"))
    first = prep.assign_context(items, _areas(spark), ["node_id"], "name", False).select("node_id", F.col("name").alias("first_one"))
    return every.join(first, "node_id")


@query(f""", {AREAS}, met as (select node_id, min(n) as n from fx_nodes join areas on x + 30 >= x0 and x <= x0 + 2600 and y + 30 >= y0 and y <= y0 + 2600 group by node_id),
 kept as (select node_id, n, 900.0e0 as area from met where n % 5 <> 0)
 select node_id as res_id, printf('area %02d', n) as locality, round(100.0e0 * n * area / sum(area) over (partition by n) / (select sum(100.0e0 * n) from (select distinct n from kept) k), 9) as prob from kept""")
def jn_attach_locality(spark, d):
    """Squares of 30 units with the first area that they meet; every fifth area has no population."""
    own = fx.nodes(spark, d).select(F.col("node_id").alias("res_id"), _square(F.col("x"), F.col("y"), 30.0).alias("ring"))
    people = _areas(spark).where("n % 5 <> 0").select(F.col("name").alias("locality"), (F.col("n") * 100).alias("population"))
    return dm.attach_locality(own, _areas(spark), people).select("res_id", "locality", F.round("prob", 9).alias("prob"))


@query("select node_id, x + 3 as x0, y - 4 as y0, x + 8 as x1, cast(x as varchar) || ',' || cast(y as varchar) || ' ' || cast(x + 5 as varchar) || ',' || cast(y as varchar) as shape from fx_nodes")
def geo_shifted(spark, d):
    line = geom.straight(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y"))
    moved = geom.shifted(line, F.lit(3.0), F.lit(-4.0))
    return fx.nodes(spark, d).select("node_id", moved[0]["x"].alias("x0"), moved[0]["y"].alias("y0"), moved[1]["x"].alias("x1"), geom.shape_text(line).alias("shape"))


@query("select u, v, k, highway in ('service', 'primary', 'secondary') as flag from fx_arcs")
def prj_as_bool(spark, d):
    said = F.when(F.col("highway") == "service", " Yes").when(F.col("highway") == "primary", "TRUE").when(F.col("highway") == "secondary", "1").when(F.col("highway") == "residential", "no")
    return fx.arcs(spark, d).select(*ARC, expr.as_bool(said).alias("flag"))


@query("select 0.0e0 as mean_relative_error, 1.0e0 as spearman, count(*) as n from fx_arcs")
def agg_rank_accuracy(spark, d):
    own = fx.arcs(spark, d).withColumn("betweenness", F.col("length"))
    return ag.rank_accuracy(own, own).select("mean_relative_error", F.round("spearman", 9).alias("spearman")).crossJoin(own.agg(F.count(F.lit(1)).alias("n")))  # one row each


WALK = f"""with {DIST}, prev as (select a.src, h.v as node, min(h.u) as prev from dist a join hops h on a.node = h.u join dist b on b.src = a.src and b.node = h.v
  where a.cost + h.w = b.cost and h.v <> a.src group by a.src, h.v),
 walk(o, d, w, u, v) as (select o, d, w, prev, d from fx_od join prev on o = src and d = node union all select o, d, w, p.prev, walk.u from walk join prev p on o = p.src and walk.u = p.node)"""


@query("""\n, best as (select u, v, arg_min(k, (length, k)) as k from fx_clean where car_allowed group by u, v)
 select walk.u, walk.v, k, sum(w) as importance from walk join best on walk.u = best.u and walk.v = best.v group by walk.u, walk.v, k""", WALK)
def gr_edge_importance(spark, d):
    net = views.drive(fx.clean_arcs(spark, d))
    return graph.edge_importance(net, graph.od_paths(net, fx.od(spark, d)))


@query("\n select o, d, w, cast(count(*) as int) as hops, cost from walk join dist on o = src and d = node group by o, d, w, cost", WALK)
def gr_path_costs(spark, d):
    """Hops and cost of the shortest path of each pair, added up along it."""
    net = views.drive(fx.clean_arcs(spark, d))
    return graph.path_cost(net, graph.od_paths(net, fx.od(spark, d)), "length")

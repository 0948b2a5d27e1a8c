"""Queries over the network: views, cleaning, aggregation, graph fixpoints, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import expr, geom
from ..operators import aggregates as ag, charts, graph, prep, segments as seg, views
from ..operators.evaluate import connectedness

QUERIES: dict = {}
SQL: dict[str, str] = {}

WITH = f"with fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}), fx_od as ({fx.OD}), fx_nodes as ({fx.NODES}), fx_time as ({fx.TIMELINE})\n"


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL if that can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return put


ARC = ("u", "v", "k")


@query("select u, v, k, length from fx_clean where car_allowed")
def flt_drive(spark: SparkSession, d: str) -> DataFrame:
    return views.drive(fx.clean_arcs(spark, d)).select(*ARC, "length")


@query("select u, v, k, length from fx_clean where bike_allowed")
def flt_bikeable(spark, d):
    return views.bikeable(fx.clean_arcs(spark, d)).select(*ARC, "length")


@query("select u, v, k, length from fx_clean where safety in ('very_safe', 'safe')")
def flt_protected(spark, d):
    return views.protected(fx.clean_arcs(spark, d)).select(*ARC, "length")


@query("select u, v, k, length from fx_clean where car_allowed or safety in ('very_safe', 'safe')")
def flt_plotting(spark, d):
    return views.plotting(fx.clean_arcs(spark, d)).select(*ARC, "length")


@query("select u, v, k, length from fx_clean where highway = 'primary'")
def flt_road_type(spark, d):
    return views.of_road_type(fx.clean_arcs(spark, d), "primary").select(*ARC, "length")


@query("select distinct n as node from (select u as n from fx_clean where highway = 'cycleway' union all select v from fx_clean where highway = 'cycleway') t")
def flt_nodes_of_view(spark, d):
    return views.nodes_of(views.protected(fx.clean_arcs(spark, d)))


@query("""select u, v, k, length from fx_clean where u in (select node_id from fx_nodes where region = 'ASIA')
  and v in (select node_id from fx_nodes where region = 'ASIA')""")
def flt_induced_region(spark, d):
    inside = fx.nodes(spark, d).where("region = 'ASIA'").select(F.col("node_id").alias("node"))
    return views.induced(fx.clean_arcs(spark, d), inside).select(*ARC, "length")


def _raw(spark, d):
    """Arcs with raw tag lists made from neighbouring columns."""
    a = fx.arcs(spark, d)
    link = F.when(F.col("lanes") == 2, F.concat("highway", F.lit("_link"))).otherwise(F.col("highway"))
    return a.withColumn("cycleway", F.when(F.col("lanes") == 3, F.array(F.lit("lane"), F.lit("no"))).when((F.col("lanes") == 2) & (F.col("k") == 0), F.array(F.lit("shared_lane")))).withColumn(
        "bicycle", F.when(F.col("length") > 800, F.array(F.lit("designated"), F.lit("yes")))
    ).withColumn("highway", F.when(F.col("lanes") == 1, F.array(F.lit("footway"), link)).otherwise(F.array(link)))


TAGS = """tags as (select u, v, k, length, lanes,
  case when lanes = 2 and highway in ('primary', 'secondary', 'tertiary') then highway
       when lanes = 2 then highway || '_link' else highway end as highway,
  case when lanes = 3 then 'lane' when lanes = 2 and k = 0 then 'shared_lane' end as cycleway,
  case when length > 800 then 'designated' end as bicycle from fx_arcs)"""


@query(f", {TAGS} select u, v, k, highway, cycleway, bicycle from tags")
def prj_fold_tags(spark, d):
    return prep.fold_tags(_raw(spark, d)).select(*ARC, "highway", "cycleway", "bicycle")


CLASSES = TAGS + """, infra as (select *, case when cycleway = 'track' or highway = 'cycleway' or bicycle = 'designated' then 'cycle_track'
  when cycleway = 'lane' then 'bike_lane' when cycleway in ('shared', 'shared_lane') then 'mixed'
  when highway = 'residential' then 'mixed' else 'car' end as infra_type from tags),
 classes as (select *, case when infra_type = 'cycle_track' then 'very_safe' when infra_type = 'bike_lane' then 'safe'
  when infra_type = 'mixed' and highway = 'residential' then 'moderate'
  when highway in ('primary', 'secondary', 'trunk', 'tertiary') then 'dangerous'
  when highway in ('track', 'service', 'non_motorised') then 'moderate' else 'unclassified' end as safety from infra)"""
RISK = "case safety when 'very_safe' then 1.0e0 when 'safe' then 1.0e0 when 'moderate' then 1.5e0 else 2.0e0 end"


@query(f", {CLASSES} select u, v, k, infra_type, safety, {RISK} as risk_factor from classes")
def prj_safety(spark, d):
    return prep.classify_safety(prep.fold_tags(_raw(spark, d))).select(*ARC, "infra_type", "safety", "risk_factor")


@query(f""", {CLASSES}, priced as (select u, v, k, length * (case when (u + v) % 3 = 0 then 1.0e0 + 0.08e0 * 5.0e0
   when (u + v) % 3 = 1 then 1.0e0 / (1.0e0 + 0.03e0 * 10.0e0) else 1.0e0 + 0.08e0 * 20.0e0 end) as base, {RISK} as risk from classes)
 select u, v, k, round(base, 6) as bike_cost_base, round(base * risk, 6) as bike_cost_penalty from priced""")
def prj_bike_costs(spark, d):
    a = prep.classify_safety(prep.fold_tags(_raw(spark, d)))
    a = a.withColumn("grade", F.when((F.col("u") + F.col("v")) % 3 == 0, 0.05).when((F.col("u") + F.col("v")) % 3 == 1, -0.1))
    return prep.bike_costs(a).select(*ARC, F.round("bike_cost_base", 6).alias("bike_cost_base"), F.round("bike_cost_penalty", 6).alias("bike_cost_penalty"))


@query("""select u, v, k, case when car_allowed then lanes else 1 end as car_lanes, case when bike_allowed then lanes else 0 end as bike_lanes
  from fx_arcs""")
def prj_standard_lanes(spark, d):
    a = fx.arcs(spark, d).withColumn("lanes", F.array(F.col("lanes").cast("string")))
    return prep.standard_lanes(a).select(*ARC, "car_lanes", "bike_lanes")


@query("""select u, v, k, case lanes when 1 then 1 when 2 then 3 else 1 end as strict, case lanes when 1 then 3 when 2 then 3 else 1 end as lenient
  from fx_arcs""")
def prj_lane_parsers(spark, d):
    raw = F.when(F.col("lanes") == 1, F.array(F.lit("2;1"))).when(F.col("lanes") == 2, F.array(F.lit("2"), F.lit("1"))).otherwise(F.array(F.lit("x")))
    return fx.arcs(spark, d).select(*ARC, expr.clean_lanes(raw).cast("int").alias("strict"), expr.lane_count(raw).cast("int").alias("lenient"))


@query("""select node_id, 0.0e0 + coalesce(elevation, m) as elevation from fx_nodes left join (
   select n, median(elevation) as m from (select distinct u as n, v as o from fx_arcs union select distinct v, u from fx_arcs) p
   join fx_nodes on o = node_id where elevation is not null group by n) q on n = node_id""")
def gr_impute_elevation(spark, d):
    return graph.impute_by_neighbours(fx.nodes(spark, d), fx.arcs(spark, d), rounds=1).select("node_id", "elevation")


@query("""select a.u, a.v, a.k, round(greatest(-0.2, least(0.2, (m.elevation - n.elevation) / length)), 9) as grade
  from fx_arcs a left join fx_nodes n on a.u = n.node_id left join fx_nodes m on a.v = m.node_id""".replace("round(greatest(-0.2, least(0.2, (m.elevation - n.elevation) / length)), 9)", "case when m.elevation is not null and n.elevation is not null then round(greatest(cast(-0.2 as double), least(cast(0.2 as double), (m.elevation - n.elevation) / length)), 9) end"))
def prj_grades(spark, d):
    return prep.add_grades(fx.arcs(spark, d), fx.nodes(spark, d)).select(*ARC, F.round("grade", 9).alias("grade"))


@query("""select coalesce(b.u, a.u) as u, coalesce(b.v, a.v) as v, coalesce(b.k, a.k) as k, coalesce(b.highway, a.highway) as highway,
   a.u is not null as car_allowed, b.u is not null as bike_allowed
 from (select * from fx_arcs where car_allowed) a full outer join (select * from fx_arcs where bike_allowed) b on a.u = b.u and a.v = b.v and a.k = b.k""")
def jn_merge_modes(spark, d):
    a = fx.arcs(spark, d)
    bare = lambda df: df.drop("car_allowed", "bike_allowed")
    return prep.merge_modes(bare(views.drive(a)), bare(views.bikeable(a))).select(*ARC, "highway", "car_allowed", "bike_allowed")


@query("""select u, v, k, car_allowed, bike_allowed from fx_arcs union all
 select v, u, k, false, bike_allowed from fx_arcs a where not exists (select 1 from fx_arcs b where b.u = a.v and b.v = a.u)""")
def jn_ensure_reverse(spark, d):
    return prep.ensure_reverse(fx.arcs(spark, d)).select(*ARC, "car_allowed", "bike_allowed")


RULE = "case when infra_type in ('cycle_track', 'bike_lane') then 'existing_bike_infra' when not car_allowed then 'no_car_allowed' else 'reallocatable' end"


@query(f"select u, v, k, {RULE} as rule, {RULE} = 'reallocatable' as reallocatable from fx_clean")
def re_tag_reallocatable(spark, d):
    none = spark.createDataFrame([], "a long, b long")
    return prep.tag_reallocatable(fx.clean_arcs(spark, d), none).select(*ARC, "rule", "reallocatable")


@query(f"select coalesce({RULE}, 'total') as rule, count(*) as n from fx_clean group by rollup ({RULE})")
def agg_rule_counts(spark, d):
    none = spark.createDataFrame([], "a long, b long")
    return prep.rule_counts(prep.tag_reallocatable(fx.clean_arcs(spark, d), none))


@query("""select u, v, avg(length) as length, bool_or(car_allowed) as car_allowed, bool_or(bike_allowed) as bike_allowed,
  arg_min(infra_type, k) as infra_type from fx_clean group by u, v""")
def agg_merge_parallel(spark, d):
    return ag.merge_parallel(fx.clean_arcs(spark, d)).select("u", "v", "length", "car_allowed", "bike_allowed", "infra_type")


@query("""select least(u, v) as a, greatest(u, v) as b, k, max(length) as length, count(*) as n_arcs, bool_or(car_allowed) as car_allowed
  from fx_clean group by least(u, v), greatest(u, v), k""")
def agg_segment_graph(spark, d):
    s = ag.segment_graph(fx.clean_arcs(spark, d))
    return s.select(F.col("seg.u").alias("a"), F.col("seg.v").alias("b"), F.col("seg.k").alias("k"), "length", "n_arcs", "car_allowed")


@query("""select 'highway' as attribute, highway as value, count(*) as n from fx_arcs group by highway union all
 select 'lanes', cast(lanes as varchar), count(*) from fx_arcs group by lanes""")
def agg_road_types(spark, d):
    return ag.road_type_summary(fx.arcs(spark, d), ["highway", "lanes"])


PAIRS = "pairs as (select u, v, count(*) as n from fx_arcs group by u, v)"


@query(f", {PAIRS} select count(*) as pairs, count(*) filter (where n > 1) as parallel_pairs, cast(sum(n - 1) as bigint) as extra_arcs, max(n) as most from pairs")
def agg_parallel_summary(spark, d):
    return ag.parallel_summary(fx.arcs(spark, d))


@query(f", {PAIRS} select n, count(*) as pairs from pairs group by n")
def agg_parallel_distribution(spark, d):
    return ag.parallel_distribution(fx.arcs(spark, d))


@query(f", {PAIRS} select * from pairs where n > 1 order by n desc, u, v limit 10")
def top_parallel_pairs(spark, d):
    return ag.parallel_top(fx.arcs(spark, d))


@query("select u, v, k, cast(count(*) over (partition by u, v) as int) as parallel_count from fx_arcs")
def gr_parallel_count(spark, d):
    return ag.with_parallel_count(fx.arcs(spark, d)).select(*ARC, "parallel_count")


@query("""select category, cast(sum(n) as bigint) as n from (select case when count(distinct highway) > 1 then 'highway' else 'same' end as category,
   count(*) as n from fx_arcs group by u, v having count(*) > 1) t group by category""")
def agg_parallel_differences(spark, d):
    return ag.parallel_differences(fx.arcs(spark, d).withColumn("cycleway", F.lit(None).cast("string")))


@query("""select bin, lo + w * (bin - 1) as low, lo + w * bin as high, count(*) as n from (
   select lo, (hi - lo) / 9 as w, cast(least(9, floor((length - lo) / ((hi - lo) / 9)) + 1) as int) as bin from fx_arcs, (select min(length) as lo, max(length) as hi from fx_arcs) e) t
  group by bin, lo, w""".replace("lo + w * (bin - 1) as low, lo + w * bin as high", "round(lo + w * (bin - 1), 6) as low, round(lo + w * bin, 6) as high"))
def agg_histogram(spark, d):
    return ag.histogram(fx.arcs(spark, d), "length", 9).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


# -- graph fixpoints -----------------------------------------------------------------------------------------------

HOPS = "hops as (select u, v, min(length) as w from fx_clean where car_allowed group by u, v)"
DIST = f"""recursive fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}), fx_od as ({fx.OD}), fx_nodes as ({fx.NODES}), {HOPS},
 dist(src, node, cost) using key (src, node) as (
  select distinct o, o, 0.0e0 from fx_od union
  select d.src, h.v, min(d.cost + h.w) from dist d join hops h on d.node = h.u left join recurring.dist r on r.src = d.src and r.node = h.v
  where r.cost is null or d.cost + h.w < r.cost group by d.src, h.v)"""


@query()
def gr_od_costs(spark, d):
    return graph.od_costs(views.drive(fx.clean_arcs(spark, d)), fx.od(spark, d))


SQL["gr_od_costs"] = f"with {DIST} select o, d, cost from fx_od join dist on o = src and d = node"


@query()
def gr_strong_components(spark, d):
    return graph.strong_components(views.protected(fx.clean_arcs(spark, d)))


REACH = f"""recursive fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}),
 e as (select distinct u, v from fx_clean where safety in ('very_safe', 'safe')), n as (select u as x from e union select v from e),
 reach(a, b) as (select x, x from n union select a, v from reach join e on b = u)"""
SQL["gr_strong_components"] = f"with {REACH} select f.a as node, max(f.b) as component from reach f join reach g on f.a = g.b and f.b = g.a group by f.a"


@query()
def gr_reachable(spark, d):
    start = spark.createDataFrame([(1,), (2,)], "node long")
    net = views.protected(fx.clean_arcs(spark, d))
    return graph.reachable(net, start.join(views.nodes_of(net), "node", "left_semi"))


SQL["gr_reachable"] = f"with {REACH} select distinct b as node from reach where a in (1, 2)"


@query()
def gr_weak_components(spark, d):
    return graph.weak_components(views.protected(fx.clean_arcs(spark, d)))


SQL["gr_weak_components"] = f"""with recursive fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}),
 p as (select distinct u, v from fx_clean where safety in ('very_safe', 'safe')), e as (select u, v from p union select v, u from p),
 n as (select distinct u as x from e), reach(a, b) as (select x, x from n union select a, v from reach join e on b = u)
 select a as node, min(b) as component from reach group by a"""


@query()
def gr_bridges(spark, d):
    return graph.bridges(views.protected(fx.clean_arcs(spark, d)))


SQL["gr_bridges"] = f"""with recursive fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}),
 p as (select least(u, v) as a, greatest(u, v) as b, count(distinct k) as n from fx_clean where safety in ('very_safe', 'safe') group by 1, 2),
 e as (select a as x, b as y from p union all select b, a from p),
 walk(a, b, x) as (select a, b, a from p where n = 1 union select w.a, w.b, e.y from walk w join e on e.x = w.x and not (least(e.x, e.y) = w.a and greatest(e.x, e.y) = w.b))
 select a, b from p where n = 1 and not exists (select 1 from walk w where w.a = p.a and w.b = p.b and w.x = p.b)"""


@query()
def gr_edge_betweenness(spark, d):
    net = views.protected(fx.clean_arcs(spark, d))
    return graph.edge_betweenness(net, "length").withColumn("betweenness", F.round("betweenness", 9))


@query()
def gr_largest_component(spark, d):
    return graph.largest_strong_component(views.protected(fx.clean_arcs(spark, d)), True).select(*ARC)


SQL["gr_largest_component"] = f"""with {REACH}, comp as (select f.a as node, max(f.b) as c from reach f join reach g on f.a = g.b and f.b = g.a group by f.a),
 held as (select a.*, x.c from fx_clean a join comp x on u = x.node join comp y on v = y.node where x.c = y.c and safety in ('very_safe', 'safe'))
 select u, v, k from held where c = (select c from held group by c order by sum(length) desc, c limit 1)"""


@query()
def ev_connectedness(spark, d):
    return connectedness(views.protected(fx.clean_arcs(spark, d)), "protected").withColumn("protected_lcc_share", F.round("protected_lcc_share", 9))


SQL["ev_connectedness"] = f"""with {REACH}, comp as (select f.a as node, max(f.b) as c from reach f join reach g on f.a = g.b and f.b = g.a group by f.a),
 arcs as (select * from fx_clean where safety in ('very_safe', 'safe')),
 inner_ as (select x.c, sum(length) as s from arcs join comp x on u = x.node join comp y on v = y.node where x.c = y.c group by x.c)
 select (select count(distinct c) from comp) as protected_components, (select coalesce(max(s), 0) from inner_) as protected_lcc_length,
  round((select coalesce(max(s), 0) from inner_) / sum(length), 9) as protected_lcc_share, sum(length) as protected_total_length,
  count(*) as protected_arcs, (select count(*) from comp) as protected_nodes from arcs"""

# -- segments ------------------------------------------------------------------------------------------------------


def _stock(spark, d):
    none = spark.createDataFrame([], "a long, b long")
    a = prep.car_costs(prep.bike_costs(prep.tag_reallocatable(fx.clean_arcs(spark, d), none)))
    two = F.count(F.lit(1)).over(seg.Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), "k"))
    return seg.with_segments(a.withColumn("car_lanes", F.col("lanes")).withColumn("bike_lanes", F.lit(0)).withColumn("oneway", two < 2))


SEG = f"""segs as (select *, least(u, v) as a, greatest(u, v) as b, {RULE} = 'reallocatable' as re,
  count(*) over (partition by least(u, v), greatest(u, v), k) as dirs, row_number() over (partition by least(u, v), greatest(u, v), k order by u, v) as rn from fx_clean)"""


@query(f", {SEG} select a, b, k, lanes as lanes_total, re as reallocatable, highway from segs where rn = 1")
def seg_inventory(spark, d):
    return seg.inventory(_stock(spark, d)).select(F.col("seg.u").alias("a"), F.col("seg.v").alias("b"), F.col("seg.k").alias("k"), "lanes_total", "reallocatable", "highway")


@query(f""", {SEG}, one as (select a, b, k, min(case when rn = 1 then lanes end) as remaining, max(dirs) as dirs, count(*) filter (where highway <> 'cycleway') as ways,
   count(*) filter (where highway <> 'cycleway' and car_allowed) as cars from segs group by a, b, k),
 act as (select *, greatest(0, remaining - 1) as after from one where ways > 0)
 select a, b, k, remaining, after as remaining_after, dirs < 2 as oneway, cast(case when dirs < 2 then case when after <= 0 then cars else 0 end
   when after >= 2 then 0 when after = 0 then cars else null end as int) as lost from act""")
def seg_actions(spark, d):
    a = _stock(spark, d)
    acts = seg.actions(a, seg.inventory(a))
    lost = F.when(F.col("oneway") | (F.col("remaining_after") != 1), F.size("lost_car_arcs"))
    return acts.select(F.col("seg.u").alias("a"), F.col("seg.v").alias("b"), F.col("seg.k").alias("k"), "remaining", "remaining_after", "oneway", lost.alias("lost"))


@query()
def seg_apply_actions(spark, d):
    a = _stock(spark, d)
    stock = seg.inventory(a)
    acts = seg.actions(a, stock, seg.candidates(a))
    arcs, _, _ = seg.apply_action(a, stock, acts)
    return arcs.groupBy("highway", "infra_type", "car_allowed", "bike_allowed", "reallocatable").agg(F.count(F.lit(1)).alias("n"), F.sum("car_lanes").alias("car_lanes"))


@query("select u, v, k, case safety when 'very_safe' then 'magenta' when 'moderate' then 'orange' else 'darkred' end as colour, case when safety = 'very_safe' then 1.2e0 else 0.5e0 end as width from fx_clean")
def pl_arc_colours(spark, d):
    return charts.arc_colours(fx.clean_arcs(spark, d).withColumn("reallocatable", F.lit(True))).select(*ARC, "colour", "width")


# -- geometry ------------------------------------------------------------------------------------------------------


def _square(x, y, side):
    p = lambda dx, dy: geom.point(x + dx, y + dy)
    return F.array(p(0, 0), p(side, 0), p(side, side), p(0, side), p(0, 0))


@query("select node_id, 2500.0e0 as area, x + 25.0e0 as cx, y + 25.0e0 as cy, x as x0, y + 50.0e0 as y1 from fx_nodes")
def geo_measures(spark, d):
    n = fx.nodes(spark, d).withColumn("ring", _square(F.col("x"), F.col("y"), 50.0))
    c, b = geom.centroid(F.col("ring")), geom.bounds(F.col("ring"))
    return n.select("node_id", F.round(geom.area(F.col("ring")), 3).alias("area"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"), b["x0"].alias("x0"), b["y1"].alias("y1"))


BOXES = "boxes as (select node_id as box, x - 400 as x0, y - 400 as y0 from fx_nodes)"


@query(f", {BOXES} select node_id, cast(box as varchar) as name from fx_nodes, boxes where x > x0 and x < x0 + 1000 and y > y0 and y < y0 + 1000")
def jn_points_in_polygons(spark, d):
    from ..operators.demand import destinations_of

    n = fx.nodes(spark, d)
    boxes = n.select(F.col("node_id").cast("string").alias("name"), F.lit("r").alias("region"), _square(F.col("x") - 400, F.col("y") - 400, 1000.0).alias("ring"))
    points = n.select("node_id", "x", "y", F.lit(None).cast("string").alias("office"), F.lit(None).cast("string").alias("shop"), F.col("node_id").cast("string").alias("amenity"))
    return destinations_of(points, boxes, edges=False, keys=("node_id",)).select("node_id", F.col("locality").alias("name"))


@query("""select try as id, arg_min(node_id, (x - px) * (x - px) + (y - py) * (y - py)) as node from (
   select event_id as try, cast((event_id * 131) % 10007 as double) + 0.25 as px, cast((event_id * 977) % 10009 as double) + 0.25 as py from events) p, fx_nodes group by try""")
def jn_nearest_node(spark, d):
    from ..operators.demand import nearest_node

    fx.with_views(spark, d)
    points = spark.sql("select event_id as id, cast((event_id * 131) % 10007 as double) + 0.25 as x, cast((event_id * 977) % 10009 as double) + 0.25 as y from events")
    return nearest_node(points, fx.nodes(spark, d), ["id"])


@query("select o, d, w, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as far from fx_od join fx_nodes a on o = a.node_id join fx_nodes b on d = b.node_id")
def geo_od_lines(spark, d):
    from ..operators.demand import od_lines

    lines = od_lines(fx.od(spark, d), fx.nodes(spark, d))
    return lines.select("o", "d", "w", F.round(geom.line_length(F.col("line")), 6).alias("far"))


@query(""", sides as (select distinct a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from fx_clean join fx_nodes a on u = a.node_id join fx_nodes b on v = b.node_id where safety in ('very_safe', 'safe')),
 grid as (select *, (i + 0.5e0) * 50 - ax as px, (j + 0.5e0) * 50 - ay as py from sides, (select unnest(range(-5, 210)) as i) g, (select unnest(range(-5, 210)) as j) h),
 near as (select *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) as t from grid),
 area as (select distinct i, j from near where (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= 40000)
 select 2500.0e0 * count(*) as area_m2, 2500.0e0 * count(*) / 1e6 as area_km2 from area""")
def geo_coverage(spark, d):
    from ..operators.evaluate import coverage

    return coverage(views.protected(fx.clean_arcs(spark, d)), fx.nodes(spark, d), 200.0, 50.0)

"""Queries over demand: matrices, costs, generation, evaluation, optimisation, projection, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, fixtures as fx
from ..functions import geom
from ..operators import aggregates as ag, charts, demand as dm, evaluate as ev, graph, heuristics as he, prep, segments as seg, views
from ..plans import optimise as opt, project as pj
from ..state import bounded, cut, stored
from .network import DIST, WITH, _square, _stock

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


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(values {text}) t({names})"


# -- demand tables -------------------------------------------------------------------------------------------------

AT = "join fx_nodes a on o = a.node_id join fx_nodes b on d = b.node_id"


@query(f"""select p.region as origin, q.region as destination, coalesce(flow, 0) as flow from (select distinct region from fx_nodes) p
  cross join (select distinct region from fx_nodes) q left join (select a.region as x, b.region as y, sum(w) as flow from fx_od {AT} group by 1, 2) f
  on p.region = x and q.region = y""")
def agg_region_matrix(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    labels = [r["region"] for r in nodes.select("region").distinct().collect()]  # five regions
    return ag.od_matrix(fx.od(spark, d), nodes, "region", (), labels)


@query(f""", flows as (select a.locality as origin, b.locality as destination, sum(w) as flow from fx_od {AT} group by 1, 2),
 names as (select origin as n from flows union select destination from flows)
 select p.n as origin, q.n as destination, coalesce(flow, 0) as flow from names p cross join names q left join flows on p.n = origin and q.n = destination""")
def agg_locality_matrix(spark, d):
    return ag.od_matrix(fx.od(spark, d), fx.nodes(spark, d), "locality")


@query(f""", flows as (select begin, "end", a.region as origin, b.region as destination, sum(w) as flow from fx_time {AT} group by 1, 2, 3, 4),
 names as (select origin as n from flows union select destination from flows), hours as (select distinct begin, "end" from flows)
 select h.begin, h."end", p.n as origin, q.n as destination, coalesce(flow, 0) as flow from hours h cross join names p cross join names q
 left join flows f on h.begin = f.begin and p.n = origin and q.n = destination""")
def agg_hourly_matrices(spark, d):
    return ag.od_matrix(fx.timeline(spark, d), fx.nodes(spark, d), "region", ("begin", "end"))


@query("select o, d, sum(w) as w from fx_time group by o, d")
def agg_timeline_total(spark, d):
    return ag.timeline_total(fx.timeline(spark, d))


@query("select o, d, sum(w) as w from (select * from fx_od union all select * from fx_od) t group by o, d")
def agg_to_od(spark, d):
    own = fx.od(spark, d)
    return ag.to_od(own.unionByName(own).select(F.struct("o", "d").alias("od"), "w"))


@query(f""", flows as (select a.region as origin, b.region as destination, sum(w) as flow from fx_od {AT} group by 1, 2)
 select origin, destination, round(flow / sum(flow) over (partition by origin), 9) as flow from flows""")
def agg_row_shares(spark, d):
    m = ag.od_matrix(fx.od(spark, d), fx.nodes(spark, d)).where("flow > 0")
    return ag.row_shares(m).withColumn("flow", F.round("flow", 9))


@query("select o, d, round(w * (select count(*) filter (where w > 0) / sum(case when w > 0 then w end) from fx_od), 9) as w from fx_od")
def agg_normalise_weights(spark, d):
    return ag.normalise_weights(fx.od(spark, d)).withColumn("w", F.round("w", 9))


PURPOSES = _values([(r, p, n) for r, own in dims.PURPOSE_COUNTS.items() for p, n in zip(dims.PURPOSES, own)], "region, purpose, trips")
REGIONS = _values([(r, x, n) for r, own in dims.REGION_COUNTS.items() for x, n in zip(dims.REGIONS, own)], "origin, destination, trips")


@query(f"select region, purpose, round(trips / sum(trips) over (partition by region), 9) as share from {PURPOSES}", "")
def dem_purpose_shares(spark, d):
    return dm.purpose_shares(dims.purpose_counts(spark)).select("region", "purpose", F.round("share", 9).alias("share"))


@query(f"""select origin, destination, round(sum(trips) over (partition by origin order by destination) / sum(trips) over (partition by origin), 9) as hi from {REGIONS}""", "")
def dem_region_cdf(spark, d):
    return dm.cumulative(dims.region_counts(spark), "trips", ["origin"], ["destination"]).select("origin", "destination", F.round("hi", 9).alias("hi"))


LOCAL = _values([(x, r) for r, own in dims.LOCALITIES.items() for x in own], "locality, region")
PEOPLE = _values(list(dims.POPULATION.items()), "locality, population")


@query(f"select region, count(*) as localities, cast(sum(population) as bigint) as population from (select * from {LOCAL}) l left join (select * from {PEOPLE}) p using (locality) group by region", "")
def jn_locality_population(spark, d):
    met = dims.locality_regions(spark).join(dims.locality_populations(spark), "locality", "left")
    return met.groupBy("region").agg(F.count(F.lit(1)).alias("localities"), F.sum("population").alias("population"))


def _u(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296.0e0)"


@query(f""", idx as (select node_id, x, y, row_number() over (order by node_id % 1024, node_id) - 1 as i from fx_nodes), n as (select count(*) as c from fx_nodes),
 tries as (select unnest(range(0, 10000)) as t), picks as (select t, cast(floor({_u(12, "'o'", "cast(t as varchar)")} * c) as bigint) as a, cast(floor({_u(12, "'d'", "cast(t as varchar)")} * c) as bigint) as b from tries, n),
 kept as (select t, p.node_id as o, q.node_id as d from picks join idx p on a = p.i join idx q on b = q.i where p.node_id <> q.node_id
  and sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) >= 500 order by t limit 200)
 select o, d, cast(count(*) as double) as w from kept group by o, d""")
def dem_random_od(spark, d):
    return dm.random_od(fx.nodes(spark, d), 200)


@query(""", chain as (select node_id as o, coalesce(lead(node_id) over (order by node_id), (select min(node_id) from fx_nodes)) as d from fx_nodes)
 select o, d, w from fx_od union all select o, d, 0 from chain where not exists (select 1 from fx_od x where x.o = chain.o and x.d = chain.d)""")
def dem_auxiliary_chain(spark, d):
    return dm.auxiliary_chain(fx.od(spark, d), fx.nodes(spark, d))


def _homes(spark, d):
    """(residential, destinations, nodes): a square home at each node, and a destination beside it."""
    n = fx.nodes(spark, d)
    place = F.element_at(F.array(*(F.lit(r) for r in dims.REGIONS)), (F.col("node_id") % 5 + 1).cast("int"))
    homes = n.select(F.col("node_id").alias("res_id"), _square(F.col("x"), F.col("y"), 40.0).alias("ring"), place.alias("region"), F.lit(1.0).alias("prob"))
    kinds = [*dims.AMENITIES, "work", "shop", "residential", "other"]
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.floor(F.col("node_id") / 5) % len(kinds) + 1).cast("int"))
    there = n.select(F.col("node_id").alias("dest_id"), (F.col("x") + 5).alias("x"), (F.col("y") + 5).alias("y"), kind.alias("dest_type"), place.alias("region"))
    every = spark.createDataFrame([(k, r) for k in kinds for r in dims.REGIONS], "dest_type string, region string")
    more = every.select((F.lit(1_000_000) + F.xxhash64("dest_type", "region") % 100_000).alias("dest_id"), F.pmod(F.xxhash64("dest_type"), F.lit(10007)).cast("double").alias("x"), F.pmod(F.xxhash64("region"), F.lit(10009)).cast("double").alias("y"), "dest_type", "region")
    return homes, there.unionByName(more), n


@query()
def dem_home_based_tours(spark, d):
    homes, there, n = _homes(spark, d)
    draws = spark.range(300).withColumnRenamed("id", "tour")
    return dm.count_od(dm.tours(draws, homes, there, n))


@query()
def dem_hourly_timeline(spark, d):
    homes, there, n = _homes(spark, d)
    return dm.gen_timeline([0, 20, 40], n, homes, there)


@query()
def dem_mixed_trips(spark, d):
    homes, there, n = _homes(spark, d)
    return dm.gen_od(n, homes, there, 200, 0.25)


@query()
def dem_beta_sweep(spark, d):
    homes, there, n = _homes(spark, d)
    return dm.beta_sweep([0.0001, 0.001], 60, views.drive(fx.clean_arcs(spark, d)), homes, there, n).withColumn("avg_length", F.round("avg_length", 3)).withColumn("abs_error", F.round("abs_error", 3))


@query("select node_id as res_id, round(p / sum(p) over (), 9) as prob from (select node_id, (100.0e0 * (1 + node_id % 3)) / count(*) over (partition by region) as p from fx_nodes) t".replace("(100.0e0 * (1 + node_id % 3)) / count(*) over (partition by region)", "1000.0e0 * (1 + node_id % 3) * (1 + node_id % 3) / sum((1 + node_id % 3) * (1 + node_id % 3)) over (partition by region)"))
def dem_residential_probability(spark, d):
    own = fx.nodes(spark, d).select(F.col("node_id").alias("res_id"), F.col("region").alias("locality"), F.lit(1000).alias("population"), _square(F.col("x"), F.col("y"), 10.0 * (1 + F.col("node_id") % 3)).alias("ring"))
    return dm.residential_probability(own).select("res_id", F.round("prob", 9).alias("prob"))


# -- costs and evaluation ------------------------------------------------------------------------------------------


def _priced(spark, d):
    return prep.car_costs(prep.bike_costs(fx.clean_arcs(spark, d).withColumn("grade", F.lit(0.0))))


def _dist(hops: str) -> str:
    return DIST.replace("where car_allowed group by u, v", hops)


@query(f""", cost as (select o, d, w, cost from fx_od left join dist on o = src and d = node)
 select coalesce(sum(w * cost), 0) + 25000.0e0 * coalesce(sum(case when cost is null then w end), 0) as drive_total_cost, coalesce(sum(w * cost), 0) as drive_routed_cost,
  sum(w) as drive_weight, coalesce(sum(case when cost is not null then w end), 0) as drive_covered_weight, coalesce(sum(case when cost is null then w end), 0) as drive_missing_weight,
  count(cost) as drive_covered_pairs, count(*) - count(cost) as drive_missing_pairs from cost""", f"with {_dist(chr(119) + 'here highway in (' + chr(39) + 'cycleway' + chr(39) + ') group by u, v')}")
def ev_od_costs(spark, d):
    """Cost of all demand over the protected network, with the penalty for what it doesn't serve."""
    out = graph.priced_od(views.protected(fx.clean_arcs(spark, d)), fx.od(spark, d)).agg(*ev.totals("cost", "drive"))
    return out.drop("drive_mean_cost", "drive_mean_routed_cost")


@query(""", cost as (select o, d, w, cost from fx_od left join dist on o = src and d = node)
 select sum(w * cost) as total_length, sum(w) as total_weight, round(sum(w * cost) / sum(w), 6) as avg_length_all,
  round(sum(w * cost) / sum(case when cost is not null then w end), 6) as avg_length_routed from cost""", f"with {DIST}")
def agg_mean_path_length(spark, d):
    m = ag.mean_path_length(graph.priced_od(views.drive(fx.clean_arcs(spark, d)), fx.od(spark, d)))
    return m.withColumn("avg_length_all", F.round("avg_length_all", 6)).withColumn("avg_length_routed", F.round("avg_length_routed", 6))


@query("""select count(*) as protected_endpoints, count(*) filter (where n not in (select u from fx_clean where highway = 'cycleway' union select v from fx_clean where highway = 'cycleway')) as protected_missing_endpoints
 from (select o as n from fx_od union select d from fx_od) t""")
def ev_endpoints(spark, d):
    return ev.endpoint_stats(views.protected(fx.clean_arcs(spark, d)), fx.od(spark, d), "protected")


@query(""", bike as (select o, d, w, cost as b from fx_od join dist on o = src and d = node), car as (select o, d, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as c from fx_od join fx_nodes a on o = a.node_id join fx_nodes b on d = b.node_id)
 select round(sum(w * c / b) / sum(w), 9) as directness, count(*) as directness_pairs from bike join car using (o, d) where b > 0 and c > 0""", f"with {DIST}")
def ev_directness(spark, d):
    at = bounded(fx.nodes(spark, d).select("node_id", "x", "y"))
    far = geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    routed = graph.priced_od(views.drive(fx.clean_arcs(spark, d)), fx.od(spark, d)).where("cost is not null")
    met = routed.join(at.toDF("o", "ax", "ay"), "o").join(at.toDF("d", "bx", "by"), "d").withColumn("crow", far)
    return met.agg(*ev.ratios("cost", "crow")).withColumn("directness", F.round("directness", 9))


def _network_sql() -> str:
    """All metrics of a network state: the four runs in one recursion, both networks' components, areas by a raster."""
    nets = {"drive_length": ("car_allowed", "length"), "car": ("car_allowed", "length"), "bike_full": ("bike_allowed", "length * risk_factor"), "bike_protected": (PROTECTED, "length * risk_factor")}
    runs = " union all ".join(f"select '{n}' as run, u, v, {w} as w from fx_clean where {view}" for n, (view, w) in nets.items())
    parts = []
    for n in nets:
        own, add = f"from cost where run = '{n}'", lambda c: f"coalesce(sum({c}), 0)"
        routed, missing = add("w * cost"), add("case when cost is null then w end")
        covered = add("case when cost is not null then w end")
        parts += [f"(select {x} {own}) as {n}_{c}" for c, x in {
            "total_cost": f"round({routed} + 25000.0e0 * {missing}, 6)", "routed_cost": f"round({routed}, 6)", "weight": add("w"), "covered_weight": covered, "missing_weight": missing,
            "covered_pairs": "count(cost)", "missing_pairs": "count(*) - count(cost)", "mean_cost": f"round(({routed} + 25000.0e0 * {missing}) / sum(w), 6)", "mean_routed_cost": f"round({routed} / {covered}, 6)",
        }.items()]
    for prefix, net in (("protected", "bike_protected"), ("car_net", "drive_length")):
        parts += [f"(select {x} from struct_of where run = '{net}') as {prefix}_{c}" for c, x in {"components": "n", "lcc_length": "lcc", "lcc_share": "round(lcc / total, 6)", "total_length": "total", "arcs": "arcs", "nodes": "nodes"}.items()]
        parts += [f"(select round(10000.0e0 * count(*), 6) from area where run = '{net}') as {prefix}_coverage_area_m2", f"(select round(10000.0e0 * count(*) / 1e6, 6) from area where run = '{net}') as {prefix}_coverage_area_km2"]
    parts += [
        "(select round(sum(b.w * c.cost / b.cost) / sum(b.w), 6) from cost b join cost c using (o, d) where b.run = 'bike_full' and c.run = 'drive_length' and b.cost > 0 and c.cost > 0) as main_od_directness_weighted",
        "(select count(*) from cost b join cost c using (o, d) where b.run = 'bike_full' and c.run = 'drive_length' and b.cost > 0 and c.cost > 0) as main_od_directness_num_pairs",
        "(select round(sum(case when cost is not null then w end) / sum(w), 6) from cost where run = 'bike_protected') as main_od_protected_reachable_share",
        "(select sum(case when cost is not null then w end) from cost where run = 'bike_protected') as main_od_protected_reachable_demand",
        "(select sum(w) from cost where run = 'bike_protected') as main_od_total_demand",
        "(select count(distinct n) from ends) as protected_endpoints",
        "(select count(distinct n) from ends where n not in (select u from nets where run = 'bike_protected' union select v from nets where run = 'bike_protected')) as protected_missing_endpoints",
    ]
    return f"""with recursive fx_arcs as ({fx.ARCS}), fx_clean as ({fx.CLEAN}), fx_od as ({fx.OD}), fx_nodes as ({fx.NODES}),
 nets as ({runs}), hops as (select run, u, v, min(w) as w from nets group by run, u, v), ends as (select o as n from fx_od union select d from fx_od),
 dist(run, src, node, cost) using key (run, src, node) as (
  select distinct run, o, o, 0.0e0 from fx_od, (select distinct run from nets) union
  select d.run, d.src, h.v, min(d.cost + h.w) from dist d join hops h on d.node = h.u and d.run = h.run left join recurring.dist r on r.run = d.run and r.src = d.src and r.node = h.v
  where r.cost is null or d.cost + h.w < r.cost group by d.run, d.src, h.v),
 cost as (select runs.run, o, d, w, cost from fx_od cross join (select distinct run from nets) runs left join dist on dist.run = runs.run and o = src and d = node),
 places as (select run, u as x from nets union select run, v from nets), reach(run, a, b) as (select run, x, x from places union select r.run, a, v from reach r join hops h on b = u and r.run = h.run),
 comp as (select f.run, f.a as node, max(f.b) as c from reach f join reach g on f.run = g.run and f.a = g.b and f.b = g.a group by f.run, f.a),
 lengths as (select 'bike_protected' as run, u, v, length from fx_clean where {PROTECTED} union all select 'drive_length', u, v, length from fx_clean where car_allowed),
 inner_ as (select run, max(s) as lcc from (select l.run, sum(length) as s from lengths l join comp x on l.run = x.run and u = x.node join comp y on l.run = y.run and v = y.node where x.c = y.c group by l.run, x.c) t group by run),
 struct_of as (select l.run, (select count(distinct c) from comp where comp.run = l.run) as n, (select count(*) from comp where comp.run = l.run) as nodes,
  (select coalesce(max(lcc), 0) from inner_ where inner_.run = l.run) as lcc, sum(length) as total, count(*) as arcs from lengths l group by l.run),
 sides as (select distinct run, a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from lengths join fx_nodes a on u = a.node_id join fx_nodes b on v = b.node_id),
 grid as (select run, ax, ay, dx, dy, i, j, (i + 0.5e0) * 100 - ax as px, (j + 0.5e0) * 100 - ay as py from sides, (select unnest(range(-6, 110)) as i) g, (select unnest(range(-6, 110)) as j) h),
 near as (select *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) as t from grid), area as (select distinct run, i, j from near where (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= 250000)
 select {", ".join(parts)}"""


PROTECTED = "safety in ('very_safe', 'safe')"


@query()
def ev_network(spark, d):
    out = ev.evaluate(_priced(spark, d), fx.od(spark, d), nodes=fx.nodes(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


SQL["ev_network"] = _network_sql()


# -- choosing and optimising ---------------------------------------------------------------------------------------

SEGS = "segs as (select distinct least(u, v) as a, greatest(u, v) as b, k from fx_clean where highway <> 'cycleway')"


@query(f", {SEGS} select a, b, k, {_u(12, chr(39) + '7' + chr(39), 'cast(a as varchar)', 'cast(b as varchar)', 'cast(k as varchar)')} as score from segs")
def he_random_scores(spark, d):
    a = _stock(spark, d)
    ctx = he.Context(a, fx.nodes(spark, d), seg.actions(a, seg.inventory(a)), iteration=7)
    return he.random_choice(ctx).select(F.col("seg.u").alias("a"), F.col("seg.v").alias("b"), F.col("seg.k").alias("k"), "score")


@query()
def he_od_aware_choice(spark, d):
    a, od = stored(_stock(spark, d), "arcs"), stored(fx.od(spark, d), "od")
    bike, car = views.bikeable(a), views.drive(a)
    of = lambda net, w: cut(graph.od_importance(net, od, w))
    car_importance = of(car, "length")
    acts = stored(seg.actions(a, seg.inventory(a), None, "score", car_importance.withColumnRenamed("importance", "score")), "actions")
    ctx = he.Context(a, fx.nodes(spark, d), acts, of(bike, "bike_cost_penalty"), car_importance)
    return he.argmax(he.od_aware(ctx)).select("seg.*")


@query()
def he_largest_to_closest(spark, d):
    a = _stock(spark, d)
    found = he.largest_to_closest(he.Context(a, fx.nodes(spark, d), seg.actions(a, seg.inventory(a), seg.candidates(a))))
    kind = "u long, v long, k long"
    return found.select("seg.*") if found is not None else spark.createDataFrame([], kind)


@query()
def opt_random_run(spark, d):
    _, _, events = opt.optimise(_stock(spark, d).drop("seg"), fx.nodes(spark, d), fx.od(spark, d), "random", 4, 2, dry=True)
    return events.select("iteration", "event_type", "segment.*", "remaining_after", F.size("created_edges").alias("created"))


RUNS = "(values ('a', 0, 100.0e0, 50.0e0), ('a', 10, 99.9e0, 51.0e0), ('a', 20, 99.8e0, 52.0e0), ('a', 30, 90.0e0, 60.0e0), ('b', 0, 10.0e0, 5.0e0), ('b', 10, 9.0e0, 8.0e0)) t(heuristic, iteration, bike, car)"


@query(f"""with r as (select * from {RUNS}), w as (select *, first_value(bike) over p as b0, first_value(car) over p as c0, lag(bike) over p as prev from r window p as (partition by heuristic order by iteration)),
 f as (select *, case when prev is null then 0 when (prev - bike) / b0 < 0.005 then 1 else 0 end as weak from w), g as (select *, sum(1 - weak) over (partition by heuristic order by iteration) as island from f)
 select heuristic, iteration, bike, car, round((b0 - bike) / b0, 9) as bike_gain_vs_baseline, round((car - c0) / c0, 9) as car_harm_vs_baseline, cast(sum(weak) over (partition by heuristic, island order by iteration) as bigint) as streak from g""", "")
def win_progress(spark, d):
    rows = [("a", 0, 100.0, 50.0), ("a", 10, 99.9, 51.0), ("a", 20, 99.8, 52.0), ("a", 30, 90.0, 60.0), ("b", 0, 10.0, 5.0), ("b", 10, 9.0, 8.0)]
    out = opt.progress_table(spark.createDataFrame(rows, "heuristic string, iteration int, bike double, car double"), "bike", "car")
    return out.withColumn("bike_gain_vs_baseline", F.round("bike_gain_vs_baseline", 9)).withColumn("car_harm_vs_baseline", F.round("car_harm_vs_baseline", 9))


# -- projection ----------------------------------------------------------------------------------------------------


def _log(spark, d):
    """Every segment gives a lane in each of two iterations."""
    a = _stock(spark, d)
    s = a.where("highway <> 'cycleway'").select("seg").distinct()
    twice = s.select("seg", F.explode(F.array(F.lit(1), F.lit(2))).alias("iteration"))
    return a, pj.normalise_log(twice.select("iteration", F.lit("reallocated_segment").alias("event_type"), F.col("seg").alias("segment")))


@query("""\n, roads as (select *, least(u, v) as a, greatest(u, v) as b from fx_clean), plain as (select *, max(lanes) over (partition by a, b, k) as m from roads where highway <> 'cycleway'),
 ev as (select distinct a, b, k from plain), pairs as (select distinct ev.a, ev.b, ev.k, u, v from ev join roads r on ev.a = r.a and ev.b = r.b and ev.k = r.k),
 hits as (select p.a, p.b, p.k, 2 * count(distinct pairs.k) as h from plain p join pairs on p.u = pairs.u and p.v = pairs.v group by p.a, p.b, p.k)
 select u, v, k, cast(greatest(0, m - h) as int) as car_lanes, greatest(0, m - h) > 0 as car_allowed, case when m <= h then 'cycleway' else highway end as highway
 from plain join hits using (a, b, k)""")
def pj_project(spark, d):
    a, log = _log(spark, d)
    out = pj.project(a, a.drop("seg"), log)
    return out.where("cycleway is not null").select("u", "v", "k", "car_lanes", "car_allowed", "highway")


@query("""select cast(2 * count(*) as bigint) as events_seen, cast(2 * count(*) as bigint) as events_applied, count(*) as segments_touched, cast(0 as bigint) as missing_simplified, cast(0 as bigint) as missing_unsimplified
 from (select distinct least(u, v), greatest(u, v), k from fx_clean where highway <> 'cycleway') t""")
def pj_stats(spark, d):
    a, log = _log(spark, d)
    return pj.projection_stats(a, a.drop("seg"), log)


@query("""select a.u, a.v, a.k, status from (select u, v, k, 'initial' as status from fx_clean where highway = 'cycleway'
  union all select u, v, k, 'proposed' from fx_clean where highway = 'residential' and u % 2 = 0
  union all select u, v, k, 'newly_fixed' from fx_clean where highway = 'primary' and u % 2 = 0) a""")
def pj_network_diff(spark, d):
    before = fx.clean_arcs(spark, d).withColumn("reallocatable", F.lit(True))
    after = before.withColumn("safety", F.when((F.col("highway") == "residential") & (F.col("u") % 2 == 0), "safe").otherwise(F.col("safety"))).withColumn("reallocatable", ~((F.col("highway") == "primary") & (F.col("u") % 2 == 0)))
    return pj.network_diff(before, after)


@query("select cast(row_number() over (order by e) as int) as frame, cast(e as int) as events, cast(e as int) as iteration from (values (0), (3), (6), (8)) t(e)", "")
def pj_frames(spark, d):
    log = spark.range(1, 9).select(F.col("id").cast("int").alias("n"), F.col("id").cast("int").alias("iteration"))
    return pj.frames(log, 3)


@query("select beta, avg_length, abs_error, abs_error = min(abs_error) over () as is_best, (select arg_min(beta, abs_error) in (1.0, 3.0) from (values (1.0e0, 40.0e0), (2.0e0, 10.0e0), (3.0e0, 30.0e0)) t(beta, abs_error)) as at_edge from (values (1.0e0, 6140.0e0, 40.0e0), (2.0e0, 6110.0e0, 10.0e0), (3.0e0, 6070.0e0, 30.0e0)) t(beta, avg_length, abs_error)", "")
def pl_calibration_curve(spark, d):
    return charts.calibration_curve(spark.createDataFrame([(1.0, 6140.0, 40.0), (2.0, 6110.0, 10.0), (3.0, 6070.0, 30.0)], "beta double, avg_length double, abs_error double"))


@query(f"""select region as origin, region as destination, 0.0e0 as error from (select distinct region from fx_nodes) t""")
def pl_matrix_error(spark, d):
    m = ag.od_matrix(fx.od(spark, d), fx.nodes(spark, d))
    return charts.matrix_error(m, m).where("origin = destination")


# -- streams -------------------------------------------------------------------------------------------------------


@query("""select cast(date_trunc('hour', ts) as timestamp) as begin, user_id % 10 as o, user_id % 7 as d, cast(count(*) as double) as w from events group by 1, 2, 3""", "")
def str_hourly_demand(spark, d):
    """The hourly demand of the events as a stream that is read to its end."""
    from ..state import cut
    from ..streaming.od import hourly_demand

    kind = spark.read.parquet(f"{d}/events.parquet").schema
    trips = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")  # the table is a file or a folder
    name = f"hourly_{uuid.uuid4().hex}"
    out = hourly_demand(trips.selectExpr("cast(ts as timestamp) as ts", "user_id % 10 as o", "user_id % 7 as d"), "30 days")
    run = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return cut(spark.table(name).selectExpr("cast(begin as timestamp_ntz) as begin", "o", "d", "w"))




# -- more of demand and charts -------------------------------------------------------------------------------------

KINDS = ", ".join(f"'{a}'" for a in dims.AMENITIES)


@query(f"""select node_id, case when node_id % 5 = 0 then 'work' when node_id % 5 = 1 then 'shop' when a in ({KINDS}) then a else 'other' end as dest_type
  from (select node_id, case node_id % 3 when 0 then 'bank' when 1 then 'parking' else 'school' end as a from fx_nodes) t""")
def prj_destination_type(spark, d):
    from ..functions.expr import destination_type

    n = fx.nodes(spark, d)
    office, shop = F.when(F.col("node_id") % 5 == 0, "yes"), F.when(F.col("node_id") % 5 == 1, "yes")
    amenity = F.when(F.col("node_id") % 3 == 0, "bank").when(F.col("node_id") % 3 == 1, "parking").otherwise("school")
    return n.select("node_id", destination_type(office, shop, amenity).alias("dest_type"))


@query("select o, d, sum(w) as w from (select o, d, w from fx_od union all select o, d, -w from fx_od where w < 2 union all select d, o, w from fx_od) t group by o, d having sum(w) > 0")
def set_add_demand(spark, d):
    od = fx.od(spark, d)
    return dm.add_od(od, od.where("w < 2").select("o", "d", (-F.col("w")).alias("w")), od.select(F.col("d").alias("o"), F.col("o").alias("d"), "w"))


@query(f""", total as (select o, d, sum(w) as w from fx_time group by o, d), flows as (select a.region as origin, b.region as destination, sum(w) as flow from total {AT} group by 1, 2),
 names as (select origin as n from flows union select destination from flows)
 select p.n as origin, q.n as destination, coalesce(flow, 0) as flow from names p cross join names q left join flows on p.n = origin and q.n = destination""")
def agg_total_matrix(spark, d):
    return ag.total_matrix(fx.timeline(spark, d), fx.nodes(spark, d))


@query(f"""select f.o, f.d, f.w, m.region as origin, n.region as destination from fx_od f left join fx_nodes m on o = m.node_id left join fx_nodes n on d = n.node_id""")
def jn_od_regions(spark, d):
    at = fx.nodes(spark, d).select("node_id", "region")
    return fx.od(spark, d).join(at.toDF("o", "origin"), "o", "left").join(at.toDF("d", "destination"), "d", "left").select("o", "d", "w", "origin", "destination")


@query("select * from (values (2.0e0, 10.0e0)) t(beta, abs_error)", "")
def agg_best_beta(spark, d):
    return ag.best_by_error(spark.createDataFrame([(1.0, 40.0), (3.0, 10.0), (2.0, 10.0)], "beta double, abs_error double"))


@query("""select l_returnflag as scenario, l_orderkey as time, case when l_quantity * 2 >= 10 then l_quantity * 2 end as value from lineitem""", "")
def pl_compare_runs(spark, d):
    """The runs are the return flags of the table; the last one has no such metric."""
    own = spark.read.parquet(f"{d}/lineitem.parquet")
    runs = {f: own.where(F.col("l_returnflag") == f) for f in sorted(r[0] for r in own.select("l_returnflag").distinct().collect())}  # three flags
    return charts.compare_runs(runs | {"none": own.select("l_orderkey")}, "l_quantity", 2.0, 10.0, "l_orderkey")


@query("select model, iteration, value from (select l_returnflag as model, l_orderkey as iteration, l_tax * 100 as value, dense_rank() over (order by l_returnflag) as r from lineitem) t where r <= 2", "")
def pl_metric_series(spark, d):
    own = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_orderkey").alias("iteration"), "l_tax")
    return charts.metric_series(own, "l_tax", "l_returnflag", 100.0, 2)


@query("select region, purpose, dest_type from (select r_name as region from region) a, (values ('bank'), ('shop'), ('other')) t(dest_type), (values ('shopping'), ('other'), ('escort_other'), ('personal_errands')) p(purpose) where purpose = 'escort_other' or (purpose = 'shopping' and dest_type = 'shop') or (purpose = 'other' and dest_type = 'other') or (purpose = 'personal_errands' and dest_type = 'bank')", "")
def flt_destinations(spark, d):
    there = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("region")).crossJoin(spark.createDataFrame([("bank",), ("shop",), ("other",)], "dest_type string"))
    types = dims.purpose_types(spark).where("purpose in ('shopping', 'other', 'escort_other', 'personal_errands')")
    return dm.fitting(there, types).select("region", "purpose", "dest_type")


@query(f""", flows as (select replace(a.locality, ' ', '_') as origin, replace(b.locality, ' ', '_') as destination, sum(w) as flow from fx_od {AT} group by 1, 2),
 names as (select origin as n from flows union select destination from flows)
 select p.n as origin, q.n as destination, coalesce(flow, 0) as flow from names p cross join names q left join flows on p.n = origin and q.n = destination""")
def agg_safe_matrix(spark, d):
    return ag.safe_matrix(ag.od_matrix(fx.od(spark, d), fx.nodes(spark, d), "locality"))


@query()
def prj_clean_simplified(spark, d):
    """The whole cleaning of a network of raw tags."""
    from .network import _raw

    raw = _raw(spark, d).withColumn("lanes", F.array(F.col("lanes").cast("string"))).withColumn("junction", F.lit(None).cast("string"))
    n = fx.nodes(spark, d)
    arcs, _ = prep.clean_simplified(raw, n, n.select("node_id", "elevation"))
    return arcs.select("u", "v", "k", "highway", "car_lanes", "bike_lanes", "safety", "rule", F.round("bike_cost_penalty", 6).alias("bike_cost_penalty"))

"""Scalar rules, geometry, segments, the optimiser, projection and files on hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from roadspark import dims
from roadspark.functions import expr, geom
from roadspark.operators import charts, demand as dm, evaluate as ev, prep, segments as seg
from roadspark.plans import optimise as opt, project as pj
from roadspark.sources import simio


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lanes_and_labels(spark):
    a = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.lit(None).cast("array<string>")
    r = one(spark, expr.clean_lanes(a("2", "1")), expr.clean_lanes(a("2;1")), expr.clean_lanes(a()), expr.lane_count(a("2;1")), expr.lane_count(a("x")), expr.lane_count(a("0", "y")), expr.lane_count(a("2.9")), expr.lane_count(a(), 4))
    assert tuple(r) == (3, 1, None, 3, 1, 1, 2, 4)
    p = expr.HIGHWAY_PRIORITY
    r = one(spark, expr.primary_label(a("service", "primary", "zzz"), p), expr.primary_label(a("zzz", "yyy"), p), expr.primary_label(a(), p), expr.primary_label_of_known(a("", "nan", "residential"), p))
    assert tuple(r) == ("primary", "zzz", None, "residential")
    r = one(spark, expr.as_bool(F.lit(" YES ")), expr.as_bool(F.lit(None)), expr.hex_to_rgb(F.lit("#ff8000")), expr.normalise_safety(F.lit("PROTECTED")), expr.safe_div(F.lit(1.0), F.lit(0.0)))
    assert tuple(r) == (True, False, "255,128,0", "very_safe", 0.0)


def test_safety_gap_and_costs(spark):
    L = F.lit
    infra = expr.infra_type(L("primary"), L(None), L("shared_lane"))
    r = one(spark, infra, expr.safety_class(infra, L("primary")), expr.safety_class(L("mixed"), L("busway")), expr.bike_cost_base(L(100.0), L(0.05)), expr.bike_cost_base(L(100.0), L(-0.1)), expr.bike_cost_base(L(100.0), L(None).cast("double")))
    assert r[:3] == ("mixed", "dangerous", "unclassified")
    assert r[3:] == pytest.approx((140.0, 100 / 1.3, 260.0))


def test_safe_id(spark):
    got = [r[0] for r in spark.createDataFrame([("Ħal Għaxaq",), ("Ta' Xbiex",), ("Iż-Żejtun",), (None,)], "n string").select(expr.safe_id(F.col("n"))).collect()]
    assert got == ["al_Gaxaq", "Ta_Xbiex", "IzZejtun", None]


def ring(*points):
    return F.array(*(geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_geometry(spark):
    tri = ring((0, 0), (4, 0), (0, 3), (0, 0))
    line = ring((-1, 1), (5, 1))
    c = geom.centroid(tri)
    r = one(spark, geom.area(tri), c["x"], c["y"], geom.contains(tri, F.lit(1.0), F.lit(1.0)), geom.contains(tri, F.lit(3.0), F.lit(3.0)), geom.meets_polygon(line, tri), geom.clipped_length(line, tri), geom.line_distance(F.lit(5.0), F.lit(0.0), tri), geom.canonical(line) == geom.canonical(F.reverse(line)))
    assert r[:1] == (6.0,) and r[1:3] == pytest.approx((4 / 3, 1.0)) and r[3:6] == (True, False, True)
    assert r[6] == pytest.approx(4 - 4 / 3) and r[7] == 1.0 and r[8]


def test_coverage_of_a_capsule(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 2000.0, 0.0)], "node_id long, x double, y double")
    arcs = spark.createDataFrame([(1, 2, 0)], "u long, v long, k long")
    want = 2000 * 1000 + math.pi * 500**2
    assert ev.coverage(arcs, nodes, 500.0, 25.0).first()["area_m2"] == pytest.approx(want, rel=0.02)


def road(spark, lanes=2):
    """A square of two-way roads and one way home."""
    rows = []
    for u, v in ((1, 2), (2, 3), (3, 4), (4, 1)):
        rows += [(u, v, 0, 100.0, "primary", True, True, lanes, 0, "car", "dangerous", 2.0, True, False), (v, u, 0, 100.0, "primary", True, True, lanes, 0, "car", "dangerous", 2.0, True, False)]
    kind = "u long, v long, k long, length double, highway string, car_allowed boolean, bike_allowed boolean, car_lanes int, bike_lanes int, infra_type string, safety string, risk_factor double, reallocatable boolean, oneway boolean"
    a = spark.createDataFrame(rows, kind).withColumn("grade", F.lit(0.0)).withColumn("bicycle", F.lit(None).cast("string"))
    return prep.car_costs(prep.bike_costs(a))


def test_two_lane_road_keeps_one_direction(spark):
    a = seg.with_segments(road(spark))
    stock = seg.inventory(a)
    assert stock.count() == 4
    act = seg.actions(a, stock, stock.where("seg.u = 1 and seg.v = 2"))
    row = act.first()
    assert row["remaining_after"] == 1 and not row["oneway"] and tuple(row["keep_arc"]) == (1, 2, 0)
    assert [tuple(x) for x in row["lost_car_arcs"]] == [(2, 1, 0)] and len(row["bike_arcs"]) == 2
    arcs, left, created = seg.apply_action(a, stock, act)
    assert arcs.count() == a.count() + 2 and {tuple(r) for r in created.select("u", "v", "k", "safety", "car_allowed").collect()} == {(1, 2, 1, "very_safe", False), (2, 1, 1, "very_safe", False)}
    got = {(r["u"], r["v"]): (r["car_lanes"], r["car_allowed"], r["bike_allowed"]) for r in arcs.where("k = 0").collect()}
    assert got[1, 2] == (1, True, False) and got[2, 1] == (0, False, False) and got[2, 3] == (2, True, True)
    assert left.agg(F.min("lanes_remaining")).first()[0] == 1
    with pytest.raises(ValueError):
        seg.actions(a, stock, None, "other")


def test_optimiser_keeps_the_drive_network_connected(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 100.0), (4, 0.0, 100.0)], "node_id long, x double, y double")
    od = spark.createDataFrame([(1, 3, 2.0), (2, 4, 1.0)], "o long, d long, w double")
    arcs, table, events = opt.optimise(road(spark, 1), nodes, od, "od_aware", iterations=6, every=2)
    log = events.orderBy("iteration").collect()
    assert log[0]["event_type"] == "reallocated_segment"
    kinds = [r["event_type"] for r in log]
    assert set(kinds) <= {"reallocated_segment", "marked_segment_not_reallocatable"}
    path = seg.with_segments(road(spark, 1)).where("not (u in (4, 1) and v in (4, 1))")  # 1-2-3-4: the middle parts it, an end does not
    stock = seg.inventory(path)
    able = {u: opt.feasible(path, seg.actions(path, stock, stock.where(f"seg.u = {u}"))) for u in (1, 2)}
    assert able == {1: True, 2: False}
    assert table.orderBy("iteration").first()["bike_gain_vs_baseline"] == 0.0
    assert table.where("stop_reason is not null").count() == 1
    assert arcs.where("car_lanes < 0").count() == 0
    from roadspark.operators.graph import is_strongly_connected
    from roadspark.operators.views import drive

    assert is_strongly_connected(drive(arcs))


def test_projection_equals_replay(spark):
    fine = seg.with_segments(road(spark, 2))
    segs = [tuple(r["seg"]) for r in fine.select("seg").distinct().collect()]
    log = [(i + 1, i + 1, "reallocated_segment", segs[i % 3]) for i in range(7)]
    events = spark.createDataFrame(log, f"n int, iteration int, event_type string, segment {seg.ARC_STRUCT}")
    left = {s: 2 for s in segs}
    for _, _, _, s in log:
        left[s] = max(0, left[s] - 1)
    out = pj.project(fine, fine.drop("seg"), events)
    got = {(min(r["u"], r["v"]), max(r["u"], r["v"]), 0): r["car_lanes"] for r in out.collect()}
    assert got == left
    stock = seg.inventory(fine)
    assert {tuple(r["seg"]): r["lanes_remaining"] for r in pj.lanes_after(stock, events, 7).collect()} == left
    assert pj.snapshots(10, 3) == [0, 5, 10]
    with pytest.raises(ValueError):
        pj.frames(events, 0)


def test_demand_checks(spark):
    nodes = spark.createDataFrame([(i, float(i * 600), 0.0) for i in range(6)], "node_id long, x double, y double")
    got = dm.random_od(nodes, 50).agg(F.sum("w"), F.count_if(F.col("o") == F.col("d"))).first()
    assert tuple(got) == (50.0, 0)
    assert dm.random_od(nodes, 30).exceptAll(dm.random_od(nodes.repartition(5), 30)).count() == 0
    with pytest.raises(ValueError):
        dm.gen_od(nodes, nodes, nodes, 10, 1.5)
    od = spark.createDataFrame([(0, 1, 1.0)], "o long, d long, w double")
    chain = {(r["o"], r["d"]): r["w"] for r in dm.auxiliary_chain(od, nodes.limit(3)).collect()}
    assert chain[0, 1] == 1.0 and sum(w == 0 for w in chain.values()) == 2
    points = spark.createDataFrame([(1, 1e6, 1e6), (2, 610.0, 3.0)], "id long, x double, y double")
    assert {r["id"]: r["node"] for r in dm.nearest_node(points, nodes, ["id"]).collect()} == {1: 5, 2: 1}


def test_dimensions(spark):
    assert dims.locality_regions(spark).count() == 56 and dims.locality_populations(spark).count() == 54
    assert dims.purpose_counts(spark).count() == 45 and dims.region_counts(spark).count() == 25
    shares = dm.purpose_shares(dims.purpose_counts(spark)).groupBy("region").agg(F.sum("share").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in shares.collect())


def test_simulator_files(spark, tmp_path):
    p = tmp_path / "summary.xml"
    p.write_text('<summary><step time="0" running="2" arrived="1" meanSpeed="3.5" meanWaitingTime="2.9"/><step time="60" running="0" meanSpeed="0"/></summary>')
    rows = simio.load_summary(spark, str(p)).orderBy("time").collect()
    assert rows[0]["meanWaitingTime"] == 2 and rows[1]["arrived"] == 0 and math.isnan(rows[1]["meanSpeedRelative"])
    p = tmp_path / "routes.xml"
    p.write_text('<routes><route id="r1" cost="500"/><vehicle id="a" type="bike" route="r1"/><vehicle id="b" type="bike"><route id="x" cost="1500"/></vehicle><vehicle id="c" type="bike"><routeDistribution><route cost="250"/><route cost="9"/></routeDistribution></vehicle><vehicle id="d" type="car"/></routes>')
    lengths = simio.load_perceived_lengths(spark, str(p), "bike")
    assert {r["id"]: r["km"] for r in lengths.collect()} == {"a": 0.5, "b": 1.5, "c": 0.25}
    assert tuple(simio.mean_perceived_length(lengths).first()) == (750.0, 3)
    with pytest.raises(ValueError, match="no route cost"):
        simio.load_perceived_lengths(spark, str(p))
    with pytest.raises(ValueError, match="no vehicles"):
        simio.load_perceived_lengths(spark, str(p), "tram")
    p = tmp_path / "mean.xml"
    p.write_text('<meandata><interval begin="3600" end="3660"><edge id="e1" speed="10" entered="x"/><edge id="e2" speed="1"/></interval></meandata>')
    r = simio.load_meandata(spark, str(p), "car").first()
    assert (r["id"], r["speed_kmh"], r["entered"], r["time_hr"], r["mode"]) == ("e1", 36.0, None, 1.0, "car")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        simio.load_edgedata(spark, str(p)).collect()
    p.write_text('<meandata><interval begin="60"><edge id="e1" speed="10"/><edge id="e2"/></interval></meandata>')
    assert {(r["edge"], r["time"], r["speed"]) for r in simio.load_edgedata(spark, str(p)).collect()} == {("e1", 60.0, 10.0), ("e2", 60.0, 0.0)}
    p = tmp_path / "trips.xml"
    p.write_text('<tripinfos><tripinfo duration="1" routeLength="2" waitingTime="3" timeLoss="4"/></tripinfos>')
    assert tuple(simio.load_tripinfo(spark, str(p)).first()) == (1.0, 2.0, 3.0, 4.0)


def test_export_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(0, 3600, "Ħal Luqa", "B", 2.9), (0, 3600, "B", "B", 0.5), (3600, 7200, "B", "al_Luqa", 4.0)], "begin int, end int, origin string, destination string, flow double")
    simio.write_od_matrix(m, str(tmp_path / "od"), safe_ids=True)
    back = spark.read.format("xml").option("rowTag", "interval").schema("_begin int, tazRelation array<struct<_from:string,_to:string,_count:int>>").load(str(tmp_path / "od"))
    assert {(r["_begin"], t["_from"], t["_to"], t["_count"]) for r in back.collect() for t in r["tazRelation"]} == {(0, "al_Luqa", "B", 2), (3600, "B", "al_Luqa", 4)}
    edges = spark.createDataFrame([("e", "12.5", 3.0), ("f", None, 4.0), (":i", "1", 1.0)], "id string, cost string, length double")
    assert simio.write_bike_weights(edges, str(tmp_path / "w")) == 1
    square = spark.createDataFrame([("a", 1.0)], "name string, x double").select("name", ring((0, 0), (1, 0), (1, 1), (0, 0)).alias("ring"))
    simio.write_zones(square, str(tmp_path / "z"))
    assert "0.0,0.0 1.0,0.0" in spark.read.text(str(tmp_path / "z")).agg(F.string_agg("value")).first()[0]
    g = tmp_path / "p.geojson"
    g.write_text('{"features": [{"properties": {"name": "q"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}, {"properties": {}, "geometry": null}]}')
    assert simio.load_polygons(spark, str(g)).count() == 1
    assert charts.adjacent_colours(square) == [("a", 0)]


def test_stream_replay_equals_batch(spark, tmp_path):
    import uuid

    from roadspark.streaming.od import replay

    rows = [(1, 2, 0, 3, "reallocated_segment")] * 2 + [(5, 6, 0, 2, "marked_segment_not_reallocatable")] + [(7, 8, 0, 1, "reallocated_segment")] * 3
    kind = "u long, v long, k long, lanes_total int, event_type string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "e"))
    name = f"r{uuid.uuid4().hex}"
    run = replay(spark.readStream.schema(kind).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["u"], r["lanes_remaining"]) for r in spark.table(name).collect()} == {(1, 1), (5, 0), (7, 0)}


def test_points_on_edges(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    areas = spark.createDataFrame([("a", "r", square)], "name string, region string, ring array<struct<x:double,y:double>>")
    at = {1: (5.0, 5.0), 2: (5.0, 5.0), 3: (0.0, 5.0), 4: (5.0, 0.0), 5: (10.0, 5.0), 6: (5.0, 10.0), 7: (0.0, 0.0), 8: (11.0, 5.0), 9: (0.0, 11.0)}
    pois = spark.createDataFrame([(k, *p, None, None, None) for k, p in at.items()], "id long, x double, y double, office string, shop string, amenity string")
    found = lambda edges: sorted(r["id"] for r in dm.destinations_of(pois, areas, 4.0, edges, ("id",)).collect())
    assert found(True) == [1, 2, 3, 4, 5, 6, 7] and found(False) == [1, 2]


def test_nearest_node_copies_no_points(spark, monkeypatch):
    """Each point meets one row of nodes, whatever the size of the cells; ties go to the smaller id."""
    nodes = spark.createDataFrame([(i, float(i * 37 % 101), float(i * 53 % 89)) for i in range(60)] + [(60, 0.0, 0.0), (99, None, 1.0)], "node_id long, x double, y double")
    points = spark.createDataFrame([(i, float(i * 29 % 211) - 50, float(i * 31 % 199) - 50) for i in range(200)] + [(200, 0.0, 0.0)], "id long, x double, y double")
    at = [tuple(r) for r in nodes.where("x is not null").collect()]
    want = {p: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, n) for n, a, b in at)[1] for p, x, y in map(tuple, points.collect())}
    rows = []
    monkeypatch.setattr(dm, "cut", lambda df: (rows.append(df.count()), df)[1])
    for size in (None, 3.0):
        assert {r["id"]: r["node"] for r in dm.nearest_node(points, nodes, ["id"], size).collect()} == want
    assert rows[1] == 201  # the points of the first round, not nine for each
    monkeypatch.setattr(dm, "SENT", 0)
    assert {r["id"]: r["node"] for r in dm.nearest_node(points, nodes, ["id"]).collect()} == want

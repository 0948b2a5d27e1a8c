"""Map files, reprojection and spatial preparation on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from roadspark.functions import geom
from roadspark.operators import demand as dm, prep
from roadspark.sources import osm, simio

MAP = """<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="0.001"/><node id="3" lat="0" lon="0.002"/><node id="4" lat="0.001" lon="0.001"/><node id="9" lat="5" lon="5"/>
<way id="a"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
<way id="b"><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="highway" v="cycleway"/><tag k="oneway" v="yes"/></way>
<way id="c"><nd ref="3"/><nd ref="1"/><tag k="highway" v="primary"/><tag k="oneway" v="-1"/></way>
<way id="d"><nd ref="1"/><nd ref="9"/><tag k="building" v="yes"/></way></osm>"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("map")
    (folder / "map.osm").write_text(MAP)
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ways_are_cut_where_they_meet(spark, path):
    arcs, nodes = osm.load_osm(spark, path)
    got = rows(arcs, "u", "v", "k", "highway", "oneway", "car_allowed", "bike_allowed")
    assert got == [
        (1, 3, 0, "residential", False, True, True), (1, 3, 1, "primary", True, True, True),
        (3, 1, 0, "residential", False, True, True), (3, 1, 1, "cycleway", True, False, True),
    ]
    assert rows(nodes, "node_id") == [(1,), (3,)]
    far = {r["k"]: r["length"] for r in arcs.where("u = 1").collect()}
    assert far[0] == pytest.approx(222.4, abs=0.1) and far[1] == pytest.approx(222.4, abs=0.1)


def test_every_node_in_the_drawn_direction(spark, path):
    arcs, nodes = osm.load_simulator_network(spark, path)
    assert rows(arcs, "u", "v", "highway") == [(1, 2, "residential"), (2, 3, "residential"), (3, 1, "primary"), (3, 4, "cycleway"), (4, 1, "cycleway")]
    assert rows(nodes, "node_id") == [(1,), (2,), (3,), (4,)]


def test_truncation_keeps_the_strong_part_of_cars(spark, path):
    arcs, _ = osm.load_optimisation_network(spark, path, zone=31)
    assert arcs.where("car_allowed").count() == 3 and arcs.where("bike_allowed").count() == 4


def test_reprojection_of_a_known_place(spark):
    at = spark.range(1).select(geom.utm(F.lit(2.294497), F.lit(48.858222), 31).alias("p"), geom.utm(F.lit(9.0), F.lit(0.0), 32).alias("q"), geom.utm(F.lit(9.0), F.lit(-1.0), 32, True).alias("s")).first()
    assert (at["p"]["x"], at["p"]["y"]) == pytest.approx((448252, 5411935), abs=15)
    assert (at["q"]["x"], at["q"]["y"]) == pytest.approx((500000, 0), abs=1e-6) and at["s"]["y"] < 1e7


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


RING = "id long, name string, ring array<struct<x:double,y:double>>"


def test_touching_and_nested_polygons_are_one(spark):
    own = [(1, "a", square(0.0, 0.0, 10.0)), (2, "b", square(10.0, 0.0, 5.0)), (3, "c", square(2.0, 2.0, 1.0)), (4, "d", square(5000.0, 0.0, 1.0)), (5, "e", None)]
    df = spark.createDataFrame(own, RING)
    assert rows(prep.merge_touching(df), "id", "part") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert rows(dm.residential_polygons(df), "res_id") == [(1,), (1,), (1,), (4,)]
    assert rows(prep.merge_touching(df.limit(0)), "id") == []


def test_nearest_polygon_widens_its_cells(spark):
    areas = spark.createDataFrame([(1, "far", square(90_000.0, 0.0, 10.0)), (2, "near", square(0.0, 0.0, 10.0))], RING)
    at = spark.createDataFrame([(1, 70_000.0, 0.0), (2, 5.0, 5.0), (3, 20_000.0, 5.0), (4, None, 1.0)], "id long, x double, y double")
    assert rows(prep.nearest_polygon(at, areas, ["id"]), "id", "name") == [(1, "far"), (2, "near"), (3, "near")]
    assert prep.nearest_polygon(at, areas.limit(0), ["id"]).count() == 0


def test_template(tmp_path):
    (tmp_path / "t.cfg").write_text("net {scenario}.xml")
    assert simio.fill_template(tmp_path / "t.cfg", "base") == "net base.xml"

"""Networks from map files: XML nodes and ways as arcs with attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..operators.prep import merge_modes, reproject

TAGS = ("highway", "lanes", "oneway", "bicycle", "cycleway", "junction", "name", "office", "shop", "amenity", "access", "motor_vehicle")

# Road types of the map that a mode may not use.
NO_CARS = ("cycleway", "footway", "path", "pedestrian", "steps", "track", "bridleway", "corridor", "elevator", "escalator", "construction", "proposed", "raceway", "busway", "platform", "abandoned", "razed", "no")
NO_BIKES = ("motorway", "motorway_link", "footway", "steps", "corridor", "elevator", "escalator", "construction", "proposed", "raceway", "busway", "platform", "abandoned", "razed", "no")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema).load(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, x, y) in degrees; a node that several files repeat is one row."""
    n = _xml(spark, path, "node", "_id long, _lat double, _lon double").where("_id is not null")
    return n.groupBy(F.col("_id").alias("node_id")).agg(F.min("_lon").alias("x"), F.min("_lat").alias("y"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way, refs, *TAGS) of ways with a road type and two nodes at least."""
    w = _xml(spark, path, "way", "_id string, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>")
    tags = F.map_from_entries(F.filter(F.coalesce("tag", F.array()), lambda t: t["_k"].isin(*TAGS)))
    own = w.where("_id is not null").dropDuplicates(["_id"]).select(F.col("_id").alias("way"), F.col("nd._ref").alias("refs"), tags.alias("t"))
    return own.select("way", "refs", *(F.try_element_at("t", F.lit(c)).alias(c) for c in TAGS)).where("highway is not null and size(refs) > 1")


def pieces(ways: DataFrame, nodes: DataFrame, simplify: bool = True) -> DataFrame:
    """(way, piece, u, v, geometry, and the ways' tags): ways cut at every node, or only where ways meet, end or cross
    themselves. Nodes that are not in the file go. A way has at most some thousands of nodes."""
    each = ways.select("way", F.posexplode("refs").alias("pos", "ref")).join(nodes.select(F.col("node_id").alias("ref"), "x", "y"), "ref")
    used = each.groupBy("ref").agg((F.count(F.lit(1)) > 1).alias("shared"))
    stops = each.join(used, "ref").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "x", "y", "shared"))).alias("at"))
    last = F.size("at")
    cuts = F.filter(F.sequence(F.lit(1), last), lambda i: F.lit(not simplify) | (i == 1) | (i == last) | F.element_at("at", i)["shared"])
    spans = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda j: F.struct((j - 1).alias("piece"), F.element_at("cuts", j).alias("i"), F.element_at("cuts", j + 1).alias("j")))
    cut_ = stops.where(last > 1).withColumn("cuts", cuts).select("way", "at", F.explode(spans).alias("s"))
    line = F.transform(F.slice("at", F.col("s.i"), F.col("s.j") - F.col("s.i") + 1), lambda p: geom.point(p["x"], p["y"]))
    out = cut_.select("way", "s.piece", F.element_at("at", F.col("s.i"))["ref"].alias("u"), F.element_at("at", F.col("s.j"))["ref"].alias("v"), line.alias("geometry"))
    return out.join(ways.drop("refs"), "way")


def directed(parts: DataFrame, all_oneway: bool = False) -> DataFrame:
    """Arcs of each piece: one of a one-way street in its direction, else both; ``all_oneway`` takes the drawn direction
    alone, whatever the tags say. k numbers the arcs of a pair by way, piece and direction."""
    told = F.lower(F.trim(F.col("oneway")))
    one = F.coalesce(told.isin("yes", "true", "1", "-1", "reverse"), F.lit(False)) | ((F.col("junction") == "roundabout") | F.col("highway").isin("motorway")) & told.isNull()
    one = F.coalesce(one, F.lit(False))
    back = F.coalesce(told.isin("-1", "reverse"), F.lit(False))
    turns = F.array(F.lit(False)) if all_oneway else F.when(one, F.array(back)).otherwise(F.array(F.lit(False), F.lit(True)))
    each = parts.withColumn("_one", one).withColumn("_back", F.explode(turns))
    turned = each.withColumns({
        "u": F.when(F.col("_back"), F.col("v")).otherwise(F.col("u")), "v": F.when(F.col("_back"), F.col("u")).otherwise(F.col("v")),
        "geometry": F.when(F.col("_back"), F.reverse("geometry")).otherwise(F.col("geometry")),
    })
    k = F.row_number().over(Window.partitionBy("u", "v").orderBy("way", "piece", "_back")) - 1
    return turned.withColumn("k", k.cast("long")).withColumn("oneway", F.col("_one")).withColumn("length", geom.great_circle(F.col("geometry"))).drop("_one", "_back", "piece")


def load_osm(spark: SparkSession, path: str, simplify: bool = True, all_oneway: bool = False, truncate: bool = False, zone: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(arcs, nodes) of a map file, or of all files in a folder: the networks of cars and bikes as one, with flags.

    ``truncate`` keeps the largest strong component of the car network; ``zone`` gives nodes in metres of that zone
    instead of degrees. Lengths are in metres either way.
    """
    nodes = read_nodes(spark, path)
    arcs = directed(pieces(read_ways(spark, path), nodes, simplify), all_oneway)
    shut = F.coalesce(F.col("access").isin("private", "no"), F.lit(False))
    cars = ~F.col("highway").isin(*NO_CARS) & ~shut & ~F.coalesce(F.col("motor_vehicle") == "no", F.lit(False))
    bikes = ~F.col("highway").isin(*NO_BIKES) & ~shut & ~F.coalesce(F.col("bicycle") == "no", F.lit(False))
    out = merge_modes(arcs.where(cars), arcs.where(bikes), truncate)
    ends = out.select("u").union(out.select("v")).distinct().withColumnRenamed("u", "node_id")
    kept = nodes.join(ends, "node_id", "left_semi")
    return out, reproject(kept, zone) if zone is not None else kept


def load_optimisation_network(spark: SparkSession, path: str, zone: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cut where ways meet, both directions, cars truncated."""
    return load_osm(spark, path, simplify=True, all_oneway=False, truncate=True, zone=zone)


def load_simulator_network(spark: SparkSession, path: str, zone: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cut at every node, in the drawn direction, not truncated."""
    return load_osm(spark, path, simplify=False, all_oneway=True, truncate=False, zone=zone)

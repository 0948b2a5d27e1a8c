"""Views of the arcs, and the nodes of a view: only endpoints of surviving arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

ARC = ["u", "v", "k"]


def is_true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def drive(arcs: DataFrame) -> DataFrame:
    return arcs.where(is_true("car_allowed"))


def bikeable(arcs: DataFrame) -> DataFrame:
    return arcs.where(is_true("bike_allowed"))


def reallocatable(arcs: DataFrame) -> DataFrame:
    return arcs.where(is_true("reallocatable"))


def protected(arcs: DataFrame) -> DataFrame:
    return arcs.where(F.col("safety").isin(*dims.PROTECTED))


def plotting(arcs: DataFrame) -> DataFrame:
    return arcs.where(is_true("car_allowed") | F.coalesce(F.col("safety").isin(*dims.PROTECTED), F.lit(False)))


def of_place(arcs: DataFrame, name: str, column: str = "regions") -> DataFrame:
    """Arcs of a region or locality: the list contains it, or the text equals it."""
    kind = dict(arcs.dtypes)[column]
    hit = F.array_contains(column, name) if kind.startswith("array") else F.col(column) == name
    return arcs.where(F.coalesce(hit, F.lit(False)))


def of_road_type(arcs: DataFrame, highway: str) -> DataFrame:
    return arcs.where(F.col("highway") == highway)


def nodes_of(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("u").alias("node")).union(arcs.select(F.col("v").alias("node"))).distinct()


def induced(arcs: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Arcs with both ends among the nodes."""
    a = nodes.select(F.col(node).alias("u")).distinct()
    return arcs.join(a, "u", "left_semi").join(a.withColumnRenamed("u", "v"), "v", "left_semi").select(*arcs.columns)

"""Aggregations over arcs and over demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.expr import literal_map, safe_div

SAFETY_RANK = {s: i for i, s in enumerate(dims.SAFETY)}


def aggregate_by_key(df: DataFrame, keys: list[str], spec: dict[str, Callable[[str], Column]], defaults: dict | None = None) -> DataFrame:
    """One row for each key: the reducer of each column that exists, else its default, else no column."""
    made = [f(c).alias(c) for c, f in spec.items() if c in df.columns]
    out = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    for c, value in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in out.columns else F.lit(value))
    return out


def _first(c: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("u", "v", "k")))


def _label(c: str) -> Column:
    from ..functions import expr

    order = {"highway": expr.HIGHWAY_PRIORITY, "bicycle": expr.BICYCLE_PRIORITY, "cycleway": expr.CYCLEWAY_PRIORITY}[c]
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.array_position(F.lit(order), F.col(c)), F.lit(0)), -F.col("k"))))


def _safest(c: str) -> Column:
    return F.min_by(c, F.try_element_at(literal_map(SAFETY_RANK), F.col(c)))


MERGE_SPEC: dict[str, Callable[[str], Column]] = {
    **{c: F.avg for c in ("length", "grade", "grade_abs", "risk_factor", "speed_kph_original", "speed_kph_current")},
    **{c: F.sum for c in ("car_lanes", "bike_lanes")},
    **{c: F.bool_or for c in ("car_allowed", "bike_allowed", "reallocatable")},
    **{c: _label for c in ("highway", "bicycle", "cycleway")},
    "safety": _safest,
    "infra_type": _first,
    "regions": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))),
    "geometry": _first,
}
SEGMENT_SPEC = MERGE_SPEC | {"length": F.max, "bike_cost_base": F.avg, "bike_cost_penalty": F.avg}


def merge_parallel(arcs: DataFrame) -> DataFrame:
    """Parallel arcs of one direction as one arc with k = 0."""
    return aggregate_by_key(arcs, ["u", "v"], MERGE_SPEC).withColumn("k", F.lit(0).cast("long"))


def segment_graph(arcs: DataFrame) -> DataFrame:
    """One row for each undirected segment (least end, greatest end, k) with its arcs and their number."""
    own = arcs.withColumn("seg", F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("k").alias("k")))
    spec = {**SEGMENT_SPEC}
    made = [f(c).alias(c) for c, f in spec.items() if c in arcs.columns]
    return own.groupBy("seg").agg(*made, F.array_sort(F.collect_list(F.struct("u", "v", "k"))).alias("arcs"), F.count(F.lit(1)).alias("n_arcs"))


def road_type_summary(arcs: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, value, n): how often each value of each tag occurs."""
    columns = [F.col(c).cast("string").alias(c) for c in names]
    long = arcs.select(*columns).unpivot([], names, "attribute", "value")
    return long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def parallel_counts(arcs: DataFrame) -> DataFrame:
    """(u, v, n) of each pair."""
    return arcs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def parallel_summary(arcs: DataFrame) -> DataFrame:
    """One row: pairs, pairs with several arcs, arcs beyond the first, most arcs of a pair."""
    return parallel_counts(arcs).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 1).alias("parallel_pairs"),
        F.sum(F.col("n") - 1).alias("extra_arcs"), F.max("n").alias("most"),
    )


def parallel_distribution(arcs: DataFrame) -> DataFrame:
    """(n, pairs)."""
    return parallel_counts(arcs).groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))


def parallel_top(arcs: DataFrame, k: int = 10) -> DataFrame:
    return parallel_counts(arcs).where("n > 1").orderBy(F.desc("n"), "u", "v").limit(k)


def with_parallel_count(arcs: DataFrame) -> DataFrame:
    return arcs.withColumn("parallel_count", F.count(F.lit(1)).over(Window.partitionBy("u", "v")).cast("int"))


def parallel_differences(arcs: DataFrame) -> DataFrame:
    """(category, n): whether parallel arcs differ in road type or cycleway; every arc of a pair counts."""
    kinds = lambda c: F.size(F.collect_set(F.coalesce(F.col(c), F.lit("")))) > 1
    pair = arcs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), kinds("highway").alias("h"), kinds("cycleway").alias("c")).where("n > 1")
    category = F.when(F.col("h") & F.col("c"), "both").when(F.col("h"), "highway").when(F.col("c"), "cycleway").otherwise("same")
    return pair.groupBy(category.alias("category")).agg(F.sum("n").alias("n"))


def rank_accuracy(exact: DataFrame, approx: DataFrame, value: str = "betweenness") -> DataFrame:
    """One row: mean relative error of approx against exact, and Spearman's rank correlation with averaged ties."""
    met = exact.select("u", "v", "k", F.col(value).alias("a")).join(approx.select("u", "v", "k", F.col(value).alias("b")), ["u", "v", "k"])

    def rank(c: str) -> Column:
        below = F.rank().over(Window.orderBy(c))
        return below + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0

    ranked = met.select("a", "b", rank("a").alias("ra"), rank("b").alias("rb"))
    return ranked.agg(F.avg(F.abs(F.col("a") - F.col("b")) / (F.abs("a") + 1e-9)).alias("mean_relative_error"), F.corr("ra", "rb").alias("spearman"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) between the least and greatest value; bins without values are absent."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.lit(bins), F.width_bucket(F.col(column), F.col("lo"), F.col("hi"), F.lit(bins)))
    at = F.when(F.col("lo") == F.col("hi"), 1).otherwise(at).cast("int")
    width = (F.col("hi") - F.col("lo")) / bins
    counted = df.where(F.col(column).isNotNull()).crossJoin(ends).groupBy(at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"), "n")


# -- demand --------------------------------------------------------------------------------------------------------


def to_od(df: DataFrame) -> DataFrame:
    """(o, d, w) unique on (o, d) from columns o, d, w or a struct od and w; anything else is a TypeError."""
    if {"o", "d", "w"} <= set(df.columns):
        own = df.select("o", "d", "w")
    elif {"od", "w"} <= set(df.columns):
        own = df.select("od.*", "w").toDF("o", "d", "w")
    else:
        raise TypeError("demand needs columns o, d, w or od, w")
    return own.groupBy("o", "d").agg(F.sum(F.col("w").cast("double")).alias("w"))


def timeline_total(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("o", "d").agg(F.sum("w").alias("w"))


def od_matrix(od: DataFrame, nodes: DataFrame, place: str = "region", by: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """(*by, origin, destination, flow): dense over the labels, which are those that occur unless given; pairs whose
    ends have no label, or none of the given ones, go."""
    at = nodes.select("node_id", place)
    met = od.join(at.toDF("o", "origin"), "o").join(at.toDF("d", "destination"), "d").where("origin is not null and destination is not null")
    flows = met.groupBy(*by, "origin", "destination").agg(F.sum("w").alias("flow"))
    spark = od.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "name string") if labels is not None else flows.select(F.col("origin").alias("name")).union(flows.select("destination")).distinct()
    grid = names.toDF("origin").crossJoin(names.toDF("destination"))  # places by places, whatever the demand
    grid = flows.select(*by).distinct().crossJoin(grid) if by else grid
    return grid.join(flows, [*by, "origin", "destination"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def wide_matrix(matrix: DataFrame, labels: list[str]) -> DataFrame:
    return matrix.groupBy("origin").pivot("destination", labels).agg(F.sum("flow")).na.fill(0.0)


def total_matrix(timeline: DataFrame, nodes: DataFrame, place: str = "region", labels: list[str] | None = None) -> DataFrame:
    """As :func:`od_matrix` over the whole timeline; pairs of no or negative weight in total go."""
    return od_matrix(timeline_total(timeline).where("w > 0"), nodes, place, (), labels)


def row_shares(matrix: DataFrame, value: str = "flow", row: str = "origin") -> DataFrame:
    """Each value as a share of its row; rows without any get 0."""
    return matrix.withColumn(value, safe_div(F.col(value), F.sum(value).over(Window.partitionBy(row))))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """share of each row in the total of its keys; a total that isn't positive is an error."""
    total = F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    checked = F.when(total > 0, F.col(value) / total).otherwise(F.raise_error(F.lit("the total must be positive")))
    return df.withColumn("share", checked)


def normalise_weights(od: DataFrame) -> DataFrame:
    """Scaled so that the positive weights have mean 1; others are scaled alike, so zeros stay."""
    factor = od.agg((F.count_if(F.col("w") > 0) / F.sum(F.when(F.col("w") > 0, F.col("w")))).alias("f"))
    return od.crossJoin(factor).select("o", "d", (F.col("w") * F.coalesce("f", F.lit(1.0))).alias("w"))


def safe_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix under ASCII names; names that become equal are added up. Only distinct names pass through Python."""
    from ..functions.expr import safe_id

    names = matrix.select(F.col("origin").alias("name")).union(matrix.select("destination")).distinct()
    ids = names.select("name", safe_id(F.col("name")).alias("id"))
    keys = [c for c in matrix.columns if c not in ("origin", "destination", "flow")]
    met = matrix.join(ids.toDF("origin", "a"), "origin").join(ids.toDF("destination", "b"), "destination")
    return met.groupBy(*keys, F.col("a").alias("origin"), F.col("b").alias("destination")).agg(F.sum("flow").alias("flow"))


def mean_path_length(od: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row: mean over all demand, the unrouted included with 0, and over the routed alone; without ``costs`` the
    demand has them."""
    met = od if costs is None else od.join(costs, ["o", "d"], "left")
    routed = F.when(F.col("cost").isNotNull(), F.col("w"))
    return met.agg(
        F.coalesce(F.sum(F.col("w") * F.col("cost")), F.lit(0.0)).alias("total_length"), F.sum("w").alias("total_weight"),
        safe_div(F.sum(F.col("w") * F.col("cost")), F.sum("w")).alias("avg_length_all"), safe_div(F.sum(F.col("w") * F.col("cost")), F.sum(routed)).alias("avg_length_routed"),
    )


def best_by_error(sweep: DataFrame, value: str = "beta", error: str = "abs_error") -> DataFrame:
    """The first row of least error."""
    return sweep.orderBy(error, value).limit(1)

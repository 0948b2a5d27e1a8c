"""Tables behind the charts; drawing them is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, geom


def pick_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in df.columns), None)


def metric_series(evaluations: DataFrame, metric: str, model: str = "heuristic", scale: float = 1.0, most: int = 6) -> DataFrame:
    """(model, iteration, value) in order, for the first ``most`` models by name."""
    rank = F.dense_rank().over(Window.orderBy(model))
    return evaluations.select(F.col(model).alias("model"), "iteration", (F.col(metric) * scale).alias("value"), rank.alias("_r")).where(F.col("_r") <= most).drop("_r").orderBy("model", "iteration")


def calibration_curve(sweep: DataFrame) -> DataFrame:
    """The sweep by beta with the best one marked, and whether it lies at an end."""
    best = sweep.agg(F.min_by("beta", F.struct("abs_error", "beta")).alias("best"), F.min("beta").alias("lo"), F.max("beta").alias("hi"))
    met = sweep.crossJoin(best)  # one row
    return met.select("beta", "avg_length", "abs_error", (F.col("beta") == F.col("best")).alias("is_best"), ((F.col("best") == F.col("lo")) | (F.col("best") == F.col("hi"))).alias("at_edge")).orderBy("beta")


def matrix_error(modelled: DataFrame, real: DataFrame) -> DataFrame:
    met = modelled.join(real.withColumnRenamed("flow", "real"), ["origin", "destination"], "full_outer")
    return met.select("origin", "destination", (F.coalesce("flow", F.lit(0.0)) - F.coalesce("real", F.lit(0.0))).alias("error"))


def compare_runs(runs: dict[str, DataFrame], metric: str, scale: float = 1.0, least: float | None = None, time: str = "time") -> DataFrame:
    """(scenario, time, value) of a metric; values below ``least`` are masked, runs without the metric are skipped."""
    out = None
    for name, df in runs.items():
        if metric not in df.columns:
            continue
        value = F.col(metric) * scale
        value = F.when(value >= least, value) if least is not None else value
        own = df.select(F.lit(name).alias("scenario"), F.col(time).alias("time"), value.alias("value"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no run has the metric")
    return out


def share_cells(wide: DataFrame, row: str) -> DataFrame:
    """(row, column, share) of a wide table of shares, with titles for names."""
    names = [c for c in wide.columns if c != row]
    titled = wide.select(F.col(row).alias("row"), *(F.col(c).alias(t) for c, t in zip(names, expr.title_case(names))))
    return titled.unpivot(["row"], expr.title_case(names), "column", "share")


def arc_colours(arcs: DataFrame) -> DataFrame:
    s = F.col("safety")
    return arcs.select("u", "v", "k", expr.safety_colour(s).alias("colour"), expr.status_colour(s, F.col("reallocatable")).alias("status"), expr.safety_width(s).alias("width"))


def categorical(arcs: DataFrame, column: str, colours: dict[str, str], default: str = "gray") -> DataFrame:
    return arcs.select("u", "v", "k", F.coalesce(F.try_element_at(expr.literal_map(colours), F.col(column)), F.lit(default)).alias("colour"))


def boolean(arcs: DataFrame, column: str) -> DataFrame:
    return arcs.select("u", "v", "k", F.when(F.coalesce(F.col(column), F.lit(False)), "green").otherwise("red").alias("colour"))


def density(polygons: DataFrame, value: str) -> DataFrame:
    """A value for each unit of area; nothing for zero and for no area."""
    return polygons.withColumn("density", F.nullif(F.try_divide(F.col(value).cast("double"), geom.area(F.col("ring"))), F.lit(0.0)))


def locality_population(localities: DataFrame, populations: DataFrame) -> DataFrame:
    return localities.join(F.broadcast(populations.withColumnRenamed("locality", "name")), "name", "left")  # a literal table


def population_map(localities: DataFrame, populations: DataFrame) -> DataFrame:
    """(name, ring, population, density) of each locality; one without residents has neither."""
    met = density(locality_population(localities, populations), "population")
    return met.select("name", "ring", F.expr("nullif(population, 0)").alias("population"), "density")


def locality_overlay(localities: DataFrame) -> DataFrame:
    """(name, x, y, outline): where each locality's label stands and its border as text; null rings go."""
    own = localities.where("ring is not null").withColumn("_c", geom.centroid(F.col("ring")))
    return own.select("name", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), geom.shape_text(F.col("ring")).alias("outline"))


def adjacent_colours(polygons: DataFrame, colours: int = 10) -> list[tuple[str, int]]:
    """A colour for each of some tens of areas such that touching ones differ, first fit by name; beyond 1,000 areas it
    is an error, as this runs on the driver."""
    rows = polygons.select("name", "ring").orderBy("name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many areas for a map's colours")
    corners = {r["name"]: {(p["x"], p["y"]) for p in r["ring"]} for r in rows}
    given: dict[str, int] = {}
    for name, own in corners.items():
        taken = {c for other, c in given.items() if own & corners[other]}
        given[name] = next(c for c in range(max(colours, len(taken) + 1)) if c not in taken)
    return list(given.items())

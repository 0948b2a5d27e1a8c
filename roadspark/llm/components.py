"""Connected components of a graph that no machine holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge whose root is another node; root is the smallest node reachable.

    Each round reroutes every edge to the smallest neighbour of its lower end (large star), then of its upper end
    (small star); rounds grow with the logarithm of the diameter. All tables stay in the shared folder. A hub's rows
    meet only in a join between two stored tables, which adaptive execution can split, and in aggregates that
    combine before the shuffle. Nulls and self-links count for nothing; an empty input gives an empty table.
    """
    up, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(up.alias("u"), low.alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        parent = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "parents")
        above = parent.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        if e.count() == parent.count() and not e.join(above, "v", "left_semi").take(1):
            drop(parent)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = materialize(
            e.join(above, "v", "left").select("u", F.coalesce("mv", "v").alias("v")).distinct(), "large"
        )
        drop(e, parent)
        parent = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "parents")
        met = large.join(parent, "u").select(
            F.array(
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            ).alias("both")
        )
        e = materialize(met.select(F.inline("both")).where("u <> v").distinct(), "edges")
        drop(large, parent)

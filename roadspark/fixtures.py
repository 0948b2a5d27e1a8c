"""A road network, nodes and demand as views of the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every row of lineitem is a survey of a road out of its supplier's junction; roads of one type and end are one arc.
ARCS = """
select u, v, cast(row_number() over (partition by u, v order by p_type) - 1 as bigint) as k,
       cast(100 + cast(sum(l_partkey * 37) as bigint) % 900 as double) as length,
       cast(1 + count(*) % 3 as int) as lanes,
       case p_type when 'STANDARD' then 'residential' when 'ECONOMY' then 'service' when 'MEDIUM' then 'tertiary'
                   when 'SMALL' then 'secondary' when 'LARGE' then 'primary' else 'cycleway' end as highway,
       p_type <> 'PROMO' as car_allowed,
       p_type = 'PROMO' or sum(case when l_returnflag = 'R' then 3 else 0 end) < count(*) as bike_allowed
from (select l_suppkey as u, l_partkey, l_returnflag, p_type,
             case when p_type = 'PROMO' then least(l_suppkey - l_suppkey % 8 + (l_suppkey * 3 + l_linenumber % 2) % 8, n - 1)
                  else (l_suppkey * 31 + l_linenumber * 17) % n end as v
      from lineitem join part on l_partkey = p_partkey cross join (select count(*) as n from supplier) c) t
where u <> v group by u, v, p_type
"""

OD = """
select o, d, cast(count(*) as double) as w
from (select l_suppkey as o, o_custkey % (select count(*) from supplier) as d
      from lineitem join orders on l_orderkey = o_orderkey) t
where o <> d group by o, d
"""

NODES = """
select s_suppkey as node_id, n_name as locality, r_name as region,
       cast((s_suppkey * 7919) % 10007 as double) as x,
       cast((s_suppkey * 104729) % 10009 as double) as y,
       case when s_suppkey % 11 = 0 then null else cast(floor(s_acctbal / 100) as double) end as elevation
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

#: Arcs with a safety class, risk and costs, as the cleaning pipeline makes them from the road type alone.
CLEAN = f"""
select u, v, k, length, lanes, highway, car_allowed, bike_allowed,
       case when highway = 'cycleway' then 'cycle_track' when highway = 'residential' then 'mixed' else 'car' end as infra_type,
       case when highway = 'cycleway' then 'very_safe' when highway = 'residential' then 'moderate'
            when highway = 'service' then 'moderate' else 'dangerous' end as safety,
       case when highway = 'cycleway' then 1.0e0 when highway in ('residential', 'service') then 1.5e0 else 2.0e0 end as risk_factor
from ({ARCS}) a
"""

TIMELINE = """
select cast(hour(ts) * 3600 as int) as begin, cast((hour(ts) + 1) * 3600 as int) as "end",
       user_id % (select count(*) from supplier) as o, (user_id * 7 + event_id) % (select count(*) from supplier) as d,
       cast(1 as double) as w
from events
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(spark: SparkSession, sf_dir: str) -> SparkSession:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables in ``sf_dir``."""
    return with_views(spark, sf_dir).sql(sql.replace('"end"', "`end`"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, ARCS)


def clean_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, CLEAN)


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, OD)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, NODES)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, TIMELINE)

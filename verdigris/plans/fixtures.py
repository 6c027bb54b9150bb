"""Views over the driver's tables that stand for spatial inputs. The same SQL runs in Spark and elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_boxes": """SELECT s_suppkey source_id, s_nationkey zone_id, s_name name,
        CASE WHEN s_suppkey%3=0 THEN 3 WHEN s_suppkey%3=1 THEN -4 ELSE -8 END impact,
        CAST((s_suppkey*7919)%1000 AS DOUBLE) x0, CAST((s_suppkey*104729)%1000 AS DOUBLE) y0,
        CAST((s_suppkey*7919)%1000+200+s_suppkey%150 AS DOUBLE) x1,
        CAST((s_suppkey*104729)%1000+200+s_suppkey%130 AS DOUBLE) y1 FROM supplier""",
    "fx_raster": """SELECT l_returnflag tile, CAST(l_partkey%32 AS INT) "row", CAST(l_orderkey%32 AS INT) "col",
        CAST(CAST(sum(l_quantity) AS BIGINT)%500 AS DOUBLE) value FROM lineitem GROUP BY 1,2,3""",
    "fx_edges": """SELECT src,dst,cost FROM (
        SELECT CAST(CASE WHEN p_partkey%10<>0 THEN p_partkey-1 ELSE floor(p_partkey/2)+3 END AS BIGINT) src,
        p_partkey dst, CAST(1+p_size%7 AS DOUBLE) cost FROM part WHERE p_partkey>=1) t WHERE src<dst""",
    "fx_zones": """SELECT n_nationkey zone_id, CAST((n_nationkey%5)*300 AS DOUBLE) x0, CAST(floor(n_nationkey/5)*300 AS DOUBLE) y0,
        CAST((n_nationkey%5)*300+300 AS DOUBLE) x1, CAST(floor(n_nationkey/5)*300+300 AS DOUBLE) y1 FROM nation""",
    "fx_points": """SELECT c_custkey point_id, c_name name, c_mktsegment type, CAST((c_custkey*7919)%1350 AS DOUBLE) x,
        CAST((c_custkey*104729)%1350 AS DOUBLE) y FROM customer""",
    "fx_soil": """SELECT p_partkey px, CAST(p_partkey%40 AS INT) c, CAST(floor(p_partkey/40) AS INT) r,
        CAST(1+p_size AS DOUBLE) clay, CAST(1+(p_partkey*7)%90 AS DOUBLE) silt, CAST(1+(p_partkey*13)%80 AS DOUBLE) sand,
        CAST(p_partkey%300 AS DOUBLE) cfvo FROM part""",
    "fx_flood": """SELECT event_type tile, CAST(event_id%100 AS INT) r, CAST(floor(event_id/100)%100 AS INT) c, value/100 depth
        FROM events WHERE value>0""",
    "fx_lines": """SELECT user_id line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) pos,
        CAST(event_id%997 AS DOUBLE) x, CAST((event_id*31)%991 AS DOUBLE) y FROM events""",
    "fx_water": """SELECT CAST(floor(s_suppkey/4) AS BIGINT) water_id, CAST((s_suppkey*7919)%900 AS DOUBLE) x0, CAST((s_suppkey*104729)%900 AS DOUBLE) y0,
        CAST((s_suppkey*7919)%900+40+s_suppkey%170 AS DOUBLE) x1, CAST((s_suppkey*104729)%900+30+s_suppkey%190 AS DOUBLE) y1 FROM supplier""",
    "fx_woods": """SELECT s_suppkey source_id, CAST((s_suppkey*7919)%120*10 AS DOUBLE) x0, CAST((s_suppkey*104729)%120*10 AS DOUBLE) y0,
        CAST((s_suppkey*7919)%120*10+40+s_suppkey%9*10 AS DOUBLE) x1, CAST((s_suppkey*104729)%120*10+30+s_suppkey%11*10 AS DOUBLE) y1 FROM supplier""",
    "fx_spill_sources": """SELECT s_suppkey source_id, (s_suppkey*17)%(SELECT count(*) FROM part) node,
        CAST(60+s_suppkey%50 AS DOUBLE) pollution FROM supplier""",
    "fx_tiles": """SELECT n_nationkey tile_id, concat(CASE WHEN n_nationkey%2=0 THEN 'N' ELSE 's' END, repeat('0', CAST(n_nationkey%3 AS INT)),
        CAST(40+n_nationkey AS VARCHAR(9)), CASE WHEN n_nationkey%3=0 THEN 'E' ELSE 'w' END, CAST(n_nationkey*7 AS VARCHAR(9)),
        CASE WHEN n_nationkey%4=0 THEN '_V1-2' ELSE '' END, CASE WHEN n_nationkey%5=0 THEN '' ELSE '.TIF' END) file_name FROM nation""",
}
_TABLES = ("supplier", "lineitem", "part", "nation", "customer", "events", "documents", "orders")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables are passed by reference, so no temporary view is left behind."""
    sql = VIEWS[name].replace('"', "`")
    used = [t for t in _TABLES if re.search(rf"(?i)\bFROM\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"(?i)\bFROM\s+{t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(body: str, recursive: bool = False) -> str:
    """SQL with the views that it names, and those that they need, before it."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive or body.upper().startswith("WITH RECURSIVE") else "WITH "
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^WITH( RECURSIVE)?\s+", "", body)
        return f"{head}{ctes}, {body}" if ctes else f"{head}{body}"
    return f"{head}{ctes} {body}" if ctes else body

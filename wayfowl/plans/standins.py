"""Stand-in tables for tracks, light series and labels over the star-schema tables, as one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: US(x) stands for microseconds since the epoch and TS(x) for a timestamp; {name} for a table or another stand-in.
VIEWS = {
    "light": "SELECT user_id AS trip_id, TS(ts) AS ts, event_id AS ord, value AS lux FROM {events}",
    "label": "SELECT user_id AS trip_id, TS(ts) AS ts, event_id AS ord, CASE WHEN event_type IN ('click','view') THEN 'B' WHEN event_type IN ('purchase','signup') THEN 'W' ELSE 'mig' END AS label FROM {events}",
    "track": "SELECT l_suppkey AS trip_id, TS(l_shipdate) AS ts, CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS BIGINT) AS ord, l_quantity AS x, CAST(FLOOR(l_extendedprice / 200) AS DOUBLE) / 10 AS y FROM {lineitem}",
    "dates": "SELECT o_custkey AS trip_id, o_orderkey AS ord, TS(o_orderdate) AS ts, CAST(o_orderkey % 2 + 1 AS INT) AS type FROM {orders}",
    "seg": "SELECT trip_id, CAST(FLOOR((ord - 1) / 40.0) AS INT) + 1 AS seg, MIN(ord) AS first_ord, MAX(ord) AS last_ord, CAST(MIN(ts) AS DATE) AS f_day, CAST(MAX(ts) AS DATE) AS l_day, AVG(x) AS mu_x, STDDEV_SAMP(x) AS sd_x, AVG(y) AS mu_y, STDDEV_SAMP(y) AS sd_y FROM {track} GROUP BY 1, 2",
    "days": "SELECT l_suppkey AS trip_id, CAST(l_shipdate AS DATE) AS day, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS light, CASE WHEN MIN(l_linenumber) = 5 THEN NULL ELSE MIN(l_linenumber) = 6 END AS wetdry FROM {lineitem} WHERE l_linenumber >= 5 GROUP BY 1, 2",
    "colony": "SELECT n_nationkey AS colony_id, n_name AS colony, CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 37) % 360 - 180 AS DOUBLE) AS lon FROM {nation}",
    "trips": "SELECT s_suppkey AS trip_id, s_nationkey AS colony_id FROM {supplier}",
    "calib": "SELECT o.o_custkey AS logger_id, c.c_mktsegment AS producer, c.c_nationkey AS colony_id, CAST(ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS INT) AS period, CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 101 = 0 THEN o.o_totalprice * 50 ELSE o.o_totalprice END AS zenith FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey",
}


def spark_sql(name: str, sf_dir: str) -> str:
    text = re.sub(r"\{(\w+)\}", lambda m: f"({spark_sql(m[1], sf_dir)})" if m[1] in VIEWS else f"parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name])
    return re.sub(r"TS\((\w+)\)", r"CAST(\1 AS TIMESTAMP)", text)


def stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(spark_sql(name, sf_dir))


def oracle(sql: str) -> str:
    """DuckDB SQL with the stand-ins that it names as common table expressions; US(x) and DAY(x) are spelt out."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\bv_(\w+)", text) + re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    ctes = [f"v_{n} AS ({re.sub(r'TS[(]([a-z_]+)[)]', r'CAST(\1 AS TIMESTAMP)', re.sub(r'[{]([a-z_]+)[}]', lambda m: 'v_' + m[1] if m[1] in VIEWS else m[1], VIEWS[n]))})" for n in need]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        word = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
        ctes.append(body[len(word) :])
        text = word + ",\n".join(ctes)
    else:
        text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return re.sub(r"\bUS\(([^()]+)\)", r"epoch_us(\1)", text)


def plain(df: DataFrame) -> DataFrame:
    """Engine-neutral columns: timestamps as microseconds, dates as text, doubles rounded to 6 places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind == "date":
            c = c.cast("string")
        elif kind == "double":
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(out)

"""Views over the driver's tables in the shape of measurement data: one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
#: The measured region.
BOX = (41.82, 41.832, 12.46, 12.474)
TIE = ("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")


def u(key: str, factor: int, shift: int) -> str:
    """A number in [0, 1) spread over whole keys."""
    return f"(CAST((CAST({key} AS BIGINT) * {factor} + {shift}) % 2147483647 AS DOUBLE) / 2147483647e0)"


def _lat(key: str, shift: int) -> str:
    return f"41.82e0 + 0.012e0 * {u(key, 1103515245, shift)}"


def _lon(key: str, shift: int) -> str:
    return f"12.46e0 + 0.014e0 * {u(key, 1220703125, shift)}"


_MNC = "CASE s_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 88 END"
VIEWS = {
    "cells": f"""SELECT s_suppkey AS enode, s_suppkey % 504 AS npci, {_MNC} AS mnc,
        CASE WHEN s_suppkey % 17 = 0 THEN 0e0 ELSE {_lat("s_suppkey", 12345)} END AS cell_lat,
        CASE WHEN s_suppkey % 17 = 0 THEN 0e0 ELSE {_lon("s_suppkey", 54321)} END AS cell_lon FROM {{supplier}}""",
    "measurements": f"""SELECT l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
        l_orderkey % 7 AS campaign_id, round({_lat("l_orderkey", 777)}, 6) AS latitude, round({_lon("l_orderkey", 999)}, 6) AS longitude,
        l_suppkey AS enode, l_suppkey % 504 AS npci, {_MNC} AS mnc,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE -40e0 - l_quantity END AS rssi,
        l_discount * 100e0 - 5e0 AS nsinr, -60e0 - l_quantity AS nrsrp, -10e0 - l_tax * 100e0 AS nrsrq, l_linestatus = 'O' AS interpolated
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "links": f"""SELECT o_orderkey AS row_id, o_custkey % 23 AS bs_idx, o_custkey AS ue_idx,
        round({_lat("(o_custkey % 23)", 12345)}, 5) AS BSLatitude, round({_lon("(o_custkey % 23)", 54321)}, 5) AS BSLongitude,
        round({_lat("o_custkey", 777)}, 5) AS UELatitude, round({_lon("o_custkey", 999)}, 5) AS UELongitude,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -90e0 ELSE -40e0 - o_orderkey % 61 END AS RSSI,
        -45e0 - (o_orderkey * 7 + o_custkey) % 53 AS sim_rssi FROM {{orders}}""",
    "predictions": f"""SELECT vec_id, label AS difficulty, embedding AS heatmap, 8e0 * {u("vec_id", 1103515245, 77)} AS ue_y, 8e0 * {u("vec_id", 1220703125, 88)} AS ue_x,
        200e0 + 14e0 * (vec_id % 100) AS original_img_size, {_lat("vec_id", 31)} AS center_lat, {_lon("vec_id", 37)} AS center_lon FROM {{embeddings}}""",
    "paths": "SELECT l_orderkey AS rx, l_suppkey AS tx, l_discount * 1e-5 AS re, l_tax * 1e-5 AS im FROM {lineitem}",
    "trials": "SELECT user_id AS bs_idx, event_id AS trial, CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS score FROM {events}",
    "epoch_metrics": "SELECT event_type AS loader, user_id % 10 AS epoch, event_id AS batch, value AS metric, event_id % 31 + 1 AS rows FROM {events}",
    "buildings": f"""SELECT p_partkey AS feature_id, p_size AS size,
        CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_partkey % 260 AS {{string}}), ' m') WHEN p_partkey % 3 = 1 THEN CAST(p_partkey % 70 AS {{string}}) END AS height,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS {{string}}) END AS levels,
        CASE WHEN p_type LIKE 'SMALL%' THEN 'house' WHEN p_type LIKE 'MEDIUM%' THEN 'apartments' WHEN p_type LIKE 'LARGE%' THEN 'office' WHEN p_type LIKE 'ECONOMY%' THEN 'industrial' ELSE 'other' END AS kind,
        CASE WHEN p_partkey % 5 = 0 THEN concat(CAST(p_partkey % 90 AS {{string}}), ' ft') END AS height_ft,
        {_lat("p_partkey", 5)} AS min_lat, {_lat("p_partkey", 5)} + 1e-6 * p_size AS max_lat, {_lon("p_partkey", 6)} AS min_lon, {_lon("p_partkey", 6)} + 1e-6 * p_size AS max_lon FROM {{part}}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(string="STRING", **{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def cte(*names: str) -> str:
    """The views as WITH entries for the oracle."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(string='VARCHAR', **{t: t for t in TABLES})})" for n in names)

"""Patent-shaped tables made from the driver's tables by SQL that runs alike on Spark and DuckDB.

Table names stand in braces: Spark gets frames for them, DuckDB gets the plain names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CLAIMS = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos,
  CAST(l_linenumber AS INT) AS number,
  CAST(CASE WHEN l_linenumber > 1 THEN 1 + l_partkey % (l_linenumber - 1) END AS INT) AS parent,
  CAST(CASE WHEN l_linenumber > 1 THEN 1 + l_suppkey % 9 END AS INT) AS fig,
  CASE WHEN l_linenumber = 1 THEN concat('A method for part ', l_partkey, ' comprising supplying from source ', l_suppkey, '.')
    ELSE concat('The method of claim ', 1 + l_partkey % (l_linenumber - 1), ' wherein supplier ', l_suppkey, ' is shown in FIG. ', 1 + l_suppkey % 9, '.') END AS text
FROM {lineitem}
"""

CITES = """
SELECT DISTINCT concat('US', 7000000 + l_orderkey, 'B2') AS src, concat('US', 7000000 + l_partkey, 'B2') AS dst FROM {lineitem}
"""

ISSUES = """
SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id AS BIGINT) AS seq,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'error' WHEN event_type IN ('click', 'signup') THEN 'warning' ELSE 'info' END AS severity,
  concat('code.', event_type) AS code, concat('bucket ', CAST(floor(value / 25) AS INT)) AS message,
  CAST(CASE WHEN event_id % 3 = 0 THEN '54' END AS STRING) AS inid
FROM {events}
"""

#: Code, raw text and the plain values that the text was made of.
FRONT = """
SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(c_custkey AS BIGINT) AS cust, c_name, n_name,
  CAST(10 + o_orderkey % 90 AS INT) AS series, CAST(100000 + o_orderkey AS INT) AS serial,
  CAST(7000000 + o_orderkey AS INT) AS grant_no, CAST(1 + o_orderkey % 40 AS INT) AS n_claims, CAST(1 + o_custkey % 20 AS INT) AS n_sheets
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

LINES = """
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(12.0 * pos + CASE WHEN pos % 7 = 0 THEN 40.0 ELSE 0.0 END AS DOUBLE) AS y,
  CAST(CASE WHEN (doc_id + pos) % 5 = 0 THEN 95.0 ELSE 80.0 END AS DOUBLE) AS x, text
FROM (SELECT doc_id, {posline} FROM {documents} WHERE text IS NOT NULL)
"""

BOXES = """
SELECT CAST(l_orderkey AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS INT) AS k,
  CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 37 + l_linenumber * 91) % 700 AS DOUBLE) AS y0,
  CAST(l_partkey % 500 + 20 + l_quantity AS DOUBLE) AS x1, CAST((l_suppkey * 37 + l_linenumber * 91) % 700 + 10 + l_quantity * 2 AS DOUBLE) AS y1
FROM {lineitem}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{([a-z]\w*)\}", sql)) - {"posline"}
    sql = sql.replace("{posline}", "posexplode(split(text, '\\n', -1)) AS (pos, text)")
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    sql = sql.replace("{posline}", "unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos")
    return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)

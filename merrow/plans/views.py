"""Inputs of the registered queries: views over the driver tables, in SQL that Spark and DuckDB both read.

``{name}`` is a table or an earlier view; EPOCH(x) is milliseconds of a timestamp, independent of the session's zone.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from merrow.operators.split import temporal_split

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
USER_DAY = "concat('U', CAST(user_id AS STRING), '-', CAST(CAST(floor(EPOCH(ts) / 86400000) AS BIGINT) AS STRING))"

VIEWS = {
    "v_interactions": """
SELECT concat('C', CAST(o_custkey AS STRING)) AS user_id, p_type AS domain, concat('P', CAST(l_partkey AS STRING)) AS original_item_id,
       concat(p_type, '::', 'P', CAST(l_partkey AS STRING)) AS parent_asin,
       CAST(1 + (CAST(l_quantity AS INT) + l_linenumber) % 5 AS INT) AS rating,
       EPOCH(o_orderdate) AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "v_raw": """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE user_id END AS user_id, original_item_id AS parent_asin,
       CASE WHEN l_orderkey % 89 = 0 THEN 6 ELSE rating END AS rating,
       CASE WHEN l_orderkey % 83 = 0 THEN 0 ELSE ts END AS ts,
       0 AS copy_no, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM {v_interactions}
UNION ALL
SELECT user_id, original_item_id, 1 + rating % 5, ts, 1, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM {v_interactions} WHERE l_orderkey % 11 = 0""",
    "v_items": """
SELECT concat(p_type, '::', 'P', CAST(p_partkey AS STRING)) AS item_id, p_type AS domain, concat('P', CAST(p_partkey AS STRING)) AS original_item_id,
       p_name AS title, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS store,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price,
       CAST(1 + (p_size % 41) / 10.0 AS DOUBLE) AS average_rating,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1000 AS DOUBLE) END AS rating_number,
       p_type AS main_category, p_type AS cat1, p_brand AS cat2, p_partkey AS seq
FROM {part}""",
    "v_tool_log": f"""
SELECT {USER_DAY} AS request_id, user_id, event_id, EPOCH(ts) AS ts_ms,
       row_number() OVER (PARTITION BY {USER_DAY} ORDER BY ts, event_id) AS step_no,
       event_type AS tool, event_type <> 'error' AS ok, value / 1000 AS latency_seconds, props AS args,
       concat('A', CAST(user_id % 2 AS STRING)) AS agent, concat('K', CAST(user_id % 5 AS STRING)) AS kind
FROM {{events}}""",
    "v_steps": """
SELECT request_id, agent, kind, step_no, tool, ok, latency_seconds,
       CASE WHEN ok THEN NULL WHEN event_id % 4 = 0 THEN 'unknown_args' WHEN event_id % 4 = 1 THEN 'bad_reference' WHEN event_id % 4 = 2 THEN 'time_budget' ELSE 'tool_error' END AS error_kind,
       CAST(event_id % 120 AS BIGINT) AS prompt_tokens, CAST(event_id % 40 AS BIGINT) AS completion_tokens,
       CAST(20 + event_id % 60 AS DOUBLE) AS asked_price, concat('cat', CAST(event_id % 3 AS STRING)) AS asked_category, event_id % 2 = 0 AS has_filter
FROM {v_tool_log}""",
    "v_scored": """
SELECT request_id, agent, kind, user_id,
       CASE WHEN user_id % 3 = 0 THEN 'cold' WHEN user_id % 3 = 1 THEN 'sparse' ELSE 'warm' END AS segment,
       count(*) AS steps, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors,
       sum(CASE WHEN ok THEN 0 ELSE 1 END) = 0 AS success, round(sum(latency_seconds), 6) AS latency,
       CASE WHEN sum(CASE WHEN tool = 'purchase' THEN 1 ELSE 0 END) > 0 THEN round(sum(CASE WHEN tool = 'purchase' THEN latency_seconds ELSE 0 END), 6) END AS spend
FROM {v_tool_log} GROUP BY request_id, agent, kind, user_id""",
}


class Views:
    """The tables below ``sf_dir`` and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                sql = re.sub(r"EPOCH\(([\w.]+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", VIEWS[name])
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", sql))})
        return self._made[name]

    def n_items(self) -> int:
        """Items of the catalog."""
        return self.part.count()

    def n_users(self) -> int:
        """Users of the customer table."""
        return self.customer.count()

    def split(self) -> DataFrame:
        """The events with their split."""
        return temporal_split(self.v_interactions)


SPLIT_SQL = """
v_n AS (SELECT count(*) AS n FROM v_interactions),
v_rank AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM v_interactions),
v_cut AS (SELECT (SELECT ts FROM v_rank WHERE rn = greatest(CAST(floor(n * 0.8) AS BIGINT) - 1, 0)) AS c1,
                 (SELECT ts FROM v_rank WHERE rn = greatest(CAST(floor(n * 0.9) AS BIGINT) - 1, 0)) AS c2 FROM v_n),
v_split AS (SELECT v_interactions.*, CASE WHEN ts <= c1 THEN 'train' WHEN ts <= c2 THEN 'validation' ELSE 'test' END AS split
            FROM v_interactions CROSS JOIN v_cut)"""


@cache
def duck(*names: str) -> str:
    """A WITH clause for DuckDB of the views named and those below them; ``v_split`` stands for the split events."""
    wanted: dict[str, str] = {}

    def add(name: str) -> None:
        if name == "v_split":
            add("v_interactions")
            wanted[name] = SPLIT_SQL
        elif name in VIEWS and name not in wanted:
            for below in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(below)
            sql = re.sub(r"EPOCH\(([\w.]+)\)", r"epoch_ms(\1)", VIEWS[name])
            wanted[name] = f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', sql)})"

    for name in names:
        add(name)
    return "WITH " + ",\n".join(wanted.values())

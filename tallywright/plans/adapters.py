"""The given star-schema and event tables seen as ledger tables.

Each adapter is one SELECT that Spark and DuckDB both run: Spark with the tables passed in, DuckDB with the tables
as views. Timestamps stay without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTS = {
    # Orders as decisions of ten tenants: an order is in force until the customer's next one, and follows the one before.
    "decisions": """
        SELECT CAST(o_custkey % 10 AS STRING) AS tenant_id, o_orderkey AS id, concat('Ship ', o_orderpriority, ' ', CAST(o_custkey % 50 AS STRING)) AS title,
               CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'P' THEN 'approved' ELSE 'canonical' END AS status,
               o_orderpriority AS scope_domain, CASE o_custkey % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'api' ELSE '' END AS scope_system,
               CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('owner-', CAST(o_custkey AS STRING)) END AS owner,
               round(o_totalprice / 500000, 4) AS confidence, o_orderdate AS created_at, o_orderdate AS valid_from,
               lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
               lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id,
               o_custkey AS customer
        FROM {orders}""",
    # Parts as proposals with scopes of a few rows; red and blue oppose each other.
    "proposals": """
        SELECT CAST(p_size % 3 AS STRING) AS tenant_id, p_partkey AS id, p_name AS title, 'draft' AS status, p_brand AS scope_domain, p_type AS scope_system, p_partkey AS created_at
        FROM {part}""",
    "writes": """
        SELECT CAST(user_id AS STRING) AS tenant_id, event_id AS id, ts, event_type, value, props FROM {events}""",
    "requests": """
        SELECT CAST(user_id AS STRING) AS tenant_id, event_id AS request_id, ts, event_type AS operation, concat('agent-', CAST(event_id % 7 AS STRING)) AS agent_id, CAST(ceil(value) AS BIGINT) AS tokens_used, CAST(1 AS BIGINT) AS executions_used
        FROM {events}""",
    # A tree: node n hangs below n / 3; five kinds of edges.
    "nodes": """
        SELECT 'all' AS tenant_id, event_id AS id, concat(event_type, ' ', CAST(event_id AS STRING)) AS title, CASE WHEN event_id = 0 THEN NULL ELSE CAST(floor(event_id / 3) AS BIGINT) END AS parent_id, ts AS created_at, 'draft' AS status
        FROM {events}""",
    # Two tenants with the same ids: one's nodes hang below n / 3, the other's below n / 2.
    "forest": """
        SELECT 'a' AS tenant_id, event_id AS id, concat(event_type, ' ', CAST(event_id AS STRING)) AS title, CASE WHEN event_id = 0 THEN NULL ELSE CAST(floor(event_id / 3) AS BIGINT) END AS parent_id, ts AS created_at, 'draft' AS status
        FROM {events}
        UNION ALL
        SELECT 'b', event_id, concat('other ', CAST(event_id AS STRING)), CASE WHEN event_id = 0 THEN NULL ELSE CAST(floor(event_id / 2) AS BIGINT) END, ts, 'draft' FROM {events}""",
    # The proposals, a fifth of them without a domain and a seventh without a system: empty scope parts mean any.
    "wild": """
        SELECT CAST(p_size % 3 AS STRING) AS tenant_id, p_partkey AS id, p_name AS title, 'draft' AS status, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS scope_domain, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS scope_system, p_partkey AS created_at
        FROM {part}""",
    "edges": """
        SELECT event_id AS from_id, CAST(floor(event_id / 3) AS BIGINT) AS to_id, CASE event_id % 5 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'related_to' ELSE 'depends_on' END AS edge_type, ts AS created_at
        FROM {events}""",
    "messages": """
        SELECT CAST(conv_id AS STRING) AS channel_id, concat(CAST(turn AS STRING), '.000100') AS ts, text, role FROM {conversations}""",
    "evidence": """
        SELECT source AS tenant_id, text AS content, doc_id AS created_at FROM {documents}""",
    "checkpoints": """
        SELECT CAST(user_id % 4 AS STRING) AS tenant_id, event_id AS id, CAST(user_id AS STRING) AS agent_id, event_type AS task_id, props AS checkpoint_data, CASE WHEN event_id % 11 = 0 THEN 'handed_off' ELSE 'active' END AS status, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN CAST(3600 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS ttl_seconds
        FROM {events}""",
    "usage": """
        SELECT ts, CAST(user_id % 4 AS STRING) AS tenant_id, CASE event_id % 9 WHEN 0 THEN 'proposed' WHEN 1 THEN 'reused' WHEN 2 THEN 'rejected' WHEN 3 THEN 'stale' WHEN 4 THEN 'detected' WHEN 5 THEN 'resolved' WHEN 6 THEN 'false_positive' WHEN 7 THEN 'feature' ELSE 'error' END AS kind,
               event_type AS name, CAST(floor(value * 1000) AS BIGINT) AS latency_us, CAST(ceil(value) AS BIGINT) AS tokens, concat('m', CAST(event_id % 3 AS STRING)) AS model, event_id
        FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SELECTS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)})


def cte(*names: str) -> str:
    """The adapters as the WITH clause of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', SELECTS[n])})" for n in names)


def leafed(writes: DataFrame) -> DataFrame:
    """Writes with the hash of what they say."""
    return writes.withColumn("leaf_hash", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "event_type"), 256))


#: The same as DuckDB's CTE, after ``writes``.
LEAFED = "leafed AS (SELECT *, sha256(concat(CAST(id AS VARCHAR), '|', event_type)) AS leaf_hash FROM writes)"


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, so that results compare without a zone."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def sql_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"

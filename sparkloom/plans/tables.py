"""The record model over the driver's tables, for Spark and for DuckDB.

Every column is a deterministic expression of the given tables, so that each
registered query has an independent SQL counterpart over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
# The enumerations of the record model.
CONTENT_TYPES = ("text", "conversation", "note", "summary")
TIERS = ("working", "episodic", "semantic", "procedural", "reference")
SOURCES = ("manual", "cli", "api", "mcp", "browser", "import", "consolidation")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = (
        read(spark, sf_dir, "events").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"), F.max("ts").alias("seen"))
    )
    docs = read(spark, sf_dir, "documents")
    ids = docs.select((F.col("doc_id") - 100).alias("older")).distinct()
    i = F.col("doc_id")
    back = lambda days: F.expr(f"timestamp'{AS_OF}' - make_dt_interval(cast({days} as int))")
    return (
        docs.join(events, i == F.col("user_id"), "left")
        .join(ids, i == F.col("older"), "left")
        .select(
            i.alias("id"),
            F.col("text").alias("content"),
            F.col("lang").alias("namespace"),
            F.col("source").alias("source_uri"),
            _pick(CONTENT_TYPES, i).alias("content_type"),
            _pick(TIERS, i).alias("tier"),
            _pick(SOURCES, i).alias("source"),
            F.concat(F.lit("model-"), (i % 6).cast("string")).alias("model_id"),
            F.concat(F.lit("agent-"), (i % 4).cast("string")).alias("agent"),
            F.concat(F.lit("session-"), (i % 50).cast("string")).alias("session_id"),
            back("doc_id % 400").alias("created_at"),
            back("doc_id % 60").alias("updated_at"),
            ((i * 37) % 101 / 100.0).alias("importance"),
            F.coalesce("n", F.lit(0)).alias("access_count"),
            F.coalesce("p", F.lit(0)).alias("useful_count"),
            F.col("seen").alias("last_accessed_at"),
            (i % 10 != 9).alias("is_active"),
            F.when((i % 7 == 3) & F.col("older").isNotNull(), i + 100).alias("superseded_by"),
            F.when(i % 11 == 5, i - 1).alias("parent_id"),
            F.when(i % 13 == 0, back("doc_id % 400 - 30")).alias("expires_at"),
            ((i % 21 - 10) / 10.0).alias("valence"),
            F.when(i % 17 == 0, '{"immutable":1}').when(i % 19 == 0, '{"goal_id":"g1","n":2}').otherwise("{}").alias("metadata"),
        )
    )


def memory_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    tags = F.array_union(F.split(F.lower("p_name"), " "), F.array(F.lower("p_type")))
    return part.select(F.col("p_partkey").alias("memory_id"), F.explode(tags).alias("tag"))


def memory_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
        .agg(F.max(1 - F.col("l_discount")).alias("relevance"))
    )


def memory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events: from each event's user to the next one's, the strongest of equal links."""
    ordered = Window.partitionBy("event_type").orderBy("ts", "event_id")
    pairs = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.lead("user_id").over(ordered).alias("target_id"), F.col("value"), F.col("event_type")
    )
    return (
        pairs.where("target_id IS NOT NULL AND source_id <> target_id").groupBy("source_id", "target_id")
        .agg(F.least(F.lit(1.0), F.max("value") / 500).alias("strength"), F.min("event_type").alias("link_type"))
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), F.col("event_type").alias("query"), F.col("ts").alias("accessed_at")
    )


def search_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.get_json_object("props", "$.k").alias("query"), F.col("value").alias("max_score"), F.col("ts").alias("created_at")
    )


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("job-"), (F.col("user_id") % 10).cast("string")).alias("job_name"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("ts").alias("created_at"),
    )


def co_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"))
        .agg(F.sort_array(F.collect_set("l_partkey")).alias("memory_ids"), F.max("l_shipdate").alias("created_at"))
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.lower("p_type").alias("type")
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as a forest of typed edges."""
    r = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in_region").alias("relationship"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.lit("supplies").alias("relationship"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("buys").alias("relationship"))
    return r.unionByName(s).unionByName(c)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.lower("p_type").alias("domain"),
        F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", "false").otherwise("partial").alias("resolution"),
        F.when(F.col("l_linestatus") == "F", "resolved").otherwise("open").alias("status"),
        F.col("l_shipdate").alias("resolved_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("agent-"), (F.col("o_custkey") % 9).cast("string")).alias("assignee"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("blocked").alias("status"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "critical").when(F.substring("o_orderpriority", 1, 1) == "2", "high")
        .when(F.substring("o_orderpriority", 1, 1) == "3", "medium").otherwise("low").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same tables for DuckDB, to be put in front of a query.
DUCK = f"""WITH ev_ AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p, max(ts) AS seen FROM events GROUP BY 1),
memories AS (SELECT d.doc_id AS id, d.text AS content, d.lang AS namespace, d.source AS source_uri,
  {_sql_list(CONTENT_TYPES)}[d.doc_id % 4 + 1] AS content_type, {_sql_list(TIERS)}[d.doc_id % 5 + 1] AS tier,
  {_sql_list(SOURCES)}[d.doc_id % 7 + 1] AS source, 'model-' || (d.doc_id % 6) AS model_id, 'agent-' || (d.doc_id % 4) AS agent,
  'session-' || (d.doc_id % 50) AS session_id,
  TIMESTAMP '{AS_OF}' - to_days(CAST(d.doc_id % 400 AS INTEGER)) AS created_at,
  TIMESTAMP '{AS_OF}' - to_days(CAST(d.doc_id % 60 AS INTEGER)) AS updated_at,
  CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 AS importance, coalesce(n, 0) AS access_count, coalesce(p, 0) AS useful_count,
  seen AS last_accessed_at, d.doc_id % 10 <> 9 AS is_active,
  CASE WHEN d.doc_id % 7 = 3 AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id + 100) THEN d.doc_id + 100 END AS superseded_by,
  CASE WHEN d.doc_id % 11 = 5 THEN d.doc_id - 1 END AS parent_id,
  CASE WHEN d.doc_id % 13 = 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(d.doc_id % 400 - 30 AS INTEGER)) END AS expires_at,
  CAST(d.doc_id % 21 - 10 AS DOUBLE) / 10 AS valence,
  CASE WHEN d.doc_id % 17 = 0 THEN '{{"immutable":1}}' WHEN d.doc_id % 19 = 0 THEN '{{"goal_id":"g1","n":2}}' ELSE '{{}}' END AS metadata
  FROM documents d LEFT JOIN ev_ ON d.doc_id = ev_.user_id),
memory_tags AS (SELECT DISTINCT p_partkey AS memory_id, unnest(list_append(string_split(lower(p_name), ' '), lower(p_type))) AS tag FROM part),
memory_entities AS (SELECT l_orderkey AS memory_id, l_partkey AS entity_id, max(1 - l_discount) AS relevance FROM lineitem GROUP BY 1, 2),
memory_links AS (SELECT source_id, target_id, least(1.0, max(value) / 500) AS strength, min(event_type) AS link_type FROM
  (SELECT user_id AS source_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS target_id, value, event_type FROM events)
  WHERE target_id IS NOT NULL AND source_id <> target_id GROUP BY 1, 2),
access_log AS (SELECT event_id AS id, user_id AS memory_id, event_type AS query, ts AS accessed_at FROM events),
search_misses AS (SELECT json_extract_string(props, '$.k') AS query, value AS max_score, ts AS created_at FROM events WHERE event_type = 'error'),
job_outcomes AS (SELECT event_id AS id, 'job-' || (user_id % 10) AS job_name, event_type <> 'error' AS success, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN props END AS error, ts AS created_at FROM events),
co_retrievals AS (SELECT l_orderkey AS query_id, list_sort(list(DISTINCT l_partkey)) AS memory_ids, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1),
entities AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, lower(p_type) AS type FROM part),
relationships AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in_region' AS relationship FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplies' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'buys' FROM customer),
predictions AS (SELECT l_orderkey || '-' || l_linenumber AS id, round(l_discount * 10, 2) AS confidence, lower(p_type) AS domain,
  CASE l_returnflag WHEN 'R' THEN 'true' WHEN 'A' THEN 'false' ELSE 'partial' END AS resolution,
  CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'open' END AS status, l_shipdate AS resolved_at FROM lineitem JOIN part ON l_partkey = p_partkey),
tasks AS (SELECT o_orderkey AS id, 'agent-' || (o_custkey % 9) AS assignee, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'blocked' END AS status,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority, o_orderdate AS created_at FROM orders)
"""

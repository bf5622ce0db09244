"""Filter, join, set and window queries (F-*, J-*, U-*, W-*, O-*, Y-*, D-*)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.scoring import days_between
from sparkloom.operators import lifecycle as L
from sparkloom.operators import relational as R
from sparkloom.plans.registry import query


def at(text: str):
    return F.lit(text).cast("timestamp")


@query("s1_active_scan", "SELECT id, namespace, importance FROM memories WHERE is_active AND importance > 0.5")
def _(t):
    return t.memories.where("is_active AND importance > 0.5").select("id", "namespace", "importance")


@query("f1_dynamic_filter", """SELECT id FROM memories WHERE content_type = 'note' AND created_at >= TIMESTAMP '2023-06-01' AND created_at <= TIMESTAMP '2024-01-15' AND importance >= 0.3 AND namespace = 'en'""")
def _(t):
    return t.memories.where(R.conditions(content_type="note", after=at("2023-06-01"), before=at("2024-01-15"), min_importance=0.3, namespace="en")).select("id")


@query("f2_session_scope", "SELECT id FROM memories WHERE tier <> 'working' OR session_id = 'session-5'")
def _(t):
    return R.in_session(t.memories, "session-5").select("id")


@query("f3_metadata_weight", "SELECT id, CASE WHEN json_extract_string(metadata, '$.immutable') IS NOT NULL THEN 0.35 ELSE 1.0 END::DOUBLE AS weight FROM memories")
def _(t):
    return t.memories.select("id", R.metadata_weight(F.get_json_object("metadata", "$.immutable").isNotNull()).alias("weight"))


@query("f4_any_tag", "SELECT id FROM memories WHERE id IN (SELECT memory_id FROM memory_tags WHERE tag IN ('red', 'bolt'))")
def _(t):
    return R.with_any_tag(t.memories, t.memory_tags, ["red", "bolt"]).select("id")


@query("f5_all_tags", "SELECT id FROM memories WHERE id IN (SELECT memory_id FROM memory_tags WHERE tag = 'red') AND id IN (SELECT memory_id FROM memory_tags WHERE tag = 'bolt')")
def _(t):
    return R.with_all_tags(t.memories, t.memory_tags, ["red", "bolt"]).select("id")


@query("f6_like", "SELECT id FROM memories WHERE content ILIKE '%tion the%'")
def _(t):
    return t.memories.where(F.col("content").ilike("%tion the%")).select("id")


@query("f7_json_predicate", "SELECT id FROM memories WHERE coalesce(json_extract_string(metadata, '$.immutable'), '') <> '1'")
def _(t):
    return t.memories.where(F.coalesce(F.get_json_object("metadata", "$.immutable"), F.lit("")) != "1").select("id")


@query("f8_json_goal", "SELECT id FROM memories WHERE json_extract_string(metadata, '$.goal_id') = 'g1'")
def _(t):
    return t.memories.where(F.get_json_object("metadata", "$.goal_id") == "g1").select("id")


@query("f9_null_safe", "SELECT a.id, b.id AS other FROM memories a JOIN memories b ON a.superseded_by IS NOT DISTINCT FROM b.superseded_by AND b.id = a.id + 1")
def _(t):
    a = t.memories.select("id", F.col("superseded_by").alias("s"))
    b = t.memories.select(F.col("id").alias("other"), F.col("superseded_by").alias("s2"))
    return a.join(b, (F.col("other") == F.col("id") + 1) & F.col("s").eqNullSafe(F.col("s2"))).select("id", "other")


@query("f10_between", "SELECT id FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-14 12:00:00'")
def _(t):
    middle = at("2024-01-12 06:00:00")
    return t.memories.where(F.col("created_at").between(middle - F.expr("INTERVAL 54 HOURS"), middle + F.expr("INTERVAL 54 HOURS"))).select("id")


@query("f11_browse", """SELECT id, created_at FROM memories WHERE is_active AND namespace = 'en' AND id IN (SELECT memory_id FROM memory_tags WHERE tag = 'red') ORDER BY created_at DESC, id LIMIT 20""")
def _(t):
    return R.browse(t.memories, t.memory_tags, R.conditions(namespace="en"), ["red"]).select("id", "created_at")


@query("f12_storage_gate", """SELECT id, len(list_filter([CASE WHEN length(trim(content)) < 120 AND content_type NOT IN ('summary', 'conversation') THEN 'too_short' END,
  CASE WHEN length(trim(content)) = 0 THEN 'empty' END], lambda x: x IS NOT NULL)) AS n FROM memories""")
def _(t):
    return t.memories.select("id", F.size(R.storage_gate(F.col("content"), F.col("content_type"))).cast("long").alias("n"))


@query("f13_is_metadata", """SELECT memory_id, bool_or(tag IN ('benchmark', 'run-summary', 'metrics', 'health-check', 'regression', 'progress')) AS is_metadata FROM memory_tags GROUP BY 1""")
def _(t):
    lists = t.memory_tags.groupBy("memory_id").agg(F.collect_set("tag").alias("tags"))
    return lists.select("memory_id", R.infer_metadata(F.col("tags"), F.lit("{}")).alias("is_metadata"))


@query("f14_preview", "SELECT id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS preview FROM memories")
def _(t):
    return t.memories.select("id", R.preview(F.col("content")).alias("preview"))


@query("f16_null_tolerant", "SELECT id FROM memories WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-01'")
def _(t):
    return t.memories.where(F.col("expires_at").isNull() | (F.col("expires_at") >= at("2024-01-01"))).select("id")


# --- joins ---


@query("j1_tags_of_active", "SELECT tag, id FROM memory_tags JOIN memories ON id = memory_id WHERE is_active")
def _(t):
    return t.memory_tags.join(t.memories.where("is_active").select("id"), F.col("id") == F.col("memory_id")).select("tag", "id")


@query("j2_entity_names", """SELECT DISTINCT entity_id, name, namespace FROM memory_entities JOIN memories m ON m.id = memory_id AND is_active JOIN entities e ON e.id = entity_id""")
def _(t):
    return R.entity_names(t.entities, t.memory_entities, t.memories)


@query("j3_entity_counts", """SELECT e.id, count(DISTINCT CASE WHEN is_active THEN memory_id END) AS memory_count FROM entities e LEFT JOIN memory_entities ON entity_id = e.id LEFT JOIN memories m ON m.id = memory_id GROUP BY 1""")
def _(t):
    return R.entity_counts(t.entities, t.memory_entities, t.memories)


PAIRS = ", pr AS (SELECT x.entity_id AS a, y.entity_id AS b, count(DISTINCT x.memory_id) AS shared, min(x.memory_id) AS first_memory FROM memory_entities x JOIN memory_entities y ON x.memory_id = y.memory_id AND x.entity_id < y.entity_id GROUP BY 1, 2)"


@query("j4_co_occurrence", PAIRS + " SELECT * FROM pr WHERE shared >= 2")
def _(t):
    return R.co_occurrence(t.memory_entities)


@query("j5_pairs_without_edge", PAIRS + """ SELECT * FROM pr WHERE shared >= 2 AND NOT EXISTS (SELECT 1 FROM (SELECT memory_ids[1] AS s, memory_ids[2] AS t FROM co_retrievals WHERE len(memory_ids) > 1) e
  WHERE (e.s = a AND e.t = b) OR (e.s = b AND e.t = a))""")
def _(t):
    edges = t.co_retrievals.where("size(memory_ids) > 1").select(F.get("memory_ids", F.lit(1)).alias("source"), F.get("memory_ids", F.lit(0)).alias("target"))
    return R.without_edges(R.co_occurrence(t.memory_entities), edges)


@query("j6_orphan_entities", "SELECT id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM memory_entities WHERE entity_id = e.id)")
def _(t):
    return t.entities.join(t.memory_entities.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("j7_not_in", "SELECT id FROM memories WHERE is_active AND id NOT IN (SELECT DISTINCT memory_id FROM memory_entities)")
def _(t):
    return t.memories.where("is_active").join(t.memory_entities.select(F.col("memory_id").alias("id")), "id", "left_anti").select("id")


@query("j8_orphan_chunks", "SELECT id FROM memories c WHERE is_active AND EXISTS (SELECT 1 FROM memories p WHERE p.id = c.parent_id AND NOT p.is_active)")
def _(t):
    return t.memories.where("is_active").join(t.memories.where("NOT is_active").select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")


@query("j9_neighbours", """SELECT DISTINCT node, other, relationship FROM (SELECT source AS node, target AS other, relationship FROM relationships UNION ALL SELECT target, source, relationship FROM relationships) WHERE node = 'n3'""")
def _(t):
    return R.neighbours(t.relationships).where("node = 'n3'")


@query("j10_edge_names", "SELECT a.n_name AS source_name, b.r_name AS target_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey", raw=True)
def _(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_name"), F.col("r_name").alias("target_name"))


@query("j11_temporal_neighbours", """, e AS (SELECT event_id AS id, ts AS created_at FROM events), n AS (SELECT a.id AS target_id, b.id, abs(epoch_us(a.created_at) - epoch_us(b.created_at)) AS gap FROM e a JOIN e b ON a.id % 20 = 0 AND a.id <> b.id
  AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 3600000000)
  SELECT target_id, id, CAST(rank AS INTEGER) AS rank, gap / 1e6 AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY gap, id) AS rank FROM n) WHERE rank <= 5""")
def _(t):
    """Events with an id divisible by 20, and all events within an hour of them."""
    events = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(True).alias("is_active"))
    return R.temporal_neighbours(events.where("id % 20 = 0"), events)


@query("j12_preceding_week", """SELECT theme_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT t.id AS theme_id, e.id, row_number() OVER (PARTITION BY t.id ORDER BY e.importance DESC, e.id) AS rank FROM memories t JOIN memories e
  ON e.created_at >= t.created_at - INTERVAL 7 DAY AND e.created_at < t.created_at WHERE t.tier = 'semantic' AND e.tier = 'episodic') WHERE rank <= 5""")
def _(t):
    return R.preceding_week(t.memories.where("tier = 'semantic'"), t.memories.where("tier = 'episodic'"))


@query("j15_tag_lists", "SELECT m.id, string_agg(tag, ',' ORDER BY tag) AS tags FROM memories m LEFT JOIN memory_tags ON memory_id = m.id GROUP BY 1")
def _(t):
    lists = t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.listagg("tag", F.lit(",")).alias("x"), F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return t.memories.select("id").join(lists, "id", "left").select("id", "tags")


@query("j19_array_pairs", """, p AS (SELECT unnest(memory_ids) AS a, memory_ids FROM co_retrievals), q AS (SELECT a, unnest(memory_ids) AS b FROM p) SELECT a, b, count(*) AS n FROM q WHERE a < b GROUP BY 1, 2""")
def _(t):
    return R.array_pairs(t.co_retrievals, "memory_ids")


@query("j20_tag_pairs", "SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM memory_tags x JOIN memory_tags y ON x.memory_id = y.memory_id AND x.tag < y.tag GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    return R.tag_pairs(t.memory_tags)


@query("j21_two_hops", """, nb AS (SELECT source AS node, target AS other FROM relationships UNION SELECT target, source FROM relationships), o AS (SELECT other AS node, 1 AS hop FROM nb WHERE node = 's1'),
  w AS (SELECT nb.other AS node, 2 AS hop FROM o JOIN nb ON o.node = nb.node) SELECT node, min(hop) AS hop FROM (SELECT * FROM o UNION ALL SELECT * FROM w) WHERE node <> 's1' GROUP BY 1""")
def _(t):
    start = t.relationships.where("source = 's1'").select(F.col("source").alias("node")).distinct()
    return R.two_hops(start, t.relationships)


@query("j22_linked", """, s AS (SELECT id FROM memories WHERE id % 20 = 0), b AS (SELECT target_id AS id, strength, link_type FROM memory_links WHERE source_id IN (SELECT id FROM s) UNION ALL
  SELECT source_id, strength, link_type FROM memory_links WHERE target_id IN (SELECT id FROM s)) SELECT DISTINCT ON (id) id, strength, link_type FROM b WHERE id NOT IN (SELECT id FROM s) ORDER BY id, strength DESC, link_type DESC""")
def _(t):
    return R.linked(t.memories.where("id % 20 = 0"), t.memory_links)


@query("j23_theta_filter", "SELECT m.id, e.name FROM entities e JOIN memory_entities ON entity_id = e.id JOIN memories m ON m.id = memory_id AND is_active WHERE e.name ILIKE '%ring%'")
def _(t):
    named = t.entities.where(F.col("name").ilike("%ring%")).select(F.col("id").alias("entity_id"), "name")
    live = t.memories.where("is_active").select("id")
    return t.memory_entities.join(named, "entity_id").join(live, F.col("memory_id") == F.col("id")).select("id", "name")


@query("j24_judgments", "SELECT query, memory_id, max(CASE WHEN useful_count > 0 THEN 2 ELSE 1 END) AS grade FROM access_log JOIN memories m ON m.id = memory_id WHERE is_active GROUP BY 1, 2")
def _(t):
    return R.judgments(t.access_log, t.memories)


@query("j25_namespace_or_tag", "SELECT DISTINCT id, importance FROM memories LEFT JOIN memory_tags ON memory_id = id WHERE is_active AND (namespace = 'en' OR tag = 'red') ORDER BY importance DESC, id LIMIT 200")
def _(t):
    rows = t.memories.withColumn("namespace", F.when(F.col("namespace") == "en", "red").otherwise(F.col("namespace")))
    return R.namespace_or_tag(rows, t.memory_tags, "red")


# --- set operations ---


@query("u1_edge_ends", "SELECT id, count(*) AS link_count FROM (SELECT source_id AS id FROM memory_links UNION ALL SELECT target_id FROM memory_links) GROUP BY 1")
def _(t):
    from sparkloom.operators.analytics import link_counts

    return link_counts(t.memory_links)


@query("u2_linked_ids", ", s AS (SELECT id FROM memories WHERE id % 20 = 0) SELECT target_id AS id FROM memory_links WHERE source_id IN (SELECT id FROM s) AND target_id NOT IN (SELECT id FROM s) UNION SELECT source_id FROM memory_links WHERE target_id IN (SELECT id FROM s) AND source_id NOT IN (SELECT id FROM s)")
def _(t):
    return R.linked(t.memories.where("id % 20 = 0"), t.memory_links).select("id")


@query("u4_candidate_pool", "(SELECT id FROM memories WHERE content ILIKE '%tion%' AND is_active) UNION (SELECT id FROM memories WHERE is_active ORDER BY created_at DESC, id LIMIT 100)")
def _(t):
    active = t.memories.where("is_active")
    return R.candidate_pool(active.where(F.col("content").ilike("%tion%")), active.orderBy(F.desc("created_at"), "id").limit(100))


@query("u6_diff", """SELECT id, CASE WHEN NOT is_active THEN 'archived' WHEN created_at >= TIMESTAMP '2024-01-10' THEN 'created' ELSE 'updated' END AS change FROM memories
  WHERE updated_at >= TIMESTAMP '2024-01-10' OR (is_active AND created_at >= TIMESTAMP '2024-01-10')""")
def _(t):
    return R.diff(t.memories, at("2024-01-10"))


# --- windows ---


@query("w2_dedup_rank", """SELECT id, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS content_hash,
  first_value(id) OVER (PARTITION BY namespace, content_type, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) ORDER BY created_at DESC, id DESC) AS canonical_id,
  CAST(row_number() OVER (PARTITION BY namespace, content_type, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) ORDER BY created_at DESC, id DESC) AS INTEGER) AS rn FROM memories WHERE is_active AND parent_id IS NULL""")
def _(t):
    return L.canonical_rows(t.memories)


@query("w4_recalibrate", """, r AS (SELECT id, importance, row_number() OVER (ORDER BY importance, id) - 1 AS i, count(*) OVER () AS n FROM memories WHERE is_active AND importance <> 1.0)
  SELECT id, importance AS old_importance, floor((0.10::DOUBLE + i / (n - 1) * 0.80::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100 AS new_importance FROM r""")
def _(t):
    return L.recalibrate(t.memories)


@query("w6_capped_groups", "SELECT id, source_uri FROM (SELECT id, source_uri, row_number() OVER (PARTITION BY source_uri ORDER BY created_at DESC, id) AS r FROM memories WHERE tier = 'episodic') WHERE r <= 3 OR source_uri IS NULL")
def _(t):
    return R.capped_per_group(t.memories.where("tier = 'episodic'").select("id", "source_uri", "created_at"), "source_uri").select("id", "source_uri")


@query("w7_without_repeats", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type", raw=True)
def _(t):
    return R.without_repeats(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("w8_context", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events", raw=True)
def _(t):
    return R.with_context(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "previous", "next")


@query("w9_median_of_last", """, r AS (SELECT job_name, duration_ms, row_number() OVER (PARTITION BY job_name ORDER BY created_at DESC, id DESC) AS rn FROM job_outcomes), s AS (SELECT job_name, list_sort(list(duration_ms)) AS v FROM r WHERE rn <= 7 GROUP BY 1)
  SELECT job_name, v[len(v) // 2 + 1] AS median FROM s""")
def _(t):
    return R.median_of_last(t.job_outcomes, "job_name", "duration_ms")


@query("w10_latest", "SELECT namespace, id FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id DESC) AS r FROM memories WHERE content_type = 'summary') WHERE r = 1")
def _(t):
    return R.latest_per(t.memories.where("content_type = 'summary'").select("namespace", "id", "created_at"), "namespace").select("namespace", "id")


@query("w11_token_budget", """SELECT namespace, id, spent FROM (SELECT namespace, id, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS BIGINT) AS spent,
  row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS r FROM memories WHERE is_active) WHERE spent <= 4000 OR r = 1""")
def _(t):
    rows = t.memories.where("is_active").select("namespace", "id", "importance", F.ceil(F.length("content") / 4).alias("tokens"))
    return R.within_budget(rows, "namespace", [F.desc("importance"), "id"], F.col("tokens"), 4000).select("namespace", "id", "spent")


@query("w12_thirds", """SELECT namespace, id, CASE WHEN r <= greatest(3, ceil(n * 0.3)) THEN 'top' WHEN r <= greatest(3, ceil(n * 0.3)) + ceil(n * 0.4) THEN 'middle' ELSE 'rest' END AS part FROM
  (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS r, CAST(count(*) OVER (PARTITION BY namespace) AS DOUBLE) AS n FROM memories WHERE is_active)""")
def _(t):
    rows = t.memories.where("is_active").select("namespace", "id", "importance")
    return R.thirds(rows, "namespace", [F.desc("importance"), "id"]).select("namespace", "id", "part")


@query("w13_argmax", "SELECT namespace, (SELECT id FROM memories x WHERE x.namespace = m.namespace ORDER BY importance DESC, id DESC LIMIT 1) AS id FROM memories m GROUP BY 1")
def _(t):
    return t.memories.groupBy("namespace").agg(F.expr("max_by(id, struct(importance, id))").alias("id"))


# --- order and limits ---


@query("o2_page", "SELECT id, importance FROM memories WHERE is_active ORDER BY importance DESC, id LIMIT 20 OFFSET 40")
def _(t):
    return R.page(t.memories.where("is_active").select("id", "importance"), [F.desc("importance"), "id"], 40, 20)


@query("o3_score_order", "SELECT id, importance FROM memories ORDER BY importance DESC, id LIMIT 50")
def _(t):
    return t.memories.select("id", "importance").orderBy(F.desc("importance"), "id").limit(50)


@query("o5_time_distance", "SELECT id FROM memories ORDER BY abs(epoch_us(created_at) - epoch_us(TIMESTAMP '2023-11-11 07:00:00')), id LIMIT 25")
def _(t):
    return t.memories.orderBy(F.abs(F.unix_micros("created_at") - F.unix_micros(at("2023-11-11 07:00:00"))), "id").limit(25).select("id")


@query("o6_sample")
def _(t):
    return R.sample(t.memories.where("is_active").select("id"), 50)


@query("o7_requested_order", "SELECT place, id, namespace FROM (VALUES (0, 7), (1, 3), (2, 11)) v(place, i) JOIN memories ON id = i")
def _(t):
    ids = t.spark.range(1).select(F.expr("array(7L, 3L, 11L)").alias("ids"))
    return R.in_order_of(ids, t.memories.select("id", "namespace")).select("place", "id", "namespace")


# --- dates, arrays, maps ---


@query("d3_age_days", "SELECT id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400e6 AS age_days FROM memories")
def _(t):
    return t.memories.select("id", days_between(t.as_of, F.col("created_at")).alias("age_days"))


@query("d5_period_starts", """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, (date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month FROM events""", raw=True)
def _(t):
    day = F.expr("INTERVAL 1 DAY")
    week = F.date_trunc("week", F.col("ts") + day) - day
    return t.events.select("event_id", F.date_trunc("day", "ts").alias("day"), week.alias("week"), F.date_trunc("month", "ts").alias("month"))


@query("y1_arrays", """SELECT query_id, memory_ids[1:3] AS first_three, list_contains(memory_ids, 7) AS has_seven FROM co_retrievals""")
def _(t):
    return t.co_retrievals.select("query_id", F.slice("memory_ids", 1, 3).alias("first_three"), F.array_contains("memory_ids", 7).alias("has_seven"))


@query("y3_merge_metadata", "SELECT id, CASE WHEN id % 17 = 0 THEN 'b=2' WHEN id % 19 = 0 THEN 'b=2,goal_id=g1,n=2' ELSE 'b=2' END AS merged FROM memories")
def _(t):
    old = F.from_json("metadata", "map<string,string>")
    new = F.from_json(F.lit('{"immutable":null,"b":"2"}'), "map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(L.merge_metadata(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t.memories.select("id", F.array_join(entries, ",").alias("merged"))


@query("y4_json_fallback", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", raw=True)
def _(t):
    return t.events.select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"))


@query("y6_json_build", """SELECT id, '{"id":' || id || ',"ns":"' || namespace || '"}' AS j FROM memories""")
def _(t):
    return t.memories.select("id", F.to_json(F.struct("id", F.col("namespace").alias("ns"))).alias("j"))


# --- lifecycle ---


@query("l1_archive_candidates", """, c AS (SELECT *, CASE WHEN importance < 0.3 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 90 DAY AND access_count < 2 THEN 'stale'
  WHEN access_count = 0 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 365 DAY THEN 'abandoned' WHEN access_count = 0 AND importance < 0.5 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 14 DAY THEN 'neglected'
  WHEN access_count = 0 AND importance < 0.6 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY THEN 'forgotten' END AS reason FROM memories WHERE is_active AND tier NOT IN ('semantic', 'procedural', 'reference'))
  SELECT id, reason, importance, access_count, created_at FROM c WHERE reason IS NOT NULL""")
def _(t):
    return L.archive_candidates(t.memories, t.as_of)


@query("l2_expire", """, e AS (SELECT id, coalesce(expires_at, CASE WHEN tier = 'working' THEN created_at + INTERVAL 1 DAY END) AS expires_at FROM memories WHERE is_active)
  SELECT id, expires_at, expires_at <= TIMESTAMP '2024-02-01' AS archived FROM e WHERE expires_at IS NOT NULL""")
def _(t):
    return L.expire(t.memories, t.as_of)


@query("l3_expire_reports", """SELECT DISTINCT id, TIMESTAMP '2024-02-08' AS expires_at FROM memories JOIN memory_tags ON memory_id = id WHERE is_active AND source = 'mcp' AND importance <= 0.6
  AND created_at < TIMESTAMP '2024-01-18' AND expires_at IS NULL AND tag IN ('red', 'ring')""")
def _(t):
    return L.expire_reports(t.memories, t.memory_tags, t.as_of, ("red", "ring"))


@query("l4_adjust_importance", __import__("sparkloom.plans.q_analytics", fromlist=["QUALITY"]).QUALITY + """, a AS (SELECT id, importance, CASE WHEN access_count >= 5 AND importance < 0.8 THEN floor(least(0.9, importance + CASE WHEN quality >= 0.7 THEN 0.1 ELSE 0.05 END) * 100 + 0.5) / 100
  WHEN access_count = 0 AND created_at < TIMESTAMP '2024-01-02' AND importance > 0.3 AND quality < 0.2 THEN floor(greatest(0.1, importance - 0.05) * 100 + 0.5) / 100
  WHEN access_count >= 3 AND access_count < 5 AND importance < 0.8 THEN least(0.9, floor((importance + 0.02) * 100 + 0.5) / 100) END AS n,
  CASE WHEN access_count = 0 THEN 'decay' ELSE 'boost' END AS action FROM scored WHERE is_active AND round(importance, 2) <> 1.0)
  SELECT id, action, importance AS old_importance, n AS new_importance FROM a WHERE n IS NOT NULL AND n <> importance""")
def _(t):
    from sparkloom.operators.analytics import with_quality

    return L.adjust_importance(with_quality(t.memories, t.memory_links, t.as_of), None, t.as_of)


@query("l7_promote_tiers", """, c AS (SELECT *, CASE WHEN tier = 'episodic' AND (useful_count >= 2 OR (access_count >= 5 AND created_at <= TIMESTAMP '2024-01-25' AND (importance >= 0.3 OR useful_count >= 1))) THEN 'semantic'
  WHEN tier = 'episodic' AND source <> 'consolidation' AND id IN (SELECT memory_id FROM memory_tags WHERE tag IN ('technique', 'learning', 'how-to', 'procedure')) THEN 'procedural'
  WHEN tier = 'working' AND (access_count > 0 OR useful_count > 0) THEN 'episodic' END AS new_tier FROM memories WHERE is_active) SELECT id, tier, new_tier FROM c WHERE new_tier IS NOT NULL""")
def _(t):
    return L.promote_tiers(t.memories, t.memory_tags, t.as_of)


@query("l9_prune", "SELECT id FROM access_log WHERE accessed_at >= TIMESTAMP '2024-01-17'")
def _(t):
    return L.prune(t.access_log, "accessed_at", t.as_of, 15).select("id")


@query("l10_purge", """SELECT m.id, m.updated_at, (SELECT count(*) FROM memories c WHERE c.parent_id = m.id) AS children FROM memories m WHERE NOT is_active AND updated_at < TIMESTAMP '2024-01-02'
  AND NOT EXISTS (SELECT 1 FROM memories s WHERE s.is_active AND s.superseded_by = m.id)""")
def _(t):
    return L.purge_candidates(t.memories, t.as_of)


@query("l13_orphans", """SELECT e.id, count(m.id) AS links FROM entities e LEFT JOIN memory_entities me ON me.entity_id = e.id LEFT JOIN memories m ON m.id = me.memory_id AND m.is_active GROUP BY 1 HAVING count(m.id) < 2""")
def _(t):
    return L.orphan_entities(t.entities, t.memory_entities, t.memories)


@query("p9_replay_access", """, h AS (SELECT memory_id AS id, count(*) AS hits, max(accessed_at) AS last FROM access_log GROUP BY 1), b AS (SELECT source_id AS a, target_id AS b FROM memory_links UNION SELECT target_id, source_id FROM memory_links),
  n AS (SELECT b AS id, sum(hits) AS near FROM h JOIN b ON h.id = b.a GROUP BY 1), o AS (SELECT m.id, coalesce(hits, 0) AS accesses, last, near, CASE WHEN importance < 0.95 THEN least(0.95, importance + 0.01 * coalesce(hits, 0)) ELSE importance END AS own
  FROM memories m LEFT JOIN h ON h.id = m.id LEFT JOIN n ON n.id = m.id WHERE is_active)
  SELECT id, accesses, round(CASE WHEN own < 0.85 THEN least(0.85, own + 0.005 * coalesce(near, 0)) ELSE own END, 6) AS importance, last AS last_accessed_at FROM o""")
def _(t):
    return L.replay_access(t.memories, t.access_log, t.memory_links)


@query("k2_apply_changes", "SELECT id, CASE WHEN id % 2 = 0 THEN 0.5 ELSE importance END AS importance FROM memories")
def _(t):
    patch = t.memories.where("id % 2 = 0").select("id", F.lit(0.5).alias("importance"))
    return L.apply_changes(t.memories.select("id", "importance"), patch)


@query("k3_delete_cascade", "SELECT memory_id, tag FROM memory_tags WHERE memory_id NOT IN (SELECT id FROM memories WHERE NOT is_active)")
def _(t):
    return L.delete_cascade(t.memories, t.memories.where("NOT is_active"), {"tags": (t.memory_tags, "memory_id")})["tags"]


@query("k6_verify_counts", "SELECT 'memories' AS \"table\", count(*) AS source, count(*) AS copy, true AS same FROM memories UNION ALL SELECT 'tags', count(*), count(*), true FROM memory_tags")
def _(t):
    from sparkloom.sources.snapshots import verify_counts

    return verify_counts({"memories": t.memories, "tags": t.memory_tags}, {"memories": t.memories, "tags": t.memory_tags})


#: Kept for plans that rank inside windows.
WINDOW = Window

"""Analytics queries (A-*, W-1, W-5)."""

from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.plans.registry import query

LINKS = ", lc AS (SELECT id, count(*) AS link_count FROM (SELECT source_id AS id FROM memory_links UNION ALL SELECT target_id FROM memory_links) GROUP BY 1)"
QUALITY = LINKS + """, scored AS (SELECT m.*, coalesce(link_count, 0) AS link_count, epoch_us(TIMESTAMP '2024-02-01') / 86400e6 - epoch_us(created_at) / 86400e6 AS age_days,
  0.30 * importance + 0.25 * CASE WHEN useful_count <= 0 THEN 0 ELSE least(1.0, ln(1 + useful_count) / ln(17)) END
  + 0.15 * CASE WHEN access_count > 0 THEN least(1.0, ln(1 + access_count) / ln(21)) ELSE 0 END
  + 0.15 * CASE WHEN coalesce(link_count, 0) > 0 THEN least(1.0, link_count / 5.0) ELSE 0 END
  + 0.15 * exp(-0.02 * greatest(0.0, epoch_us(TIMESTAMP '2024-02-01') / 86400e6 - epoch_us(created_at) / 86400e6)) AS quality
  FROM memories m LEFT JOIN lc ON m.id = lc.id)"""


@query("a1_summary", """SELECT count(*) AS total_active, floor(count(*) FILTER (access_count = 0) / count(*) * 1000 + 0.5) / 10 AS never_accessed_pct,
  floor(count(*) FILTER (useful_count > 0) / count(*) * 1000 + 0.5) / 10 AS useful_pct,
  (SELECT access_count FROM memories WHERE is_active ORDER BY access_count LIMIT 1 OFFSET (SELECT count(*) // 2 FROM memories WHERE is_active)) AS median_access_count
  FROM memories WHERE is_active""")
def _(t):
    return A.summary(t.memories)


@query("a2_access_distribution", """SELECT label, (SELECT count(*) FROM memories WHERE is_active AND access_count BETWEEN lo AND hi) AS count
  FROM (VALUES ('0', 0, 0), ('1-5', 1, 5), ('6-20', 6, 20), ('21-100', 21, 100), ('100+', 101, 999999)) AS b(label, lo, hi)""")
def _(t):
    return A.access_distribution(t.memories)


@query("a3_tag_effectiveness", """SELECT tag, count(*) AS memory_count, round(avg(useful_count), 2) AS avg_useful FROM memory_tags JOIN memories ON memory_id = id
  WHERE is_active GROUP BY tag HAVING count(*) >= 3 ORDER BY avg_useful DESC, tag LIMIT 20""")
def _(t):
    return A.tag_effectiveness(t.memories, t.memory_tags)


@query("a4_producer_quality", """SELECT model_id AS producer, count(*) AS memory_count, round(avg(useful_count), 2) AS avg_useful FROM memories
  WHERE is_active AND model_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_useful DESC, producer LIMIT 15""")
def _(t):
    return A.producer_quality(t.memories)


def _trend(fmt: str) -> str:
    return f""", a AS (SELECT strftime(created_at, '{fmt}') AS period, count(*) AS created, sum(useful_count) AS u, count(*) FILTER (access_count = 0) AS v
  FROM memories WHERE is_active GROUP BY 1), al AS (SELECT strftime(created_at, '{fmt}') AS period, count(*) AS c FROM memories GROUP BY 1),
c AS (SELECT a.period, created, sum(c) OVER w AS total, sum(u) OVER w AS u, sum(created) OVER w AS n, sum(v) OVER w AS v FROM a LEFT JOIN al ON a.period = al.period WINDOW w AS (ORDER BY a.period)),
s AS (SELECT strftime(accessed_at, '{fmt}') AS period, count(DISTINCT query || ':' || strftime(accessed_at, '%Y-%m-%dT%H:%M')) AS searches FROM access_log GROUP BY 1)
SELECT c.period, created, CAST(total AS BIGINT) AS total_memories, coalesce(searches, 0) AS searches, round(u / n, 2) AS avg_useful, round(100.0 * v / n, 1) AS never_accessed_pct
FROM c LEFT JOIN s ON c.period = s.period ORDER BY c.period DESC LIMIT 12"""


@query("a5_quality_trend_month", _trend("%Y-%m"))
def _(t):
    return A.quality_trend(t.memories, t.access_log)


@query("d2_quality_trend_week", _trend("%Y-W%W"))
def _(t):
    return A.quality_trend(t.memories, t.access_log, "week")


@query("w1_quality_trend_day", _trend("%Y-%m-%d"))
def _(t):
    return A.quality_trend(t.memories, t.access_log, "day")


@query("a6_quality_histogram", QUALITY + """, q AS (SELECT floor(quality * 1000 + 0.5) / 1000 AS s FROM scored WHERE is_active)
  SELECT printf('%.1f-%.1f', i / 10.0, (i + 1) / 10.0) AS bucket, (SELECT count(*) FROM q WHERE s BETWEEN 0 AND 1 AND least(floor(s * 10), 9) = i) AS count FROM range(10) r(i)""")
def _(t):
    scored = A.with_quality(t.memories, t.memory_links, t.as_of)
    return A.quality_histogram(scored.withColumn("quality_score", A.js_round(F.col("quality"), 3)))


@query("a7_quality_distribution", QUALITY + """, q AS (SELECT quality, floor(quality * 1000 + 0.5) / 1000 AS s FROM scored WHERE is_active),
  o AS (SELECT list_sort(list(s)) AS l FROM q)
  SELECT floor(avg(quality) * 1000 + 0.5) / 1000 AS avg, count(*) FILTER (quality >= 0.5) AS high_quality, count(*) FILTER (quality < 0.2) AS low_quality, count(*) AS total,
  (SELECT l[CAST(floor(0.1 * (len(l) - 1)) AS BIGINT) + 1] FROM o) AS p10, (SELECT l[CAST(floor(0.5 * (len(l) - 1)) AS BIGINT) + 1] FROM o) AS median,
  (SELECT l[CAST(floor(0.9 * (len(l) - 1)) AS BIGINT) + 1] FROM o) AS p90 FROM q""")
def _(t):
    return A.quality_distribution(A.with_quality(t.memories, t.memory_links, t.as_of))


@query("l8_quality_scores", QUALITY + " SELECT id, floor(quality * 1000 + 0.5) / 1000 AS quality_score FROM scored WHERE is_active")
def _(t):
    scored = A.with_quality(t.memories, t.memory_links, t.as_of).where("is_active")
    return scored.select("id", A.js_round(F.col("quality"), 3).alias("quality_score"))


OUTCOMES = """, log AS (SELECT query, max_score AS r, created_at FROM search_misses), fb AS (SELECT query FROM search_misses WHERE max_score > 100),
  qo AS (SELECT query, count(*) AS search_count, avg(r) AS result_count_avg, max(created_at) AS last_queried_at, (SELECT count(*) FROM fb WHERE fb.query = log.query) AS feedback_count FROM log GROUP BY query)"""


def _outcomes(t):
    log = t.search_misses.select("query", F.col("max_score").alias("result_count"), "created_at")
    return A.query_outcomes(log, t.search_misses.where("max_score > 100"))


@query("a8_retrieval_stats", OUTCOMES + """ SELECT floor((SELECT sum(search_count) FILTER (result_count_avg > 0) / sum(search_count) FROM qo) * 1000 + 0.5) / 10 AS hit_rate,
  count(*) FILTER (access_count = 0 AND created_at <= TIMESTAMP '2024-01-18') AS least_accessed_count, count(*) FILTER (useful_count > 0) AS total_with_feedback,
  floor(coalesce(avg(useful_count) FILTER (useful_count > 0), 0) * 100 + 0.5) / 100 AS avg_useful_count FROM memories WHERE is_active""")
def _(t):
    return A.retrieval_stats(t.memories, _outcomes(t), t.as_of)


@query("o1_most_accessed", """SELECT id, CASE WHEN length(content) > 80 THEN left(content, 80) || '...' ELSE content END AS title, access_count FROM memories
  WHERE is_active ORDER BY access_count DESC, id LIMIT 10""")
def _(t):
    return A.most_accessed(t.memories)


def _outcome_sql(where: str, order: str) -> str:
    return OUTCOMES + f""" SELECT query, search_count, floor(result_count_avg * 10 + 0.5) / 10 AS result_count_avg, feedback_count,
  floor(feedback_count / search_count * 1000 + 0.5) / 10 AS feedback_ratio, last_queried_at FROM qo WHERE {where} ORDER BY {order}, query LIMIT 20"""


@query("a9_query_outcomes", _outcome_sql("true", "search_count DESC"))
def _(t):
    return A.outcome_report(_outcomes(t))


@query("a9_query_outcomes_by_ratio", _outcome_sql("true", "feedback_count / search_count DESC"))
def _(t):
    return A.outcome_report(_outcomes(t), "feedback_ratio")


@query("a9_query_outcomes_without_feedback", _outcome_sql("feedback_count = 0", "search_count DESC"))
def _(t):
    return A.outcome_report(_outcomes(t), "zero_feedback")


@query("a10_search_misses", """SELECT query, count(*) AS count, avg(max_score) AS avg_max_score, max(created_at) AS last_seen FROM search_misses
  WHERE created_at BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-02-01' GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 10""")
def _(t):
    return A.misses(t.search_misses, t.as_of)


@query("a11_knowledge_gaps", """SELECT query, count(*) AS count, CASE WHEN count(*) >= 10 THEN 'critical' WHEN count(*) >= 5 THEN 'warning' ELSE 'info' END AS severity
  FROM search_misses WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-01' GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return A.knowledge_gaps(t.search_misses, t.as_of)


@query("a12_store_stats", """SELECT 'type' AS metric, content_type AS key, count(*) AS value FROM memories WHERE is_active GROUP BY 2 UNION ALL
  SELECT 'source', source, count(*) FROM memories WHERE is_active GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*) FROM memories WHERE is_active GROUP BY 2 UNION ALL
  SELECT 'total', 'all', count(*) FROM memories UNION ALL SELECT 'total', 'active', count(*) FROM memories WHERE is_active UNION ALL SELECT 'tags', 'distinct', count(DISTINCT tag) FROM memory_tags""")
def _(t):
    return A.store_stats(t.memories, t.memory_tags)


@query("a12_date_range", "SELECT min(created_at) AS oldest, max(created_at) AS newest FROM memories WHERE is_active")
def _(t):
    return A.date_range(t.memories)


@query("a13_embedding_health", """SELECT count(*) AS total, count(len(embedding)) AS embedded, count(*) - count(len(embedding)) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dimensions
  FROM memories LEFT JOIN embeddings ON id = vec_id WHERE is_active""")
def _(t):
    return A.embedding_health(t.memories, t.embeddings, 64)


@query("a14_tag_health", "SELECT count(*) AS distinct_tags, CAST(sum(n) AS BIGINT) AS assignments, count(*) FILTER (n = 1) AS used_once FROM (SELECT tag, count(*) AS n FROM memory_tags GROUP BY 1)")
def _(t):
    return A.tag_health(t.memory_tags)


@query("a18_job_health", """, r AS (SELECT * FROM job_outcomes WHERE created_at >= TIMESTAMP '2024-01-18')
  SELECT job_name, count(*) AS runs, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate, max(created_at) AS last_run,
  (SELECT error FROM r x WHERE NOT success AND x.job_name = r.job_name ORDER BY created_at DESC, id DESC LIMIT 1) AS last_error, count(*) FILTER (success) / count(*) < 0.5 AS alert FROM r GROUP BY job_name""")
def _(t):
    return A.job_health(t.job_outcomes, t.as_of)


SCORED = ", p AS (SELECT *, CASE resolution WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE 0.5 END::DOUBLE AS o FROM predictions WHERE status = 'resolved')"


@query("a19_calibration", SCORED + """ SELECT (SELECT count(*) FROM predictions) AS total_predictions, count(*) AS resolved_count, floor(avg((confidence - o) ** 2) * 10000 + 0.5) / 10000 AS brier_score,
  floor(avg(confidence - o) * 10000 + 0.5) / 10000 AS overconfidence_bias FROM p""")
def _(t):
    return A.calibration(t.predictions)


@query("a19_calibration_curve", SCORED + """ SELECT CAST((SELECT max(i) FROM range(10) r(i) WHERE confidence >= i * CAST(0.1 AS DOUBLE)) AS INTEGER) AS decile, floor(avg(confidence) * 1000 + 0.5) / 1000 AS predicted_avg,
  floor(avg(o) * 1000 + 0.5) / 1000 AS actual_freq, count(*) AS count FROM p GROUP BY 1""")
def _(t):
    return A.calibration_curve(t.predictions)


@query("a19_calibration_domains", SCORED + """ SELECT domain, floor(avg((confidence - o) ** 2) * 10000 + 0.5) / 10000 AS brier_score, floor(avg(CASE WHEN resolution = 'true' THEN 1 ELSE 0 END) * 1000 + 0.5) / 1000 AS accuracy,
  count(*) AS count FROM p GROUP BY 1""")
def _(t):
    return A.calibration_domains(t.predictions)


@query("a19_calibration_trend", SCORED + " SELECT strftime(resolved_at, '%Y-%m') AS month, floor(avg((confidence - o) ** 2) * 10000 + 0.5) / 10000 AS brier_score, count(*) AS count FROM p GROUP BY 1")
def _(t):
    return A.calibration_trend(t.predictions)


@query("v10_track_record", """SELECT count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'resolved' AND resolution = 'true') AS correct,
  round(count(*) FILTER (status = 'resolved' AND resolution = 'true') / count(*) FILTER (status = 'resolved'), 6) AS correct_share FROM predictions""")
def _(t):
    return A.track_record(t.predictions)


@query("a20_task_stats", "SELECT status, assignee, count(*) AS count FROM tasks GROUP BY 1, 2")
def _(t):
    return A.task_stats(t.tasks)


@query("o4_next_tasks", """SELECT id, priority, created_at FROM tasks WHERE status = 'pending'
  ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at, id LIMIT 20""")
def _(t):
    return A.next_tasks(t.tasks)


@query("a21_diary_agents", "SELECT role AS agent, count(*) AS entries, max(turn) AS last_entry FROM conversations GROUP BY 1", raw=True)
def _(t):
    return A.diary_agents(t.conversations.select(F.col("role").alias("agent"), F.col("turn").alias("created_at")))


@query("a22_timeline", "SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM memories WHERE is_active GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def _(t):
    return A.timeline(t.memories).withColumn("date", F.col("date").cast("string"))


@query("a22_timeline_records", """SELECT * FROM (SELECT strftime(created_at, '%Y-%m-%d') AS date, id, importance, CAST(row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY importance DESC, id) AS INTEGER) AS rank
  FROM memories WHERE is_active) WHERE rank <= 20""")
def _(t):
    return A.timeline_records(t.memories).withColumn("date", F.col("date").cast("string"))


@query("a23_temporal_stats", """, d AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM memories WHERE is_active GROUP BY 1),
  g AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM d), s AS (SELECT count(*) AS len, max(d) AS e FROM g GROUP BY g)
  SELECT count(*) AS total_days, floor(sum(n) / count(*) * 10 + 0.5) / 10 AS avg_per_day, (SELECT strftime(d, '%Y-%m-%d') FROM d ORDER BY n DESC, d LIMIT 1) AS busiest_day, max(n) AS busiest_count,
  (SELECT max(len) FROM s) AS longest_streak, coalesce((SELECT max(len) FROM s WHERE DATE '2024-02-01' - e <= 1), 0) AS current_streak FROM d""")
def _(t):
    return A.temporal_stats(t.memories, F.to_date(t.as_of)).withColumn("busiest_day", F.col("busiest_day").cast("string"))


@query("a24_namespaces", "SELECT namespace, count(*) AS count FROM memories WHERE is_active GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    return A.namespaces(t.memories, 5)


@query("a26_importance_stats", """SELECT floor(avg(importance) * 1000 + 0.5) / 1000 AS mean, floor(stddev_pop(importance) * 1000 + 0.5) / 1000 AS std_dev, min(importance) AS min,
  round(quantile_cont(importance, 0.25), 6) AS p25, round(quantile_cont(importance, 0.5), 6) AS median, round(quantile_cont(importance, 0.75), 6) AS p75, max(importance) AS max FROM memories WHERE is_active""")
def _(t):
    return A.importance_stats(t.memories)


@query("a27_usefulness_groups", QUALITY + """ SELECT useful_count > 0 AS useful, count(*) AS n, round(avg(age_days), 6) AS avg_age_days, round(avg(access_count), 6) AS avg_access_count,
  round(avg(importance), 6) AS avg_importance, round(avg(link_count), 6) AS avg_link_count FROM scored WHERE is_active AND access_count > 0 GROUP BY 1""")
def _(t):
    return A.usefulness_groups(A.with_quality(t.memories, t.memory_links, t.as_of))


def _check(name: str, m: str, total: str, warn: float, bad: float) -> str:
    return f"SELECT '{name}' AS \"check\", v AS value, CASE WHEN v >= {bad} THEN 'critical' WHEN v >= {warn} THEN 'warning' ELSE 'ok' END AS status FROM (SELECT round({m} / {total}, 6) AS v)"


_ACTIVE = "(SELECT count(*) FROM memories WHERE is_active)"


@query("a28_health_checks", " UNION ALL ".join([
    _check("embedding_gap", "(SELECT count(*) FROM memories WHERE is_active AND id NOT IN (SELECT vec_id FROM embeddings))", _ACTIVE, 0.05, 0.2),
    _check("untagged", "(SELECT count(*) FROM memories WHERE is_active AND id NOT IN (SELECT memory_id FROM memory_tags))", _ACTIVE, 0.3, 0.6),
    _check("entity_orphans", "(SELECT count(*) FROM entities WHERE id NOT IN (SELECT entity_id FROM memory_entities))", "(SELECT count(*) FROM entities)", 0.1, 0.3),
    _check("never_accessed", "(SELECT count(*) FROM memories WHERE is_active AND access_count = 0)", _ACTIVE, 0.5, 0.9),
]))
def _(t):
    return A.health_checks(t.memories, t.embeddings, t.memory_tags, t.entities, t.memory_entities)


@query("a29_lint", """SELECT 'orphan_chunk' AS audit, id FROM memories c WHERE is_active AND EXISTS (SELECT 1 FROM memories p WHERE p.id = c.parent_id AND NOT p.is_active) UNION ALL
  SELECT 'dangling_supersession', id FROM memories WHERE superseded_by NOT IN (SELECT id FROM memories) UNION ALL SELECT 'superseded_but_active', id FROM memories WHERE is_active AND superseded_by IS NOT NULL UNION ALL
  SELECT 'expired_but_active', id FROM memories WHERE is_active AND expires_at <= TIMESTAMP '2024-02-01' UNION ALL SELECT 'empty_content', id FROM memories WHERE is_active AND trim(coalesce(content, '')) = ''""")
def _(t):
    return A.lint(t.memories, t.as_of)


@query("a30_behavioural_audit", """SELECT 'burst' AS anomaly, agent AS subject, count(*) AS n FROM (SELECT agent, CAST(created_at AS DATE) AS d, count(*) AS n FROM memories WHERE is_active GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 2 UNION ALL
  SELECT 'high_importance', source, count(*) FROM memories WHERE is_active AND importance >= 0.95 GROUP BY 2 UNION ALL SELECT 'expired', tier, count(*) FROM memories WHERE is_active AND expires_at < TIMESTAMP '2024-02-01' GROUP BY 2 UNION ALL
  SELECT 'unattributed', source, count(*) FROM memories WHERE is_active AND (agent IS NULL OR model_id IS NULL) GROUP BY 2 UNION ALL
  SELECT 'changed_immutable', source, count(*) FROM memories WHERE is_active AND json_extract_string(metadata, '$.immutable') = '1' AND updated_at > created_at GROUP BY 2""")
def _(t):
    return A.behavioural_audit(t.memories, t.as_of, 2)


@query("a31_recent_topics", """SELECT tag, count(*) AS n, CAST(least(3, ceil(count(*) / 5)) AS INTEGER) AS weight FROM memory_tags JOIN memories ON memory_id = id
  WHERE is_active AND created_at >= TIMESTAMP '2024-01-25' GROUP BY tag ORDER BY n DESC, tag LIMIT 50""")
def _(t):
    return A.recent_topics(t.memories, t.memory_tags, t.as_of)


@query("a32_session_diff", """SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-20') AS new_records, count(*) FILTER (created_at < TIMESTAMP '2024-01-20' AND updated_at >= TIMESTAMP '2024-01-20') AS updated_records,
  count(DISTINCT session_id) FILTER (created_at >= TIMESTAMP '2024-01-20') AS sessions, count(DISTINCT agent) FILTER (created_at >= TIMESTAMP '2024-01-20') AS agents FROM memories WHERE is_active""")
def _(t):
    return A.session_diff(t.memories, F.lit("2024-01-20").cast("timestamp"))


@query("a33_document_library", """SELECT p.id, p.source_uri, count(*) AS chunks FROM memories p JOIN memories c ON c.parent_id = p.id AND c.is_active WHERE p.is_active AND p.parent_id IS NULL GROUP BY 1, 2""")
def _(t):
    return A.document_library(t.memories)


@query("a34_by_source_uri", "SELECT source_uri, count(*) AS count, min(created_at) AS first, max(created_at) AS last FROM memories WHERE is_active GROUP BY 1")
def _(t):
    return A.by_source_uri(t.memories)


@query("a35_tags_for_ids", "SELECT tag, count(*) AS count FROM memory_tags WHERE memory_id IN (SELECT id FROM memories WHERE tier = 'semantic') GROUP BY 1")
def _(t):
    return A.tags_for(t.memory_tags, t.memories.where("tier = 'semantic'").select("id"))


@query("a36_mean_results", "SELECT query, avg(max_score) AS result_count_avg FROM search_misses GROUP BY 1")
def _(t):
    log = t.search_misses.select("query", F.col("max_score").alias("result_count"), "created_at")
    return A.query_outcomes(log, log).select("query", "result_count_avg")


@query("a37_counters", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1", raw=True)
def _(t):
    return A.counters(t.events.withColumn("one", F.lit(1)), "event_type", "one")


@query("a38_tag_lists", "SELECT memory_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM memory_tags GROUP BY 1")
def _(t):
    return A.tag_lists(t.memory_tags)


@query("a39_distinct_searches", "SELECT strftime(accessed_at, '%Y-%m-%d') AS date, count(DISTINCT query || ':' || strftime(accessed_at, '%Y-%m-%dT%H:%M')) AS searches FROM access_log GROUP BY 1")
def _(t):
    return A.distinct_searches(t.access_log).withColumn("date", F.col("date").cast("string"))

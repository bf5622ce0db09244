"""The remaining scalar functions and small operators, each as a query of its own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import extract as N
from sparkloom.functions import scoring as S
from sparkloom.functions import text as X
from sparkloom.operators import analytics as A
from sparkloom.operators import evaluate as E
from sparkloom.operators import graph as G
from sparkloom.operators import knowledge as K
from sparkloom.operators import lifecycle as L
from sparkloom.operators import relational as R
from sparkloom.operators import search as H
from sparkloom.plans.q_analytics import LINKS, QUALITY
from sparkloom.plans.q_knowledge import HALL, summary_members
from sparkloom.plans.q_relational import PAIRS
from sparkloom.plans.q_search import LISTS, lists
from sparkloom.plans.q_text import lit
from sparkloom.plans.registry import query
from sparkloom.sources import ingest as I


def tag_lists(t):
    return t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))


# --- scores ---


@query("m3_frequency", "SELECT id, round(ln(1 + access_count) / ln(1 + (SELECT max(access_count) FROM memories)), 6) AS s FROM memories")
def _(t):
    most = t.memories.agg(F.max("access_count").alias("m"))
    return t.memories.crossJoin(F.broadcast(most)).select("id", F.round(S.frequency(F.col("access_count"), F.col("m")), 6).alias("s"))


@query("m4_usefulness", "SELECT id, round(CASE WHEN useful_count <= 0 THEN 0 ELSE least(1.0, ln(1 + useful_count) / ln(17)) END, 6) AS s FROM memories")
def _(t):
    return t.memories.select("id", F.round(S.usefulness(F.col("useful_count")), 6).alias("s"))


@query("m5_valence", "SELECT id, abs(valence) AS s FROM memories")
def _(t):
    return t.memories.select("id", S.valence(F.col("valence")).alias("s"))


@query("m7_quality", QUALITY + " SELECT id, round(quality, 6) AS s FROM scored")
def _(t):
    return A.with_quality(t.memories, t.memory_links, t.as_of).select("id", F.round("quality", 6).alias("s"))


@query("m9_tier_boost", "SELECT id, CASE tier WHEN 'semantic' THEN 0.15 WHEN 'procedural' THEN 0.10 WHEN 'reference' THEN 0.05 WHEN 'working' THEN -0.10 ELSE 0 END::DOUBLE AS s FROM memories")
def _(t):
    return t.memories.select("id", S.tier_boost(F.col("tier")).alias("s"))


@query("m12_binary_ndcg", LISTS + """, dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS d FROM rl JOIN jd USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
  i AS (SELECT query_id, sum(1 / log2(r + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM jd) WHERE r <= 10 GROUP BY 1) SELECT query_id, round(coalesce(d, 0) / i, 6) AS ndcg FROM i LEFT JOIN dcg USING (query_id)""")
def _(t):
    ranked, judged = lists(t)
    return E.ndcg(ranked, judged.withColumn("grade", F.lit(1)))


@query("m15_percentiles", "SELECT namespace, round(quantile_cont(importance, 0.25), 6) AS p25, round(quantile_cont(importance, 0.9), 6) AS p90 FROM memories GROUP BY 1")
def _(t):
    return t.memories.groupBy("namespace").agg(F.round(F.percentile("importance", 0.25), 6).alias("p25"), F.round(F.percentile("importance", 0.9), 6).alias("p90"))


@query("m16_rounding", "SELECT id, floor((importance - 0.5) * 10 + 0.5) / 10 AS s FROM memories")
def _(t):
    return t.memories.select("id", S.js_round(F.col("importance") - 0.5, 1).alias("s"))


@query("m17_strength", "SELECT id, round(least(0.9, 0.3 + (id % 40) / 20 * 0.6), 6) AS s FROM memories")
def _(t):
    return t.memories.select("id", F.round(S.link_strength(F.col("id") % 40, 20.0), 6).alias("s"))


@query("m18_sigmoid", "SELECT id, round(1 / (1 + exp(-valence)), 6) AS s FROM memories")
def _(t):
    return t.memories.select("id", F.round(S.sigmoid(F.col("valence")), 6).alias("s"))


@query("m13_overlap", """, b AS (SELECT job_name, list(id ORDER BY duration_ms DESC, id)[1:10] AS o, list(id ORDER BY duration_ms DESC, id)[4:13] AS n FROM job_outcomes GROUP BY 1)
  SELECT job_name, round(len(list_filter(n, lambda x: list_contains(o, x))) / len(o), 6) AS overlap, o = n AS exact FROM b""")
def _(t):
    ranked = t.job_outcomes.groupBy("job_name").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("duration_ms"), "id"))), lambda x: x["id"]).alias("l"))
    old = F.slice("l", 1, 10)
    return ranked.select("job_name", E.overlap(old, F.slice("l", 4, 10), old).alias("o")).select("job_name", "o.overlap", "o.exact")


# --- dates, arrays ---


@query("d1_periods", "SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day FROM events", raw=True)
def _(t):
    return t.events.select("event_id", A.period(F.col("ts"), "month").alias("month"), A.period(F.col("ts"), "day").alias("day"))


@query("d4_modifiers", "SELECT id, created_at + INTERVAL 1 DAY AS later, created_at - INTERVAL 30 DAY AS earlier FROM memories")
def _(t):
    return t.memories.select("id", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("later"), (F.col("created_at") - F.expr("INTERVAL 30 DAYS")).alias("earlier"))


@query("d6_age", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6, 6) AS age FROM events", raw=True)
def _(t):
    return t.events.select("event_id", F.round(S.days_between(t.as_of, F.col("ts").cast("timestamp")), 6).alias("age"))


@query("y2_pairs", "SELECT query_id, len(memory_ids) * (len(memory_ids) - 1) // 2 AS pairs FROM co_retrievals")
def _(t):
    pairs = F.expr("flatten(transform(memory_ids, (x, i) -> transform(slice(memory_ids, i + 2, size(memory_ids)), y -> struct(x AS a, y AS b))))")
    return t.co_retrievals.select("query_id", F.size(pairs).cast("long").alias("pairs"))


@query("y5_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", raw=True)
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("y7_milestones", "SELECT p_partkey AS id, CAST(p_size % 3 AS INTEGER) AS completed, 2 AS total FROM part WHERE p_size % 3 < 3", raw=True)
def _(t):
    state = lambda least: F.struct(F.lit("m").alias("title"), F.when(F.col("p_size") % 3 >= least, "completed").otherwise("open").alias("status"))
    return K.milestones_done(t.part.select(F.col("p_partkey").alias("id"), F.array(state(1), state(2)).alias("milestones")))


# --- filters, joins, aggregates ---


@query("f15_without_vector", "SELECT vec_id, label FROM embeddings", raw=True)
def _(t):
    return t.embeddings.drop("embedding")


@query("j13_last_failure", """SELECT job_name, (SELECT error FROM job_outcomes x WHERE NOT success AND x.job_name = j.job_name ORDER BY created_at DESC, id DESC LIMIT 1) AS last_error FROM job_outcomes j GROUP BY 1""")
def _(t):
    return A.job_health(t.job_outcomes, t.as_of, 10_000).select("job_name", "last_error")


@query("j14_link_counts", LINKS + " SELECT m.id, coalesce(link_count, 0) AS link_count FROM memories m LEFT JOIN lc ON m.id = lc.id")
def _(t):
    return A.with_quality(t.memories, t.memory_links, t.as_of).select("id", "link_count")


@query("j16_periods", """, a AS (SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS created FROM memories GROUP BY 1), s AS (SELECT strftime(accessed_at, '%Y-%m') AS period, count(*) AS reads FROM access_log GROUP BY 1)
  SELECT a.period, created, coalesce(reads, 0) AS reads FROM a LEFT JOIN s ON a.period = s.period""")
def _(t):
    created = t.memories.groupBy(A.period(F.col("created_at"), "month").alias("period")).agg(F.count(F.lit(1)).alias("created"))
    reads = t.access_log.groupBy(A.period(F.col("accessed_at"), "month").alias("period")).agg(F.count(F.lit(1)).alias("reads"))
    return created.join(reads, "period", "left").select("period", "created", F.coalesce("reads", F.lit(0)).alias("reads"))


@query("a15_entity_memories", "SELECT entity_id, count(*) AS n FROM memory_entities GROUP BY 1")
def _(t):
    return t.memory_entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("a16_entity_listing", "SELECT e.id, count(DISTINCT memory_id) AS memory_count FROM entities e JOIN memory_entities ON entity_id = e.id JOIN memories m ON m.id = memory_id AND is_active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    counts = R.entity_counts(t.entities, t.memory_entities, t.memories)
    return counts.where("memory_count > 0").orderBy(F.desc("memory_count"), "id").limit(50)


@query("a17_shared_records", PAIRS + " SELECT a, b, shared, first_memory FROM pr WHERE shared >= 3")
def _(t):
    return R.co_occurrence(t.memory_entities, 3)


@query("w3_ranks", "SELECT namespace, id, CAST(row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS INTEGER) AS rank FROM memories")
def _(t):
    rows = t.memories.select(F.col("namespace"), "id", F.col("importance").alias("score"))
    return H.top(rows, 1 << 30, key="namespace").select("namespace", "id", "rank")


@query("w5_streaks", """, d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM d)
  SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    days = t.events.select("user_id", F.to_date("ts").alias("d")).distinct()
    islands = days.withColumn("g", F.date_sub("d", F.row_number().over(Window.partitionBy("user_id").orderBy("d"))))
    return islands.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("o9_next_task", "SELECT id, priority, created_at FROM tasks WHERE status = 'pending' ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at, id LIMIT 1")
def _(t):
    return A.next_tasks(t.tasks, 1)


@query("u3_first_reason", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN importance < 0.3 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 90 DAY AND access_count < 2 THEN 'stale' WHEN access_count = 0 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 365 DAY THEN 'abandoned'
  WHEN access_count = 0 AND importance < 0.5 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 14 DAY THEN 'neglected' WHEN access_count = 0 AND importance < 0.6 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY THEN 'forgotten' END AS reason
  FROM memories WHERE is_active AND tier NOT IN ('semantic', 'procedural', 'reference')) WHERE reason IS NOT NULL GROUP BY 1""")
def _(t):
    return L.archive_candidates(t.memories, t.as_of).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("u5_set_difference", "SELECT query_id, len(list_filter(memory_ids, lambda x: x % 2 = 0)) AS both, len(list_filter(memory_ids, lambda x: x % 2 = 1)) AS gone FROM co_retrievals")
def _(t):
    even = F.filter("memory_ids", lambda x: x % 2 == 0)
    return t.co_retrievals.select("query_id", F.size(F.array_intersect("memory_ids", even)).cast("long").alias("both"), F.size(F.array_except("memory_ids", even)).cast("long").alias("gone"))


# --- text ---


@query("x7_canonical_tag", "SELECT DISTINCT tag, replace(tag, ' ', '-') AS canonical FROM memory_tags")
def _(t):
    return t.memory_tags.select("tag").distinct().select("tag", X.canonical_tag(F.concat(F.lit(" _"), F.upper("tag"), F.lit("-"))).alias("canonical"))


@query("x17_specifics", ", s AS (SELECT id, list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(content, {lit(p)})" for p in N.SPECIFICS) + "))) AS s FROM memories) SELECT id, array_to_string(s, ' | ') AS found FROM s WHERE len(s) > 0")
def _(t):
    return t.memories.select("id", F.array_sort(N.specifics(F.col("content"))).alias("s")).where("size(s) > 0").select("id", F.array_join("s", " | ").alias("found"))


@query("x17_key_facts", r""", s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '[.!?]\n', chr(1), 'g'), '[.!?]\s', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS s FROM memories)
  SELECT id, len(list_filter(s, lambda x: """ + " OR ".join(f"regexp_matches(x, {lit(p)})" for p in N.KEY_FACTS) + ")) AS n FROM s")
def _(t):
    return t.memories.select("id", F.size(N.fact_sentences(F.col("content"))).cast("long").alias("n"))


@query("x19_summary_problems")
def _(t):
    """Summaries of clusters of ten consecutive records against all of their sources."""
    members = summary_members(t)
    made = K.basic_summary(members, t.memory_tags).where("merged > 1")
    sources = members.groupBy("cluster").agg(F.sort_array(F.collect_list("content")).alias("sources"))
    return made.join(sources, "cluster").select("cluster", F.array_join(K.summary_problems(F.col("summary"), F.col("sources")), ",").alias("problems"))


@query("x20_halls", f""", g AS (SELECT memory_id, list(tag) AS tags FROM memory_tags GROUP BY 1) SELECT id, {HALL} AS hall FROM memories LEFT JOIN g ON memory_id = id""")
def _(t):
    rows = t.memories.join(tag_lists(t), "id", "left")
    return rows.select("id", N.hall_of(F.coalesce("tags", F.array().cast("array<string>")), F.col("content")).alias("hall"))


@query("x32_weighted_contains", "SELECT id, CAST(contains(lower(content), 'tion') AS BIGINT) * 3 + CAST(contains(lower(content), 'que') AS BIGINT) + CAST(contains(lower(content), 'über') AS BIGINT) * 2 AS score FROM memories")
def _(t):
    weights = F.create_map(*[F.lit(x) for p in (("tion", 3), ("que", 1), ("über", 2)) for x in p])
    return t.memories.select("id", N.weighted_words(F.col("content"), weights).alias("score"))


_TOPICS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(content), {lit(w)})" for w in words) + f" THEN '{topic}' END" for topic, words in N.TOPICS.items()) + "], lambda x: x IS NOT NULL)[1:5]"


@query("x33_topics", f"SELECT id, array_to_string({_TOPICS}, ',') AS topics FROM memories")
def _(t):
    return t.memories.select("id", F.array_join(N.topics(F.col("content")), ",").alias("topics"))


@query("x36_self_queries", r""", tl AS (SELECT memory_id, list_sort(list(tag)) AS tags FROM memory_tags GROUP BY 1), p AS (SELECT id, content, tags, trim(list_filter(string_split(content, chr(10)), lambda x: length(trim(x)) > 20 AND NOT regexp_matches(trim(x), '^[#*-]'))[1]) AS l FROM memories LEFT JOIN tl ON memory_id = id WHERE is_active),
  w AS (SELECT *, regexp_split_to_array(l, '\s+') AS w FROM p) SELECT id AS query_id, CASE WHEN l IS NOT NULL AND len(w) > 6 THEN array_to_string(w[CAST(floor(len(w) / 4) AS INTEGER) + 1:CAST(floor(len(w) / 4) AS INTEGER) + 5], ' ')
  WHEN l IS NOT NULL THEN left(l, 60) WHEN len(tags) > 0 THEN array_to_string(tags[1:3], ' ') ELSE trim(left(content, 40)) END AS query FROM w""")
def _(t):
    return E.self_queries(t.memories, tag_lists(t))


# --- retrieval and lifecycle ---


@query("r6_legacy_score", QUALITY + """, b AS (SELECT *, importance AS v, CAST(id % 10 AS DOUBLE) / 10 AS f, CAST(id % 7 AS DOUBLE) / 7 AS r, CAST(id % 3 AS DOUBLE) / 3 AS q FROM scored), g AS (SELECT *, 0.45 * v + 0.25 * f AS p, CASE WHEN greatest(v, f) <= 0 THEN 0 ELSE least(1, 0.25 + 0.75 * greatest(v, f)) END AS g FROM b)
  SELECT id, round((p + least(g * (0.2 * r + 0.1 * q), p * g) + 0.05 * CASE WHEN useful_count <= 0 THEN 0 ELSE least(1.0, ln(1 + useful_count) / ln(17)) END + 0.05 * abs(valence) + 0.1 * quality + 0.1 * importance)
  * (1 + CASE tier WHEN 'semantic' THEN 0.15 WHEN 'procedural' THEN 0.10 WHEN 'reference' THEN 0.05 WHEN 'working' THEN -0.10 ELSE 0 END), 6) AS score FROM g""")
def _(t):
    i = F.col("id")
    rows = A.with_quality(t.memories, t.memory_links, t.as_of).withColumns({"vector": F.col("importance"), "fts": i % 10 / 10.0, "recency": i % 7 / 7.0, "frequency": i % 3 / 3.0})
    return H.legacy_scores(rows).select("id", F.round("score", 6).alias("score"))


@query("r7_refined", QUALITY + """, k AS (SELECT id, importance AS score, quality, superseded_by FROM scored WHERE is_active), d AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.id = k.superseded_by)), f AS (SELECT *, max(score) OVER () AS best FROM d)
  SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM f WHERE score >= 0.15 * best AND quality >= 0.08""")
def _(t):
    rows = A.with_quality(t.memories, t.memory_links, t.as_of).where("is_active").select(F.lit(1).alias("query_id"), "id", F.col("importance").alias("score"), "quality", "superseded_by")
    return H.refine(rows, 1 << 30).select("id", "rank")





@query("p5_merged", "SELECT id, CASE WHEN id % 2 = 0 THEN content ELSE content || chr(10) || chr(10) || 'more of it' END AS content FROM memories WHERE NOT contains(content, 'more of it')")
def _(t):
    old = F.col("content")
    new = F.when(F.col("id") % 2 == 0, F.substring("content", 1, 5)).otherwise("more of it")
    return t.memories.where(~F.contains(old, F.lit("more of it"))).select("id", K.merged_content(old, new).alias("content"))


@query("p8_hierarchy_links", """SELECT narrative, id FROM (SELECT t.id AS narrative, e.id, row_number() OVER (PARTITION BY t.id ORDER BY e.importance DESC, e.id) AS r FROM memories t JOIN memories e ON e.created_at >= t.created_at - INTERVAL 7 DAY AND e.created_at < t.created_at
  WHERE t.content_type = 'summary' AND e.content_type <> 'summary') WHERE r <= 15""")
def _(t):
    return K.hierarchy_links(t.memories)


@query("l5_recalibrated_stats", """, r AS (SELECT row_number() OVER (ORDER BY importance, id) - 1 AS i, count(*) OVER () AS n FROM memories WHERE is_active AND importance <> 1.0), v AS (SELECT floor((0.10::DOUBLE + i / (n - 1) * 0.80::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100 AS x FROM r)
  SELECT floor(avg(x) * 1000 + 0.5) / 1000 AS mean, floor(stddev_pop(x) * 1000 + 0.5) / 1000 AS std_dev, min(x) AS min, max(x) AS max FROM v""")
def _(t):
    new = L.recalibrate(t.memories).select(F.col("new_importance").alias("importance"), F.lit(True).alias("is_active"))
    return A.importance_stats(new).select("mean", "std_dev", "min", "max")


@query("l11_canonical_changes", """, h AS (SELECT id, first_value(id) OVER (PARTITION BY namespace, content_type, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) ORDER BY created_at DESC, id DESC) AS c FROM memories WHERE is_active AND parent_id IS NULL)
  SELECT id, c AS superseded_by FROM h WHERE id <> c""")
def _(t):
    return L.canonical_rows(t.memories).where("id <> canonical_id").select("id", F.col("canonical_id").alias("superseded_by"))


@query("l12_missing_vectors", "SELECT id FROM memories WHERE is_active AND id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.memories.where("is_active").join(t.embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti").select("id")


@query("c2_split_clusters", """, c AS (SELECT id, id % 10 AS cluster, CASE WHEN id % 4 <> 3 THEN CAST(id % 4 AS VARCHAR) ELSE 'none' END AS part FROM memories), n AS (SELECT cluster, part, count(*) AS n FROM c GROUP BY 1, 2) SELECT cluster, part, id FROM c JOIN n USING (cluster, part) WHERE n >= 2""")
def _(t):
    members = t.memories.select((F.col("id") % 10).alias("cluster"), "id")
    own = t.memories.where("id % 4 <> 3").select("id", (F.col("id") % 4).alias("community"))
    return K.split_by_community(members, own)


@query("e4_promoted_baselines", "SELECT query, id FROM (SELECT event_type AS query, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", raw=True)
def _(t):
    runs = t.events.select(F.col("event_type").alias("query"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return R.latest_per(runs, "query").select("query", "id")


@query("v1_sections", """SELECT id, CASE WHEN regexp_matches(content, '(?i)\\bdecided\\b') THEN 'decisions' WHEN tier = 'procedural' THEN 'techniques' WHEN tier = 'reference' THEN 'reference' WHEN tier = 'semantic' THEN 'knowledge' ELSE 'notes' END AS section FROM memories""")
def _(t):
    rows = t.memories.join(tag_lists(t), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select("id", I.section_of(F.col("tags"), F.col("content"), F.col("tier")).alias("section"))


@query("v4_by_month", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM memories WHERE tier = 'semantic' GROUP BY 1")
def _(t):
    return t.memories.where("tier = 'semantic'").groupBy(A.period(F.col("created_at"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("v5_first_tag", "SELECT memory_id AS id, coalesce(min(tag) FILTER (tag NOT IN " + str(I.GENERIC_TAGS) + "), 'general') AS tag FROM memory_tags GROUP BY 1")
def _(t):
    return I.first_topic(tag_lists(t)).select("id", "tag")


@query("k7_notes", """, l AS (SELECT memory_id, (list(tag ORDER BY length(tag) DESC, tag))[1] AS tag FROM memory_tags GROUP BY 1), c AS (SELECT tag, count(*) AS n FROM l GROUP BY 1), g AS (SELECT memory_id, CASE WHEN n < 5 THEN 'misc' ELSE l.tag END AS g FROM l JOIN c ON l.tag = c.tag)
  SELECT replace(g, ' ', '-') || '.md' AS path, sha256('# ' || g || chr(10) || chr(10) || string_agg('## Record ' || id || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY id)) AS body FROM g JOIN memories m ON m.id = memory_id WHERE is_active GROUP BY g""")
def _(t):
    groups = I.note_groups(t.memory_tags, 5)
    rows = t.memories.where("is_active").join(groups, "id").select("note_group", "id", F.concat(F.lit("Record "), "id").alias("title"), "content")
    return I.render_notes(rows).select("path", F.sha2("body", 256).alias("body"))


@query("k8_changed", "SELECT id FROM memories WHERE updated_at > TIMESTAMP '2024-01-20'")
def _(t):
    return I.changed_since(t.memories, F.lit("2024-01-20").cast("timestamp")).select("id")


@query("v11_session_digests", "SELECT conv_id AS session_id, count(*) AS actions FROM (SELECT conv_id, substr(text, 1, 120) AS s, lag(substr(text, 1, 120)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'assistant') WHERE p IS NULL OR s <> p GROUP BY 1", raw=True)
def _(t):
    return I.session_digest(I.session_actions(I.as_transcript(t.conversations)), t.as_of).select("session_id", "actions")


@query("h5_tag_migration", "SELECT DISTINCT memory_id, CASE tag WHEN 'red' THEN 'crimson' ELSE tag END AS tag FROM memory_tags")
def _(t):
    mapped = X.canonical_tag(F.col("tag"), {"red": "crimson"})
    return t.memory_tags.select("memory_id", mapped.alias("tag")).distinct()


@query("s13_embeddings")
def _(t):
    return t.memories.select("id", I.hashed_embedding("content").alias("embedding"))


@query("sc8_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2023-12-03'", raw=True)
def _(t):
    return L.prune(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", t.as_of, 60).select("event_id")


@query("x16_contradictions")
def _(t):
    """Of each record and the next one."""
    return G.next_contradictions(t.memories.select("id", "content"))

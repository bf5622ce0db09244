"""Write path, consolidation, goals and overviews (P-*, C-*, H-*, A-25, X-*)."""

from pyspark.sql import functions as F

from sparkloom.functions import extract as N
from sparkloom.functions import text as X
from sparkloom.functions.extract import HALLS
from sparkloom.operators import graph as G
from sparkloom.operators import knowledge as K
from sparkloom.plans.q_search import COSINE, search_queries
from sparkloom.plans.q_text import _blocked, _redacted, lit
from sparkloom.plans.registry import query


def tag_lists(t):
    return t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("tag").alias("tags"))


#: A content as it is stored: injected instructions and credentials blocked. (Private parts don't occur.)
CLEAN = _redacted(_blocked("trim(content)"))


@query("p1_create", f""", r AS (SELECT id, {CLEAN} AS content, content_type, created_at, importance, sha256(trim(regexp_replace(lower({CLEAN}), '\\s+', ' ', 'g'))) AS h FROM memories WHERE content IS NOT NULL),
  g AS (SELECT * FROM r WHERE length(trim(content)) > 0 AND (length(trim(content)) >= 120 OR content_type IN ('summary', 'conversation'))),
  f AS (SELECT *, row_number() OVER (PARTITION BY content_type, h ORDER BY created_at, id) AS rn FROM g)
  SELECT id, h AS content_hash, floor((0.3::DOUBLE * importance + 0.15::DOUBLE) * 1000 + 0.5) / 1000 AS quality_score FROM f WHERE rn = 1""")
def _(t):
    rows = t.memories.withColumn("tags", F.array().cast("array<string>"))
    stored = rows.where("false").select("content_type", F.lit("").alias("content_hash"))
    return K.create(rows, stored, t.as_of).select("id", "content_hash", "quality_score")


def with_vectors(t):
    return t.memories.where("is_active AND parent_id IS NULL").join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id").join(tag_lists(t), "id", "left")


VECTORS = """, tl AS (SELECT memory_id, list(tag) AS tags FROM memory_tags GROUP BY 1), st AS (SELECT m.*, vec_id, embedding, tags FROM memories m JOIN embeddings ON vec_id = m.id LEFT JOIN tl ON memory_id = m.id WHERE is_active AND parent_id IS NULL)"""


@query("p3_semantic_duplicates", VECTORS + f""", c AS (SELECT *, row_number() OVER (PARTITION BY content_type, namespace ORDER BY created_at DESC, id) AS n FROM st),
  d AS (SELECT a.id, b.id AS duplicate_of, round(round({COSINE}, 9), 6) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id) AS r FROM st a JOIN c b ON a.id <> b.id AND b.n <= 200
  AND a.content_type IS NOT DISTINCT FROM b.content_type AND a.namespace IS NOT DISTINCT FROM b.namespace WHERE a.id % 20 = 0 AND length(a.content) >= 50 AND round({COSINE}, 9) >= 0.15 AND (a.tags IS NULL OR coalesce(list_has_any(a.tags, b.tags), false)))
  SELECT id, duplicate_of, similarity FROM d WHERE r = 1""")
def _(t):
    """New records are those with an id divisible by 20."""
    rows = with_vectors(t)
    return K.semantic_duplicates(rows.where("id % 20 = 0"), rows, 0.15)


@query("p4_near_duplicates", VECTORS + f""", c AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id) AS n FROM st),
  d AS (SELECT a.id, b.id AS existing, round({COSINE}, 9) AS s, a.content AS ta, b.content AS tb FROM st a JOIN c b ON a.id <> b.id AND b.n <= 200 AND a.namespace = b.namespace WHERE a.id % 20 = 0 AND length(a.content) >= 50 AND round({COSINE}, 9) >= 0.1),
  e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, existing) AS r FROM d), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(ta), '\\s+'), lambda w: length(w) >= 3)) AS wa,
  list_distinct(list_filter(regexp_split_to_array(lower(tb), '\\s+'), lambda w: length(w) >= 3)) AS wb FROM e WHERE r <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS q FROM w WHERE len(list_intersect(wa, wb)) / greatest(1, len(wa)) > 0.3)
  SELECT id, existing, round(s, 6) AS similarity FROM k WHERE q = 1""")
def _(t):
    """New records are those with an id divisible by 20."""
    rows = with_vectors(t)
    return K.near_duplicates(rows.where("id % 20 = 0"), rows, 0.1, 0.3)


@query("p6_chunked")
def _(t):
    return K.chunked(t.memories.select("id", "content")).select("id", "parent_id", "chunk_index", F.length("content").alias("n"))


def summary_members(t):
    """Clusters of ten consecutive records."""
    return t.memories.where("is_active").select(F.floor(F.col("id") / 10).alias("cluster"), "id", "content", "created_at")


#: The same in SQL: running sums of words per list.
SUMMARY = r""", mem AS (SELECT id // 10 AS cluster, id, content, created_at FROM memories WHERE is_active),
  sp AS (SELECT cluster, id, created_at, string_split(regexp_replace(content, '[.!?]\n|[.!?]\s', chr(1), 'g'), chr(1)) AS l FROM mem), su AS (SELECT cluster, id, created_at, generate_subscripts(l, 1) AS i, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS s FROM sp),
  so AS (SELECT cluster, s, min((created_at, id, i)) AS seen, len(regexp_split_to_array(s, '\s+')) AS n, """ + " OR ".join(f"regexp_matches(s, {lit(p)})" for p in N.KEY_FACTS) + r""" AS fact FROM su WHERE length(s) > 10 GROUP BY cluster, s),
  sr AS (SELECT *, row_number() OVER (PARTITION BY cluster, fact ORDER BY seen) AS p FROM so),
  tg AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT tag))[1:5], ', ') AS topics FROM mem JOIN memory_tags ON memory_id = id GROUP BY 1),
  hd AS (SELECT mem.cluster, count(DISTINCT id) AS merged, coalesce(any_value(topics), 'various topics') || ' (' || count(DISTINCT id) || ' sources, ' || CASE WHEN min(created_at) = max(created_at) THEN strftime(min(created_at), '%Y-%m-%d') ELSE strftime(min(created_at), '%Y-%m-%d') || ' to ' || strftime(max(created_at), '%Y-%m-%d') END || ')' AS h FROM mem LEFT JOIN tg ON tg.cluster = mem.cluster GROUP BY 1),
  pr AS (SELECT cluster, string_agg(s, '. ' ORDER BY p) || '.' AS prose, sum(n) AS pn, true AS has FROM sr WHERE fact AND p <= 3 GROUP BY 1),
  b0 AS (SELECT hd.*, prose, coalesce(has, false) AS has, coalesce(has AND len(regexp_split_to_array(h, '\s+')) + pn <= 500, false) AS told, len(regexp_split_to_array(h, '\s+')) + CASE WHEN has AND len(regexp_split_to_array(h, '\s+')) + pn <= 500 THEN pn ELSE 0 END AS spent FROM hd LEFT JOIN pr ON pr.cluster = hd.cluster),
  bl AS (SELECT sr.cluster, s, p, spent + sum(n) OVER (PARTITION BY sr.cluster ORDER BY p) AS c FROM sr JOIN b0 ON b0.cluster = sr.cluster WHERE fact AND p > 3),
  b1 AS (SELECT b0.*, bl.t, coalesce(bl.c, spent) AS now, EXISTS (SELECT 1 FROM sr WHERE sr.cluster = b0.cluster AND fact AND p > 3) AS many FROM b0 LEFT JOIN (SELECT cluster, string_agg('- ' || s || chr(10), '' ORDER BY p) AS t, max(c) AS c FROM bl WHERE c <= 500 GROUP BY 1) bl ON bl.cluster = b0.cluster),
  cx AS (SELECT sr.cluster, s, p, now + sum(n) OVER (PARTITION BY sr.cluster ORDER BY p) AS c FROM sr JOIN b1 ON b1.cluster = sr.cluster WHERE NOT fact AND now < 500),
  sm AS (SELECT b1.cluster, merged, regexp_replace(h || CASE WHEN told THEN chr(10) || chr(10) || prose ELSE '' END || CASE WHEN many THEN chr(10) || chr(10) || coalesce(b1.t, '') ELSE '' END || CASE WHEN has AND y.cluster IS NOT NULL THEN chr(10) ELSE '' END || coalesce(y.t, ''), '\s+$', '') AS summary
    FROM b1 LEFT JOIN (SELECT cluster, string_agg('- ' || s || chr(10), '' ORDER BY p) FILTER (c <= 500) AS t FROM cx GROUP BY 1) y ON y.cluster = b1.cluster)"""


@query("x18_basic_summary", SUMMARY + " SELECT cluster, merged, sha256(summary) AS summary, length(summary) AS chars FROM sm")
def _(t):
    made = K.basic_summary(summary_members(t), t.memory_tags)
    return made.select("cluster", "merged", F.sha2("summary", 256).alias("summary"), F.length("summary").alias("chars"))


@query("c3_extractive_summary", SUMMARY + " SELECT cluster, merged, summary FROM sm WHERE merged > 1")
def _(t):
    """What a consolidated record says of its cluster."""
    return K.basic_summary(summary_members(t), t.memory_tags).where("merged > 1").select("cluster", "merged", "summary")


@query("c5_dismissals", """, c AS (SELECT id, id AS memory_a_id, id + 100 AS memory_b_id, created_at FROM memories), j AS (SELECT c.*, a.is_active AS aa, b.is_active AS ab, a.superseded_by AS na, b.superseded_by AS nb FROM c LEFT JOIN memories a ON a.id = memory_a_id LEFT JOIN memories b ON b.id = memory_b_id),
  d AS (SELECT id, CASE WHEN aa IS NULL OR ab IS NULL THEN 'missing' WHEN NOT aa OR NOT ab THEN 'archived' WHEN coalesce(na = memory_b_id, false) OR coalesce(nb = memory_a_id, false) THEN 'superseded' WHEN created_at < TIMESTAMP '2024-01-02' THEN 'stale' END AS reason FROM j)
  SELECT id, reason FROM d WHERE reason IS NOT NULL""")
def _(t):
    made = t.memories.select("id", F.col("id").alias("memory_a_id"), (F.col("id") + 100).alias("memory_b_id"), "created_at", F.lit("pending").alias("status"))
    return K.dismissals(made, t.memories, t.as_of)


@query("c4_contradictions")
def _(t):
    """Of the newest 300 active records with a vector, as the job has it."""
    known = t.memory_links.select(F.col("source_id").alias("memory_a_id"), F.col("target_id").alias("memory_b_id"))
    return G.contradictions(t.memories, t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), known, 0.2)


#: The hall of a record (content, tags): the first that fits by tag or by word.
HALL = "CASE " + " ".join(
    f"WHEN list_has_any(list_transform(tags, lambda x: lower(x)), {list(names)}) OR " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{hall}'" for hall, (names, words) in HALLS.items()
) + " ELSE 'notes' END"


@query("a25_palace", f""", g AS (SELECT memory_id, list(tag) AS tags FROM memory_tags GROUP BY 1), h AS (SELECT id, namespace AS wing, importance, {HALL} AS hall FROM memories LEFT JOIN g ON memory_id = id WHERE is_active)
  SELECT wing, hall, count(*) AS records, (list(id ORDER BY importance DESC, id))[1] AS first FROM h GROUP BY 1, 2""")
def _(t):
    return K.palace(t.memories, tag_lists(t))


@query("a25_tunnels", "SELECT tag, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS wings FROM memory_tags JOIN memories ON memory_id = id WHERE is_active GROUP BY 1 HAVING count(DISTINCT namespace) >= 2")
def _(t):
    return K.tunnels(t.memory_tags, t.memories)


@query("h1_relevant_goals", """, gw AS (SELECT p_partkey AS goal_id, list_distinct(list_filter(regexp_split_to_array(lower('grow the ' || p_name || ' thing edge'), '\\W+'), lambda w: length(w) >= 3 AND w NOT IN ('the'))) AS k FROM part WHERE p_partkey % 20 = 0),
  gf AS (SELECT goal_id, len(k) AS n, unnest(k) AS w FROM gw), mw AS (SELECT id, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-zA-Z0-9_]+'))) AS w FROM memories), c AS (SELECT id, goal_id, n, count(*) AS c FROM mw JOIN gf USING (w) GROUP BY 1, 2, 3)
  SELECT id, goal_id, round(c / n, 6) AS share FROM c WHERE c / n >= 0.2""")
def _(t):
    goals = t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("grow the "), "p_name", F.lit(" thing edge")).alias("title"), F.lit("active").alias("status"))
    return K.relevant_goals(t.memories, goals, 0.2)


@query("h2_orientation")
def _(t):
    top = lambda where: t.memories.where(where).orderBy(F.desc("importance"), "id").limit(5).select(F.substring("content", 1, 200).alias("content"))
    return K.orientation([("important", top("is_active")), ("procedures", top("tier = 'procedural'")), ("semantic", top("tier = 'semantic'"))], 600)


@query("h3_wake_up", """SELECT 'important' AS section, id, CAST(row_number() OVER (ORDER BY importance DESC, id) AS INTEGER) AS rank FROM (SELECT * FROM memories WHERE is_active ORDER BY importance DESC, id LIMIT 5) UNION ALL
  SELECT 'recent', id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INTEGER) FROM (SELECT * FROM memories WHERE is_active ORDER BY created_at DESC, id LIMIT 5) UNION ALL
  SELECT 'procedures', id, CAST(row_number() OVER (ORDER BY importance DESC, id) AS INTEGER) FROM (SELECT * FROM memories WHERE is_active AND tier = 'procedural' ORDER BY importance DESC, id LIMIT 5) UNION ALL
  SELECT 'useful', id, CAST(row_number() OVER (ORDER BY useful_count DESC, id) AS INTEGER) FROM (SELECT * FROM memories WHERE is_active AND useful_count > 0 ORDER BY useful_count DESC, id LIMIT 5)""")
def _(t):
    return K.wake_up(t.memories)


@query("h4_articles")
def _(t):
    return K.article(t.memories).select("slug", "title", F.length("body").alias("n"))


@query("x35_entity_profiles")
def _(t):
    return K.entity_profiles(t.entities, t.memory_entities, t.memories)


@query("x27_expanded_queries")
def _(t):
    return K.expand_queries(search_queries(t).select("query_id", "query"), t.entities)


@query("x34_stems")
def _(t):
    words = t.memories.select(F.explode(F.split(F.lower("content"), "[^a-z]+")).alias("word")).where("length(word) > 3").distinct()
    return words.select("word", X.stems("word").alias("stem"))

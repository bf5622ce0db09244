"""Retrieval and evaluation queries (R-*, M-*, E-*)."""

import uuid

from pyspark.sql import functions as F

from sparkloom.functions import scoring as S
from sparkloom.functions.text import QUERY_STOPWORDS
from sparkloom.operators import analytics as A
from sparkloom.operators import evaluate as E
from sparkloom.operators import search as R
from sparkloom.operators import vectors as V
from sparkloom.operators.graph import shared_folder
from sparkloom.operators.postings import build_postings
from sparkloom.operators.relational import infer_metadata
from sparkloom.plans.q_analytics import QUALITY
from sparkloom.plans.registry import query

def search_queries(t):
    """The first words of the benchmark items whose id is divisible by 20, with an embedding each."""
    words = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    q = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), words.alias("query"))
    return q.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def embeddings(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def vector_index(t):
    """An index of all vectors, in a new folder of the shared ones."""
    return V.build_index(embeddings(t), f"{shared_folder(t.spark)}/vectors-{uuid.uuid4().hex}")


def entity_graph(t):
    """First words of the texts as entities, named by their least record; entities of consecutive records are related."""
    first = t.documents.select(F.col("doc_id").alias("memory_id"), F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("name")).where("name <> ''")
    entities = first.groupBy("name").agg(F.min("memory_id").alias("id"))
    bridge = first.join(entities, "name").select("memory_id", F.col("id").alias("entity_id"))
    after = bridge.select((F.col("memory_id") - 1).alias("memory_id"), F.col("entity_id").alias("target"))
    pairs = bridge.join(after, "memory_id").where("entity_id <> target")
    return R.EntityGraph(entities, bridge, pairs.groupBy(F.col("entity_id").alias("source"), "target").agg(F.count(F.lit(1)).alias("strength")))


def posting_lists(t):
    """Posting lists of the active records, in a new folder of the shared ones."""
    return build_postings(t.memories.where("is_active").select("id", "content"), f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}")


def query_vectors(t):
    """The vectors whose id is divisible by 20, as queries."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_STOP = "(" + ", ".join(f"'{w}'" for w in QUERY_STOPWORDS) + ")"
FTS = QUALITY + rf""", q AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '\s+')[1:8], ' ') AS query FROM benchmark WHERE item_id % 20 = 0 AND item_id IN (SELECT vec_id FROM embeddings)),
qt AS (SELECT query_id, list_filter(string_split(trim(regexp_replace(regexp_replace(query, '[''"(){{}}\[\]*:^~!@#$%&\\]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '' AND lower(w) NOT IN {_STOP})[1:10] AS w FROM q),
qv AS (SELECT query_id, list_filter(regexp_split_to_array(lower(array_to_string(w, ' ')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS o FROM qt),
ql AS (SELECT query_id, unnest(list_distinct(o)) AS term, o FROM qv),
qf AS (SELECT query_id, term, list_position(o, term) AS p, row_number() OVER (PARTITION BY query_id ORDER BY list_position(o, term)) - 1 AS i FROM ql),
dt AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM memories WHERE is_active),
st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM dt),
hit AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM dt) WHERE term IN (SELECT term FROM qf) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
gain AS (SELECT id, hit.term, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS g FROM hit JOIN dfs ON hit.term = dfs.term, st),
oq AS (SELECT query_id, id, round(sum(g), 9) AS score FROM gain JOIN qf ON gain.term = qf.term GROUP BY 1, 2),
need AS (SELECT query_id, count(*) AS need FROM qf WHERE i < 8 GROUP BY 1 HAVING count(*) >= 3),
aq AS (SELECT query_id, id, round(sum(g), 9) AS score, count(*) AS c FROM gain JOIN qf ON gain.term = qf.term WHERE i < 8 GROUP BY 1, 2),
aw AS (SELECT aq.query_id, id, score, row_number() OVER (PARTITION BY aq.query_id ORDER BY score DESC, id) AS r FROM aq JOIN need ON aq.query_id = need.query_id AND c = need),
ow AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM oq),
fl AS (SELECT query_id, id, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1) * 1.3 AS s FROM aw WHERE r <= 100 WINDOW w AS (PARTITION BY query_id)
 UNION ALL SELECT query_id, id, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1) FROM ow WHERE r <= 200 WINDOW w AS (PARTITION BY query_id)),
fts AS (SELECT query_id, id, round(max(s), 9) AS score FROM fl GROUP BY 1, 2)"""
COSINE = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
HYBRID = FTS + f""", vs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id IN (SELECT id FROM memories WHERE is_active)
  AND a.vec_id IN (SELECT query_id FROM q)),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM vs WHERE score > 0),
fr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM fts WHERE score > 0),
rrf AS (SELECT query_id, id, sum(x) AS rrf FROM (SELECT query_id, id, 0.45::DOUBLE / (60 + r) AS x FROM vr WHERE r <= 1000 UNION ALL SELECT query_id, id, 0.25::DOUBLE / (60 + r) FROM fr) GROUP BY 1, 2)"""


#: Words of the goals that are held to be active.
GOALS = ("red", "bolt", "tion", "the")


@query("r1_hybrid_search", HYBRID.replace("rrf AS (SELECT", """vl AS (SELECT * FROM vr WHERE r <= 1000), cand AS (SELECT query_id, id, round(sum(s), 9) AS s FROM (SELECT query_id, id, vs.score AS s FROM vs JOIN vl USING (query_id, id) UNION ALL SELECT query_id, id, score FROM fts WHERE score > 0) GROUP BY 1, 2),
seed AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM cand) WHERE r <= 20),
ends AS (SELECT source_id AS f, target_id AS id, strength FROM memory_links UNION ALL SELECT target_id, source_id, strength FROM memory_links),
fw AS (SELECT doc_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name FROM documents), ent AS (SELECT name, min(doc_id) AS id FROM fw WHERE name <> '' GROUP BY 1), be AS (SELECT doc_id AS memory_id, ent.id AS entity_id FROM fw JOIN ent USING (name)),
rel AS (SELECT a.entity_id AS source, b.entity_id AS target, count(*) AS strength FROM be a JOIN be b ON b.memory_id = a.memory_id + 1 WHERE a.entity_id <> b.entity_id GROUP BY 1, 2), rb AS (SELECT source AS entity_id, target, strength FROM rel UNION ALL SELECT target, source, strength FROM rel),
qe AS (SELECT DISTINCT query_id, ent.id AS entity_id FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2)) AS w FROM q) JOIN ent ON ent.name = w),
h2 AS (SELECT query_id, target AS entity_id FROM (SELECT query_id, target, row_number() OVER (PARTITION BY query_id, qe.entity_id ORDER BY strength DESC, target) AS r FROM qe JOIN rb ON rb.entity_id = qe.entity_id) WHERE r <= 10),
ge AS (SELECT query_id, memory_id AS id, max(hop) AS hop FROM (SELECT query_id, entity_id, 1.0 AS hop FROM qe UNION ALL SELECT query_id, entity_id, 0.5 FROM h2) x JOIN be ON be.entity_id = x.entity_id GROUP BY 1, 2),
gl AS (SELECT query_id, ends.id, max(0.3 + 0.5 * strength) AS link FROM seed JOIN ends ON f = seed.id GROUP BY 1, 2),
gp AS (SELECT query_id, id, greatest(coalesce(hop, 0), coalesce(link, 0)) AS score FROM (SELECT coalesce(ge.query_id, gl.query_id) AS query_id, coalesce(ge.id, gl.id) AS id, hop, link FROM ge FULL JOIN gl ON ge.query_id = gl.query_id AND ge.id = gl.id) n
  WHERE EXISTS (SELECT 1 FROM cand c WHERE c.query_id = n.query_id AND c.id = n.id)),
gr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM gp),
rrf AS (SELECT""").replace("FROM fr) GROUP", "FROM fr UNION ALL SELECT query_id, id, 0.1::DOUBLE / (60 + r) FROM gr) GROUP") + """, tw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2)) AS w FROM q),
tm AS (SELECT DISTINCT query_id, memory_id AS id FROM memory_tags JOIN tw ON contains(tag, w)), per AS (SELECT query_id, max(rrf) AS top, count(*) AS n FROM rrf GROUP BY 1),
rec AS (SELECT id FROM memories WHERE is_active ORDER BY created_at DESC, id LIMIT 1000),
pool AS (SELECT coalesce(rrf.query_id, tm.query_id) AS query_id, coalesce(rrf.id, tm.id) AS id, rrf, tm.id IS NOT NULL AS named FROM rrf FULL JOIN tm ON rrf.query_id = tm.query_id AND rrf.id = tm.id),
base AS (SELECT p.query_id, id, coalesce(rrf, 1 / (60 + greatest(10, coalesce(n, 0)) + 1)) AS rrf, named, top FROM pool p LEFT JOIN per ON p.query_id = per.query_id WHERE rrf IS NOT NULL OR id IN (SELECT id FROM rec)),
tl AS (SELECT memory_id, list(tag) AS tags FROM memory_tags GROUP BY 1), gx AS (SELECT id, coalesce(len(list_intersect(tags, ['red', 'bolt', 'tion', 'the'])), 0) AS n, len(list_filter(['red', 'bolt', 'tion', 'the'], lambda k: contains(lower(content), k))) AS c,
  coalesce(list_has_any(tags, ['benchmark', 'run-summary', 'metrics', 'health-check', 'regression', 'progress', 'widget']), false) AS meta FROM memories LEFT JOIN tl ON memory_id = id),
sc AS (SELECT query_id, m.id, quality, superseded_by, (rrf * CASE WHEN superseded_by IS NOT NULL THEN 0.2 ELSE 1 END * (1 + 0.2 * exp(-0.05 * (1 - 0.5 * quality) * age_days)
  + 0.1 * ln(1 + access_count) / ln(1 + (SELECT max(access_count) FROM memories WHERE is_active)) + 0.05 * CASE WHEN useful_count <= 0 THEN 0 ELSE least(1.0, ln(1 + useful_count) / ln(17)) END
  + 0.05 * abs(valence) + 0.1 * quality + 0.1 * importance + CASE tier WHEN 'semantic' THEN 0.15 WHEN 'procedural' THEN 0.10 WHEN 'reference' THEN 0.05 WHEN 'working' THEN -0.10 ELSE 0 END
  + 0.1 * CASE WHEN gx.n > 0 THEN least(1.0, gx.n / 3.0) WHEN gx.c >= 2 THEN least(0.5, gx.c / 4.0) ELSE 0 END) + CASE WHEN named THEN 0.1 * coalesce(top, 1 / 61) ELSE 0 END) * CASE WHEN meta THEN 0.35 ELSE 1 END AS score
  FROM base JOIN scored m ON m.id = base.id JOIN gx ON gx.id = m.id WHERE is_active),
k AS (SELECT * FROM sc WHERE score >= 0.001), d AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.query_id = k.query_id AND x.id = k.superseded_by)),
f AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f WHERE score >= 0.15 * best AND quality >= 0.08)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(quality, 6) AS quality FROM o WHERE rank <= 10""")
def _(t):
    """With tags, links, goals, metadata and the entity graph; records about widgets stand for metadata."""
    tags = t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("tag").alias("tags"))
    scored = A.with_quality(t.memories, t.memory_links, t.as_of).join(tags, "id", "left")
    meta = infer_metadata(F.coalesce("tags", F.array().cast("array<string>")), F.col("metadata")) | F.coalesce(F.array_contains("tags", "widget"), F.lit(False))
    return R.hybrid_search(search_queries(t), scored.withColumn("is_metadata", meta), embeddings(t), t.as_of, tags=t.memory_tags, links=t.memory_links, goal_words=GOALS, graph=entity_graph(t))


@query("r2_two_pass_fts", FTS + " SELECT query_id, id, round(score, 6) AS score FROM fts")
def _(t):
    found = R.two_pass_fts(search_queries(t), posting_lists(t))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("r3_bm25", FTS + " SELECT query_id, id, round(score, 6) AS score FROM ow WHERE r <= 50")
def _(t):
    from sparkloom.functions.text import query_terms

    terms = search_queries(t).select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(query_terms(F.col("query")), R.tokens)))).alias("term"))
    return posting_lists(t).best(terms, 50).select("query_id", "id", F.round("score", 6).alias("score"))


@query("m1_cosine", f"SELECT a.vec_id AS query_id, b.vec_id AS id, round(round({COSINE}, 9), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND round({COSINE}, 9) > 0", raw=True)
def _(t):
    return R.vector_scores(query_vectors(t), embeddings(t)).select("query_id", "id", F.round("score", 6).alias("score"))


@query("j18_one_to_all", f"""SELECT query_id, id, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COSINE}, 9) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND round({COSINE}, 9) > 0) WHERE r <= 20""", raw=True)
def _(t):
    found = vector_index(t).nearest(query_vectors(t), 20, itself=False).where("score > 0")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("m2_signals", QUALITY + """ SELECT id, round(exp(-0.05 * (1 - 0.5 * quality) * age_days), 6) AS recency, round(ln(1 + access_count) / ln(1 + (SELECT max(access_count) FROM memories)), 6) AS frequency,
  round(CASE WHEN useful_count <= 0 THEN 0 ELSE least(1.0, ln(1 + useful_count) / ln(17)) END, 6) AS usefulness, abs(valence) AS valence,
  CASE tier WHEN 'semantic' THEN 0.15 WHEN 'procedural' THEN 0.10 WHEN 'reference' THEN 0.05 WHEN 'working' THEN -0.10 ELSE 0 END::DOUBLE AS tier FROM scored""")
def _(t):
    scored = A.with_quality(t.memories, t.memory_links, t.as_of).crossJoin(F.broadcast(t.memories.agg(F.max("access_count").alias("most"))))
    return scored.select(
        "id", F.round(S.recency(F.col("created_at"), t.as_of, 0.05, F.col("quality")), 6).alias("recency"), F.round(S.frequency(F.col("access_count"), F.col("most")), 6).alias("frequency"),
        F.round(S.usefulness(F.col("useful_count")), 6).alias("usefulness"), S.valence(F.col("valence")).alias("valence"), S.tier_boost(F.col("tier")).alias("tier"),
    )


@query("m8_hybrid_score", """SELECT id, round(p + least(g * (0.2 * r + 0.1 * f), p * g), 6) AS score FROM (SELECT id, 0.45 * v + 0.25 * s AS p, CASE WHEN greatest(v, s) <= 0 THEN 0 ELSE least(1, 0.25 + 0.75 * greatest(v, s)) END AS g, r, f FROM
  (SELECT id, importance AS v, CAST(id % 10 AS DOUBLE) / 10 AS s, CAST(id % 7 AS DOUBLE) / 7 AS r, CAST(id % 3 AS DOUBLE) / 3 AS f FROM memories))""")
def _(t):
    i = F.col("id")
    return t.memories.select("id", F.round(S.hybrid(F.col("importance"), i % 10 / 10.0, i % 7 / 7.0, i % 3 / 3.0), 6).alias("score"))


@query("m10_rank_fusion", """, l AS (SELECT id, 0.45 AS w, row_number() OVER (ORDER BY importance DESC, id) AS r FROM memories WHERE is_active UNION ALL SELECT id, 0.25, row_number() OVER (ORDER BY access_count DESC, id) FROM memories WHERE access_count > 0)
  SELECT id, round(sum(w::DOUBLE / (60 + r)), 6) AS rrf FROM l GROUP BY 1""")
def _(t):
    one = lambda rows, c: rows.select(F.lit(1).alias("query_id"), "id", F.col(c).cast("double").alias("score"))
    fused = R.fuse([(one(t.memories.where("is_active"), "importance"), 0.45), (one(t.memories.where("access_count > 0"), "access_count"), 0.25)])
    return fused.select("id", F.round("rrf", 6).alias("rrf"))


@query("m6_goal_relevance", """, g AS (SELECT memory_id, list(tag) AS tags FROM memory_tags GROUP BY 1), x AS (SELECT id, coalesce(len(list_intersect(tags, ['red', 'bolt', 'tion', 'the'])), 0) AS n,
  len(list_filter(['red', 'bolt', 'tion', 'the'], lambda k: contains(lower(content), k))) AS c FROM memories LEFT JOIN g ON memory_id = id)
  SELECT id, round(CASE WHEN n > 0 THEN least(1.0, n / 3.0) WHEN c >= 2 THEN least(0.5, c / 4.0) ELSE 0 END, 6) AS relevance FROM x""")
def _(t):
    tags = t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("tag").alias("tags"))
    words = F.array(*[F.lit(w) for w in ("red", "bolt", "tion", "the")])
    rows = t.memories.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select("id", F.round(S.goal_relevance(F.col("tags"), words, F.col("content")), 6).alias("relevance"))


#: Ranked lists and judgments for the metrics: events of a user by value, graded by kind.
LISTS = """, rl AS (SELECT user_id AS query_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events),
  jd AS (SELECT user_id AS query_id, event_id AS id, CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END AS grade FROM events WHERE event_type IN ('purchase', 'signup'))"""


def lists(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    ranked = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), rank.alias("rank"))
    judged = t.events.where("event_type IN ('purchase', 'signup')").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("grade"))
    return ranked, judged


@query("m11_ndcg", LISTS + """, dcg AS (SELECT query_id, sum((2.0 ** grade - 1) / log2(rank + 1)) AS d FROM rl JOIN jd USING (query_id, id) WHERE rank <= 10 GROUP BY 1),
  id AS (SELECT query_id, sum((2.0 ** grade - 1) / log2(r + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM jd) WHERE r <= 10 GROUP BY 1)
  SELECT query_id, round(coalesce(d, 0) / i, 6) AS ndcg FROM id LEFT JOIN dcg USING (query_id)""")
def _(t):
    return E.ndcg(*lists(t))


@query("m14_hit_rates", LISTS + """, f AS (SELECT query_id, min(rank) AS r FROM rl JOIN jd USING (query_id, id) GROUP BY 1), a AS (SELECT q.query_id, r FROM (SELECT DISTINCT query_id FROM jd) q LEFT JOIN f USING (query_id))
  SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_10,
  round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM a""")
def _(t):
    return E.hit_rates(*lists(t))


@query("e1_mined_judgments", "SELECT query, memory_id, max(CASE WHEN useful_count > 0 THEN 2 ELSE 1 END) AS grade FROM access_log JOIN memories m ON m.id = memory_id WHERE is_active GROUP BY 1, 2")
def _(t):
    from sparkloom.operators.relational import judgments

    return judgments(t.access_log, t.memories)


@query("e3_regression", """, b AS (SELECT user_id AS query, list(event_id ORDER BY value DESC, event_id) AS l FROM events GROUP BY 1), c AS (SELECT query, l[1:10] AS o, l[3:12] AS n FROM b),
  k AS (SELECT query, list_filter(o, lambda x: x % 10 <> 9) AS kept, o, n FROM c), v AS (SELECT query, o, n, kept, list_filter(n, lambda x: list_contains(kept, x)) AS bt, greatest(1, len(kept)) AS e FROM k),
  r AS (SELECT query, round(len(bt) / e, 6) AS overlap, kept = n AS exact, round(CASE WHEN len(bt) > 0 THEN list_sum(list_transform(bt, lambda x: abs(list_position(kept, x) - list_position(n, x)))) / len(bt) ELSE e END, 6) AS avg_shift,
  len(o) - len(kept) AS churned FROM v) SELECT query, overlap, exact, avg_shift, churned, overlap < 0.8 OR avg_shift > 3 AS alert FROM r""")
def _(t):
    ranked = t.events.groupBy(F.col("user_id").alias("query")).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("value"), "event_id"))), lambda x: x["event_id"]).alias("l"))
    live = t.events.where("event_id % 10 <> 9").select(F.col("event_id").alias("id"))
    return E.regression(ranked.select("query", F.slice("l", 1, 10).alias("ids")), ranked.select("query", F.slice("l", 3, 10).alias("ids")), live)


@query("e3_adaptive_thresholds", """, h AS (SELECT job_name AS query, least(1.0, duration_ms / 100) AS o, duration_ms / 50 AS s, row_number() OVER (PARTITION BY job_name ORDER BY created_at DESC, id DESC) AS r FROM job_outcomes),
  m AS (SELECT query, list_sort(list(o)) AS o, list_sort(list(s)) AS s FROM h WHERE r <= 7 GROUP BY 1 HAVING count(*) >= 3), v AS (SELECT query, o[len(o) // 2 + 1] AS o, s[len(s) // 2 + 1] AS s FROM m)
  SELECT query, CASE WHEN o >= 0.95 THEN 0.8 ELSE greatest(0.5, o - 0.15) END AS min_overlap, CASE WHEN o >= 0.95 THEN 3.0 ELSE s + 1.5 END AS max_shift FROM v""")
def _(t):
    history = t.job_outcomes.select(F.col("job_name").alias("query"), F.least(F.lit(1.0), F.col("duration_ms") / 100).alias("overlap"), (F.col("duration_ms") / 50).alias("shift"), "created_at", "id")
    return E.adaptive_thresholds(history)


#: Words of a record as a query for it: from its first telling line, else its tags, else its beginning.
SELF_QUERIES = r""", tl AS (SELECT memory_id, list_sort(list(tag)) AS tags FROM memory_tags GROUP BY 1), sp AS (SELECT id, content, tags, trim(list_filter(string_split(content, chr(10)), lambda x: length(trim(x)) > 20 AND NOT regexp_matches(trim(x), '^[#*-]'))[1]) AS l FROM memories LEFT JOIN tl ON memory_id = id WHERE is_active AND id % 20 = 0),
  sw AS (SELECT *, regexp_split_to_array(l, '\s+') AS w FROM sp), q AS (SELECT id AS query_id, CASE WHEN l IS NOT NULL AND len(w) > 6 THEN array_to_string(w[CAST(floor(len(w) / 4) AS INTEGER) + 1:CAST(floor(len(w) / 4) AS INTEGER) + 5], ' ')
  WHEN l IS NOT NULL THEN left(l, 60) WHEN len(tags) > 0 THEN array_to_string(tags[1:3], ' ') ELSE trim(left(content, 40)) END AS query FROM sw)"""


@query("e5_self_retrieval", QUALITY + SELF_QUERIES + ",\nqt AS" + FTS.split(",\nqt AS", 1)[1] + """, rl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fts), f AS (SELECT query_id, min(rank) AS r FROM rl WHERE id = query_id AND rank <= 10 GROUP BY 1),
  a AS (SELECT q.query_id, r FROM q LEFT JOIN f USING (query_id)) SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_10,
  round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM a""")
def _(t):
    """Ranks of the active records whose id is divisible by 20, by words of their own in the full text."""
    tags = t.memory_tags.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    made = E.self_queries(t.memories.where("id % 20 = 0"), tags)
    found = R.top(R.two_pass_fts(made, t.memories.where("is_active")), 10)
    judged = made.select("query_id", F.col("query_id").alias("id"), F.lit(1).alias("grade"))
    return E.hit_rates(found, judged)


@query("e6_judge_scores", "SELECT event_type AS dimension, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1", raw=True)
def _(t):
    return E.judge_scores(t.events.select(F.col("event_type").alias("dimension"), F.col("value").alias("score")))


@query("r4_graph_proximity", """, s AS (SELECT id FROM memories WHERE id % 20 = 0), b AS (SELECT source_id, target_id, strength, link_type FROM memory_links UNION ALL SELECT target_id, source_id, strength, link_type FROM memory_links),
  n AS (SELECT id AS query_id, id + 1 AS entity_id FROM s), rel AS (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS strength FROM lineitem GROUP BY 1, 2), rb AS (SELECT source AS entity_id, target, strength FROM rel UNION ALL SELECT target, source, strength FROM rel),
  h2 AS (SELECT query_id, target AS entity_id FROM (SELECT query_id, target, row_number() OVER (PARTITION BY query_id, n.entity_id ORDER BY strength DESC, target) AS r FROM n JOIN rb ON rb.entity_id = n.entity_id) WHERE r <= 10),
  e AS (SELECT query_id, memory_id AS id, max(hop) AS hop FROM (SELECT query_id, entity_id, 1.0 AS hop FROM n UNION ALL SELECT query_id, entity_id, 0.5 FROM h2) x JOIN memory_entities me ON me.entity_id = x.entity_id GROUP BY 1, 2),
  l AS (SELECT s.id AS query_id, target_id AS id, max(CASE WHEN link_type <> 'error' THEN 0.3 + 0.5 * strength END) AS link, bool_or(link_type = 'error') AS old FROM s JOIN b ON s.id = source_id GROUP BY 1, 2)
  SELECT coalesce(e.query_id, l.query_id) AS query_id, coalesce(e.id, l.id) AS id, round(CASE WHEN coalesce(old, false) THEN 0.1 ELSE greatest(coalesce(hop, 0), coalesce(link, 0)) END, 6) AS score FROM e FULL JOIN l ON e.query_id = l.query_id AND e.id = l.id""")
def _(t):
    """Seeds with an id divisible by 20; each names one entity; links of errors stand for replacements."""
    seeds = t.memories.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id")
    links = t.memory_links.withColumn("link_type", F.when(F.col("link_type") == "error", "supersedes").otherwise(F.col("link_type")))
    related = t.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count(F.lit(1)).alias("strength"))
    found = R.graph_proximity(seeds, links, seeds.select("query_id", (F.col("id") + 1).alias("entity_id")), t.memory_entities, related)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("r9_context_budget")
def _(t):
    results = t.memories.where("is_active").orderBy(F.desc("importance"), "id").limit(10).select("id", F.col("importance").alias("score"))
    return R.with_linked(results, t.memory_links, t.memories)


@query("r8_rerank", """, s AS (SELECT 1 AS query_id, id, importance AS score FROM memories WHERE id % 20 = 0), w AS (SELECT query_id, id, 0.6 * CAST(id % 10 AS DOUBLE) / 10 + 0.4 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM s)
  SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM w""")
def _(t):
    results = t.memories.where("id % 20 = 0").select(F.lit(1).alias("query_id"), "id", F.col("importance").alias("score"))
    return R.rerank(results, F.col("id") % 10 / 10.0).select("id", F.round("score", 6).alias("score"), "rank")

"""Graph and similarity queries (G-*, C-*, P-*)."""

from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.operators import graph as G
from sparkloom.operators import relational as R
from sparkloom.operators.shared import shared_graph
from sparkloom.plans.q_relational import PAIRS
from sparkloom.plans.q_search import COSINE, embeddings, query_vectors, vector_index
from sparkloom.plans.registry import query

#: Suppliers that sold the same part, a denser graph than the forest of nations.
SOLD = ", sp AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), g AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM sp a JOIN sp b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey)"


def sold_together(t):
    sold = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    pairs = sold.join(sold.withColumnRenamed("l_suppkey", "target"), "l_partkey").where("l_suppkey < target")
    return pairs.select(F.col("l_suppkey").alias("source"), "target").distinct()


@query("g2_components", """, RECURSIVE_ AS (SELECT 1), e AS (SELECT source AS a, target AS b FROM relationships UNION SELECT target, source FROM relationships), n1 AS (SELECT a AS node, least(a, min(b)) AS l FROM e GROUP BY 1),
  n2 AS (SELECT e.a AS node, least(any_value(x.l), min(y.l)) AS l FROM e JOIN n1 y ON y.node = e.b JOIN n1 x ON x.node = e.a GROUP BY 1), n3 AS (SELECT e.a AS node, least(any_value(x.l), min(y.l)) AS l FROM e JOIN n2 y ON y.node = e.b JOIN n2 x ON x.node = e.a GROUP BY 1),
  n4 AS (SELECT e.a AS node, least(any_value(x.l), min(y.l)) AS l FROM e JOIN n3 y ON y.node = e.b JOIN n3 x ON x.node = e.a GROUP BY 1), n5 AS (SELECT e.a AS node, least(any_value(x.l), min(y.l)) AS l FROM e JOIN n4 y ON y.node = e.b JOIN n4 x ON x.node = e.a GROUP BY 1),
  n6 AS (SELECT e.a AS node, least(any_value(x.l), min(y.l)) AS l FROM e JOIN n5 y ON y.node = e.b JOIN n5 x ON x.node = e.a GROUP BY 1) SELECT node, l AS component FROM n6""".replace(", RECURSIVE_ AS (SELECT 1)", ""))
def _(t):
    return G.components(t.relationships)


@query("g1_graph_stats", "SELECT 5 + 25 + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS nodes, 25 + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS edges, (SELECT count(*) FROM region) AS components, round(2 * (25 + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)) / (30 + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)), 6) AS avg_degree", raw=True)
def _(t):
    nodes = t.relationships.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return G.graph_stats(t.relationships, nodes)


@query("g4_degrees", SOLD + " SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY 1")
def _(t):
    return G.degrees(sold_together(t))


@query("g3_betweenness")
def _(t):
    """Of the whole forest; above 1000 nodes, as there is with all customers at larger scales, the operator's guard gives no row."""
    return G.betweenness(t.relationships)


@query("g3_betweenness_regions", """, d AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1), s AS (SELECT r, n, n * (n - 1) / 2 AS pairs FROM d)
  SELECT 'r' || r AS node, round(pairs / (30 - 1) / (30 - 2), 6) AS betweenness FROM s UNION ALL SELECT 'n' || n_nationkey, 0 FROM nation""")
def _(t):
    """Of the stars of nations around their regions: a region lies between all pairs of its nations."""
    return G.betweenness(t.relationships.where("relationship = 'in_region'"))


def sold_graph(t):
    """The same graph, from the parts' lists of suppliers; none beyond the nodes that it holds."""
    return shared_graph(t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("node")))


@query("g5_communities")
def _(t):
    graph = sold_graph(t)
    return G.communities(sold_together(t), 5) if graph is None else graph.communities(5)


@query("g6_community_summaries")
def _(t):
    graph = sold_graph(t)
    if graph is not None:
        return G.community_summaries(graph.communities(5), graph.degrees())
    edges = sold_together(t)
    return G.community_summaries(G.communities(edges, 5), G.degrees(edges))


@query("g7_lineage", """, chain(id, depth, direction) AS (SELECT id, 0, 'self' FROM memories WHERE id = 3 UNION ALL SELECT a.superseded_by, 1, 'newer' FROM memories a WHERE a.id = 3 AND a.superseded_by IS NOT NULL UNION ALL
  SELECT b.superseded_by, 2, 'newer' FROM memories a JOIN memories b ON b.id = a.superseded_by WHERE a.id = 3 AND b.superseded_by IS NOT NULL UNION ALL
  SELECT c.superseded_by, 3, 'newer' FROM memories a JOIN memories b ON b.id = a.superseded_by JOIN memories c ON c.id = b.superseded_by WHERE a.id = 3 AND c.superseded_by IS NOT NULL)
  SELECT id, CAST(depth AS INTEGER) AS depth, direction FROM chain""")
def _(t):
    return G.lineage(t.memories, 3, 3)


@query("g8_decision_timeline", """SELECT id, created_at, source_uri FROM (SELECT id, created_at, source_uri, row_number() OVER (PARTITION BY source_uri ORDER BY created_at DESC, id) AS r FROM memories WHERE is_active
  AND id IN (SELECT memory_id FROM memory_tags WHERE tag = 'red')) WHERE r <= 3 OR source_uri IS NULL""")
def _(t):
    rows = R.with_all_tags(t.memories.where("is_active"), t.memory_tags, ["red"]).select("id", "created_at", "source_uri")
    return R.capped_per_group(rows, "source_uri")


@query("g9_hierarchy", """, p AS (SELECT t.id AS theme_id, e.id, row_number() OVER (PARTITION BY t.id ORDER BY e.importance DESC, e.id) AS r FROM memories t JOIN memories e ON e.created_at >= t.created_at - INTERVAL 7 DAY AND e.created_at < t.created_at
  WHERE t.tier = 'semantic' AND e.tier = 'episodic') SELECT theme_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS episodes FROM p WHERE r <= 5 GROUP BY 1""")
def _(t):
    found = R.preceding_week(t.memories.where("tier = 'semantic'"), t.memories.where("tier = 'episodic'"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return found.groupBy("theme_id").agg(F.array_join(lists, ",").alias("episodes"))


@query("g10_related", "SELECT DISTINCT other FROM (SELECT target AS other FROM relationships WHERE source = 's4' UNION ALL SELECT source FROM relationships WHERE target = 's4')")
def _(t):
    return R.neighbours(t.relationships).where("node = 's4'").select("other")


@query("j17_similar_pairs", f"SELECT DISTINCT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, round(round({COSINE}, 9), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE round({COSINE}, 9) >= 0.3", raw=True)
def _(t):
    """Vectors with an id divisible by 20 against all vectors, by the index."""
    found = vector_index(t).within(query_vectors(t), 0.3).where("id <> query_id")
    return found.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.round("score", 6).alias("similarity")).distinct()


def clustered(t, bucket=None):
    """Clusters of the newest 2000 active records with a vector, that are no chunks and not immutable, as the job has it."""
    rows = t.memories.where("is_active AND parent_id IS NULL").where(~F.coalesce(F.get_json_object("metadata", "$.immutable") == "1", F.lit(False)))
    rows = G.checkpointed(G.newest(rows.join(embeddings(t), "id"), 2000).select("id", "embedding", "created_at"))
    pairs = G.similar_pairs(rows, rows, 0.3)
    if bucket:
        own = rows.select("id", A.period(F.col("created_at"), bucket).alias("p"))
        pairs = pairs.join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b").where("pa = pb").select("a", "b", "similarity")
    return G.star_clusters(pairs, rows.select("id", (-F.unix_seconds("created_at")).alias("rank")))


@query("c1_clusters")
def _(t):
    return clustered(t)


@query("c1_clusters_by_month")
def _(t):
    return clustered(t, "month")


@query("c6_co_retrieval_links", """, p AS (SELECT unnest(memory_ids) AS a, memory_ids FROM co_retrievals), q AS (SELECT a, unnest(memory_ids) AS b FROM p), n AS (SELECT a, b, count(*) AS n FROM q WHERE a < b GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT a, b, n, floor(least(0.9::DOUBLE, 0.3::DOUBLE + n / 20 * 0.6::DOUBLE) * 1000000 + 0.5) / 1000000 AS strength FROM n WHERE NOT EXISTS (SELECT 1 FROM memory_links l WHERE (l.source_id = a AND l.target_id = b) OR (l.source_id = b AND l.target_id = a))""")
def _(t):
    return G.co_retrieval_links(R.array_pairs(t.co_retrievals, "memory_ids"), t.memory_links, 2)


@query("c7_densify", PAIRS + """ SELECT a, b, shared, floor(least(0.9::DOUBLE, 0.3::DOUBLE + shared / 10 * 0.6::DOUBLE) * 1000000 + 0.5) / 1000000 AS strength FROM pr WHERE shared >= 2
  AND NOT EXISTS (SELECT 1 FROM (SELECT memory_ids[1] AS s, memory_ids[2] AS t FROM co_retrievals WHERE len(memory_ids) > 1) e WHERE e.s = a AND e.t = b)""")
def _(t):
    edges = t.co_retrievals.where("size(memory_ids) > 1").select(F.get("memory_ids", F.lit(0)).alias("source"), F.get("memory_ids", F.lit(1)).alias("target"))
    return G.densify(R.co_occurrence(t.memory_entities), edges)


@query("c8_tag_merges", """, n AS (SELECT tag, count(*) AS n FROM memory_tags GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT x.tag AS x, y.tag AS y, x.n AS nx, y.n AS ny, round(1 - levenshtein(x.tag, y.tag) / greatest(length(x.tag), length(y.tag)), 6) AS similarity
  FROM n x JOIN n y ON x.tag < y.tag) SELECT CASE WHEN nx <= ny THEN x ELSE y END AS rare, CASE WHEN nx <= ny THEN y ELSE x END AS common, similarity FROM p WHERE similarity >= 0.3""")
def _(t):
    return G.tag_merges(t.memory_tags, 0.3)


@query("p2_hash_duplicates", """, h AS (SELECT id, row_number() OVER (PARTITION BY namespace, content_type, sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) ORDER BY created_at DESC, id DESC) AS r FROM memories WHERE is_active AND parent_id IS NULL)
  SELECT id FROM h WHERE r > 1""")
def _(t):
    from sparkloom.operators.lifecycle import canonical_rows

    return canonical_rows(t.memories).where("rn > 1").select("id")


@query("p7_auto_links", f"""SELECT id, other, similarity FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(round({COSINE}, 9), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.created_at DESC, b.vec_id) AS r
  FROM embeddings a JOIN (SELECT vec_id, embedding, created_at FROM embeddings JOIN memories m ON m.id = vec_id WHERE is_active ORDER BY created_at DESC, vec_id LIMIT 200) b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND round({COSINE}, 9) >= 0.25) WHERE r <= 5""")
def _(t):
    """New records are those with an id divisible by 20."""
    every = embeddings(t)
    return G.auto_links(every.where("id % 20 = 0"), every.join(t.memories.where("is_active").select("id", "created_at"), "id"), 0.25)

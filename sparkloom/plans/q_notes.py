"""Notes, session facts, expansion, tuning and promoted baselines (X-13, X-26, X-29, V-4 to V-9, K-9, K-10, R-11, L-6, E-2, E-4, O-8)."""

from pyspark.sql import functions as F

from sparkloom.functions import scoring as S
from sparkloom.operators import analytics as A
from sparkloom.operators import evaluate as E
from sparkloom.operators import knowledge as K
from sparkloom.operators import notes as N
from sparkloom.operators import relational as R
from sparkloom.plans.q_analytics import QUALITY
from sparkloom.plans.q_more import tag_lists
from sparkloom.plans.q_search import LISTS, lists
from sparkloom.plans.registry import query
from sparkloom.sources import ingest as I

# --- notes -------------------------------------------------------------------------------------------------

_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_LINES = r"list_filter(list_transform(string_split(content, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_WORTH = rf"""length({_TRIM.format('content')}) >= 30 AND NOT regexp_matches({_TRIM.format('content')}, '^[\d.,\s:/-]+$') AND NOT (contains(content, 'Consolidated summary of') AND
  (len(list_filter(ls, lambda s: regexp_matches(s, '^[-\s]*[\d.,\s/]+$'))) + len(list_filter(ls, lambda s: s IN ('Key facts:', 'Specifics:')))
   + len(list_filter(ls, lambda s: regexp_matches(regexp_replace(s, ',\s*', '', 'g'), '^[-\s]*[\d.,\sv]+[\w-]*$')))) / len(ls) > 0.4)"""
#: Records as texts of all kinds that a note can have: as they are, short, numbers only, summaries with a head and hardly a word.
_NOTED = f"""nm AS (SELECT * REPLACE (CASE id % 6 WHEN 0 THEN left(content, id % 60) WHEN 1 THEN repeat(id || '.5, ', 9) WHEN 2 THEN 'Consolidated summary of 3 memories. Topics: ' || namespace || ', more]' || chr(10) || 'Key facts:' || chr(10) || '- 1.5, 2' || chr(10) || content
  WHEN 3 THEN '[Topics: ' || namespace || ' , x]' || content ELSE content END AS content) FROM memories), nl AS (SELECT *, {_LINES} AS ls FROM nm WHERE content IS NOT NULL), ok AS (SELECT * FROM nl WHERE {_WORTH})"""


def noted(t):
    i, c = F.col("id") % 6, F.col("content")
    summary = F.concat(F.lit("Consolidated summary of 3 memories. Topics: "), "namespace", F.lit(", more]\nKey facts:\n- 1.5, 2\n"), c)
    return t.memories.withColumn("content", (
        F.when(i == 0, F.substr(c, F.lit(1), (F.col("id") % 60).cast("int"))).when(i == 1, F.repeat(F.concat("id", F.lit(".5, ")), F.lit(9)))
        .when(i == 2, summary).when(i == 3, F.concat(F.lit("[Topics: "), "namespace", F.lit(" , x]"), c)).otherwise(c)
    ))


@query("x29_worth_a_note", f", {_NOTED} SELECT id FROM ok")
def _(t):
    return noted(t).where(N.worth_a_note(F.col("content"))).select("id")


@query("v4_decisions_by_month", f", {_NOTED} SELECT strftime(created_at, '%Y-%m') AS month, ok.id FROM ok WHERE is_active AND id IN (SELECT memory_id FROM memory_tags WHERE tag = 'widget')")
def _(t):
    return N.decisions_by_month(noted(t), t.memory_tags, "widget")


@query("v6_by_topic", f", {_NOTED} SELECT coalesce(nullif(trim(split_part(regexp_extract(content, 'Topics:\\s*([^\\]]+)\\]', 1), ',', 1)), ''), 'general') AS topic, id FROM ok WHERE is_active AND tier = 'semantic' AND parent_id IS NULL")
def _(t):
    return N.by_topic(noted(t))


#: Eight records make a page; each begins with the last 15 to 54 characters of the one before.
_PAGE = """pg AS (SELECT id, id // 8 AS page, content AS own, lag(content) OVER (PARTITION BY id // 8 ORDER BY id) AS p FROM memories WHERE content IS NOT NULL),
  ch AS (SELECT id, page, coalesce(right(p, 15 + id % 40), '') || own AS content FROM pg)"""


def chunks(t):
    from pyspark.sql import Window

    rows = t.memories.where("content IS NOT NULL").select("id", F.floor(F.col("id") / 8).alias("page"), "content")
    tail = F.right(F.lag("content").over(Window.partitionBy("page").orderBy("id")), (15 + F.col("id") % 40).cast("int"))
    return rows.withColumn("content", F.concat(F.coalesce(tail, F.lit("")), "content"))


@query("x29_stitched", f""", {_PAGE}, pr AS (SELECT id, page, content, coalesce(lag(content) OVER (PARTITION BY page ORDER BY id), '') AS b FROM ch)
  SELECT id, sha256(substr(content, 1 + coalesce(list_max(list_filter(range(20, least(length(b), length(content), 500) + 1), lambda n: substr(content, 1, n) = right(b, n))), 0))) AS h FROM pr""")
def _(t):
    return N.without_overlap(chunks(t), "page", ["id"]).select("id", F.sha2("content", 256).alias("h"))


@query("v7_reference_pages")
def _(t):
    return N.reference_pages(chunks(t), "page", ["id"]).select("page", "chunks", F.length("body").alias("n"), F.sha2("body", 256).alias("h"))


@query("x29_cleaned_pages")
def _(t):
    text = F.regexp_replace("html", r"<[^>]*>", "\n")
    return t.pages.withColumn("body", text).select("page_id", N.cleaned("body").alias("body")).select("page_id", F.sha2("body", 256).alias("h"), F.round(N.prose_ratio(F.col("body")), 6).alias("prose"))


@query("v8_linked_notes")
def _(t):
    """All records as notes, which link to the pages of the languages and of the frequent tags that they name."""
    notes = t.memories.where("content IS NOT NULL").select(F.col("id").cast("string").alias("slug"), F.concat(F.lit("---\ntype: note\n---\n# Note\n"), "content").alias("body"))
    tags = t.memory_tags.select("tag").distinct()
    pages = tags.select(F.lit("Topics").alias("section"), F.replace("tag", F.lit(" "), F.lit("-")).alias("slug"), F.col("tag").alias("title"))
    return N.linked(notes, pages).select("slug", F.sha2("body", 256).alias("h"))


_FACT_STOP = "(" + ", ".join(f"'{w}'" for w in N.FACT_STOPWORDS) + ")"


@query("v9_notable_facts", f"""SELECT l_orderkey AS id, l_linenumber AS line, subject, predicate, object FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'The' WHEN 2 THEN upper(p_type) WHEN 3 THEN p_type ELSE p_name END AS subject,
  CASE WHEN l_quantity < 5 THEN 'version' ELSE 'has' END AS predicate, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE p_name END AS object, 1 - l_discount * 5 AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE confidence >= 0.7 AND regexp_matches(subject, '^[A-Z]') AND length(subject) >= 3 AND lower(subject) NOT IN {_FACT_STOP} AND predicate <> 'version' AND length(object) BETWEEN 3 AND 60 AND NOT regexp_full_match(object, '\\d+(\\.\\d+)*')""", raw=True)
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    subject = F.when(F.col("l_linenumber") == 1, "The").when(F.col("l_linenumber") == 2, F.upper("p_type")).when(F.col("l_linenumber") == 3, F.col("p_type")).otherwise(F.col("p_name"))
    facts = rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), subject.alias("subject"), F.when(F.col("l_quantity") < 5, "version").otherwise("has").alias("predicate"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(F.col("p_name")).alias("object"), (1 - F.col("l_discount") * 5).alias("confidence"),
    )
    return N.notable_facts(facts).select("id", "line", "subject", "predicate", "object")


@query("k9_wiki_refresh")
def _(t):
    """Articles of the namespaces that changed after a mark."""
    changed = I.changed_since(t.memories, F.lit("2024-01-31").cast("timestamp")).select("namespace").distinct()
    return K.article(t.memories.join(changed, "namespace", "left_semi"))


@query("k10_context_files")
def _(t):
    """A file of each format for each agent, from its 30 most important records."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("importance"), "id"))
    rows = t.memories.where("is_active AND content IS NOT NULL").join(tag_lists(t), "id", "left").select(F.col("agent").alias("name"), rank.alias("rank"), "content", "tags", "tier").where("rank <= 30")
    made = [N.context_files(rows, style).withColumn("style", F.lit(style)) for style in N.CONTEXT_FORMATS]
    return made[0].unionByName(made[1]).unionByName(made[2])


# --- sessions and queries ----------------------------------------------------------------------------------


def turns(t):
    """Turns of an assistant, every third of which opens with a phrase of a session."""
    opening = F.array(*[F.lit(x) for x in ("Let me look at it.\n", "We decided to keep the small one. ", "It turns out the cache was stale. ", "Note to self: check the limits. ", "Reading the file now.\n", "")])
    text = F.concat(F.get(opening, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)).cast("int")), "text")
    return t.conversations.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), text.alias("text"))


@query("x13_session_facts")
def _(t):
    return I.session_facts(turns(t))


_NARRATED = r"'(?i)^(let me|i''ll|i will|now i|going to)\b.{0,80}$|^(here (are|is)|the (result|output|file|content))\b|^(reading|searching|looking|checking|running|editing)\b|^(done|ok|sure|yes|alright)[.!]?\s*$'"


@query("x13_narration", rf"SELECT conv_id AS id, turn, length({_TRIM.format('text')}) < 30 OR regexp_matches(split_part({_TRIM.format('text')}, chr(10), 1), {_NARRATED}) AS noise FROM conversations", raw=True)
def _(t):
    return t.conversations.select(F.col("conv_id").alias("id"), "turn", I.is_narration(F.col("text")).alias("noise"))


_WORDS = r"list_filter(regexp_split_to_array(lower(q), '\s+'), lambda w: length(w) > 2)"
_SYN = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in K.SYNONYMS.items()) + "}"


@query("x26_auto_expansion", f"""WITH s AS (SELECT item_id AS id, {list(K.SYNONYMS)} AS ks, text FROM benchmark), a AS (SELECT id, ks[1 + id % 19] || ' ' || ks[1 + (id * 7) % 19] || ' ' || text AS q FROM s),
  w AS (SELECT id, {_WORDS} AS w FROM a), e AS (SELECT id, w, list_filter(flatten(list_transform(w, lambda x: coalesce({_SYN}[x], []))), lambda x: NOT list_contains(w, x)) || list_transform(range(1, len(w)), lambda i: w[i] || '-' || w[i + 1]) AS x FROM w),
  p AS (SELECT id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM e), f AS (SELECT id, t, min(i) AS i FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f)
  SELECT id, string_agg(t, ' ' ORDER BY n) AS terms FROM r WHERE n <= 8 GROUP BY 1""", raw=True)
def _(t):
    """Two words with synonyms before each benchmark item."""
    known = F.array(*[F.lit(w) for w in K.SYNONYMS])
    pick = lambda at: F.get(known, (at % len(K.SYNONYMS)).cast("int"))
    q = F.concat_ws(" ", pick(F.col("item_id")), pick(F.col("item_id") * 7), "text")
    return t.benchmark.select(F.col("item_id").alias("id"), K.auto_expansion(q).alias("terms"))


def _first_sentence(text: str) -> str:
    return f"It is known: {text[:80]}"


@query("r11_hypothetical", """WITH k AS (SELECT lower(trim(text)) AS key, min(text) AS q, min(item_id) AS i FROM benchmark WHERE text IS NOT NULL GROUP BY 1)
  SELECT item_id AS query_id, text || ' ' || CASE WHEN i % 3 = 0 THEN 'held' ELSE 'It is known: ' || left(q, 80) END AS query FROM benchmark LEFT JOIN k ON key = lower(trim(text))""", raw=True)
def _(t):
    """Every third query is answered from the cache, another third has only an answer that is too old."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    first = q.groupBy(F.lower(F.trim("query")).alias("key")).agg(F.min("query_id").alias("i"))
    age = F.when(F.col("i") % 3 == 0, F.expr("INTERVAL 10 MINUTES")).otherwise(F.expr("INTERVAL 2 HOURS"))
    cache = first.where("i % 3 < 2").select("key", F.lit("held").alias("answer"), (t.as_of - age).alias("made_at"))
    return K.hypothetical(q, _first_sentence, cache, t.as_of)[0]


# --- tuning and baselines ----------------------------------------------------------------------------------

_OLD = {"recency": S.Weights.recency, "frequency": S.Weights.frequency, "graph": S.Weights.graph, "usefulness": S.Weights.usefulness, "importance": S.Weights.importance}


@query("l6_tuned_weights", QUALITY + f""", g AS (SELECT useful_count > 0 AND id % 3 > 0 AS u, count(*) AS n, avg(age_days) AS age, avg(access_count) AS acc, avg(importance) AS imp, avg(link_count) AS lnk FROM scored WHERE is_active AND access_count > 0 GROUP BY 1),
  x AS (SELECT a.n AS un, b.n AS bn, b.age - a.age AS age, a.acc / greatest(1.0, b.acc) AS acc, a.lnk - b.lnk AS lnk, a.imp - b.imp AS imp FROM g a, g b WHERE a.u AND NOT b.u),
  m AS (SELECT unnest([{{'weight': 'recency', 'old': {_OLD['recency']}::DOUBLE, 'd': CASE WHEN age > 5 THEN 0.02 WHEN age < -5 THEN -0.02 ELSE 0 END}}, {{'weight': 'frequency', 'old': {_OLD['frequency']}::DOUBLE, 'd': CASE WHEN acc > 1.5 THEN 0.02 WHEN acc < 0.67 THEN -0.02 ELSE 0 END}},
   {{'weight': 'graph', 'old': {_OLD['graph']}::DOUBLE, 'd': CASE WHEN lnk > 0.5 THEN 0.02 WHEN lnk < -0.5 THEN -0.02 ELSE 0 END}}, {{'weight': 'usefulness', 'old': {_OLD['usefulness']}::DOUBLE, 'd': CASE WHEN un > 20 THEN 0.02 ELSE 0 END}},
   {{'weight': 'importance', 'old': {_OLD['importance']}::DOUBLE, 'd': CASE WHEN imp > 0.1 THEN 0.02 WHEN imp < -0.1 THEN -0.02 ELSE 0 END}}], recursive := true) FROM x WHERE un >= 5 AND bn >= 5)
  SELECT weight, old, round(greatest(0.02, least(0.5, old + d)), 2) AS new FROM m WHERE round(greatest(0.02, least(0.5, old + d)), 2) <> old""")
def _(t):
    """Every third record is held to be of no use."""
    scored = A.with_quality(t.memories, t.memory_links, t.as_of)
    return A.tuned_weights(A.usefulness_groups(scored.withColumn("useful_count", F.when(F.col("id") % 3 > 0, F.col("useful_count")).otherwise(0))), _OLD)


@query("e2_tuned")
def _(t):
    """Three signals of events whose right weights are known to differ from the given ones."""
    _, judged = lists(t)
    hour = F.hour("ts") / 24.0
    signals = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 500).alias("value"), hour.alias("hour"), F.when(F.col("event_type") == "purchase", 0.5).otherwise(0.0).alias("kind"))
    weights, before, held_out = E.tune(signals, judged, {"value": 0.5, "hour": 0.3, "kind": 0.2})
    return t.spark.createDataFrame([(k, v, before, held_out) for k, v in weights.items()], "weight string, value double, tuned double, held_out double")


_RUNS = """, rl AS (SELECT user_id AS query, list(event_id ORDER BY value DESC, event_id) AS l FROM events GROUP BY 1), n AS (SELECT query, CASE WHEN query % 2 = 0 THEN l[3:12] END AS nw, CASE WHEN query % 3 > 0 THEN l[1:10] END AS od FROM rl)"""


def runs(t):
    """Stored runs of the even queries, and baselines of the queries not divisible by three."""
    ranked = t.events.groupBy(F.col("user_id").alias("query")).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("value"), "event_id"))), lambda x: x["event_id"]).alias("l"))
    run = ranked.where("query % 2 = 0").select(F.lit("run-1").alias("run_id"), "query", F.slice("l", 3, 10).alias("ids"))
    return ranked.where("query % 3 > 0").select("query", F.slice("l", 1, 10).alias("ids")), run.unionByName(run.withColumns({"run_id": F.lit("run-2"), "ids": F.slice("ids", 1, 1)}))


@query("e4_promoted", _RUNS + " SELECT query, array_to_string(coalesce(nw, od), ',') AS ids FROM n WHERE nw IS NOT NULL OR od IS NOT NULL")
def _(t):
    return E.promote(*runs(t), "run-1").select("query", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("e4_compared", _RUNS + """, b AS (SELECT query, nw AS o, od AS n FROM n WHERE nw IS NOT NULL AND od IS NOT NULL), k AS (SELECT query, list_filter(o, lambda x: x % 10 <> 9) AS kept, o, n FROM b),
  v AS (SELECT query, o, n, kept, list_filter(n, lambda x: list_contains(kept, x)) AS bt, greatest(1, len(kept)) AS e FROM k),
  r AS (SELECT query, round(len(bt) / e, 6) AS overlap, kept = n AS exact, round(CASE WHEN len(bt) > 0 THEN list_sum(list_transform(bt, lambda x: abs(list_position(kept, x) - list_position(n, x)))) / len(bt) ELSE e END, 6) AS avg_shift,
  len(o) - len(kept) AS churned FROM v) SELECT query, overlap, exact, avg_shift, churned, overlap < 0.8 OR avg_shift > 3 AS alert FROM r""")
def _(t):
    live = t.events.where("event_id % 10 <> 9").select(F.col("event_id").alias("id"))
    return E.compare_run(*runs(t), "run-1", live)


@query("e4_reset", _RUNS + " SELECT query FROM n WHERE od IS NOT NULL AND query NOT IN (1, 2)")
def _(t):
    return E.reset(runs(t)[0], [1, 2]).select("query")


@query("o8_filled_budget", """WITH RECURSIVE s AS (SELECT source AS name, row_number() OVER (ORDER BY source) AS i, CAST(ceil(count(*) / 4) AS BIGINT) AS cost FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT CAST(ceil(count(*) / 8) AS BIGINT) AS b FROM documents),
  f AS (SELECT 0::BIGINT AS i, '' AS name, false AS kept, 0::BIGINT AS spent UNION ALL SELECT s.i, s.name, f.spent + cost <= b, f.spent + CASE WHEN f.spent + cost <= b THEN cost ELSE 0 END FROM f JOIN s ON s.i = f.i + 1, b)
  SELECT name FROM f WHERE kept""", raw=True)
def _(t):
    """Sources whose costs fit half of all costs, in order; those that don't are skipped."""
    cost = t.documents.where("source IS NOT NULL").groupBy("source").agg(F.ceil(F.count(F.lit(1)) / 4).alias("c")).orderBy("source").collect()
    kept = R.fill_budget([(r["source"], r["c"]) for r in cost], -(-t.documents.count() // 8))
    return t.spark.createDataFrame([(k,) for k in kept], "name string")

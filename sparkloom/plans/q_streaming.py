"""Streams run over what is there now, beside the same result in SQL (ST-*)."""

import uuid

from pyspark.sql import functions as F

from sparkloom.operators.graph import shared_folder
from sparkloom.plans.registry import query
from sparkloom.streaming import jobs
from sparkloom.streaming import usefulness as U


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _run(t, stream):
    """The rows that an append stream gives for what is there now."""
    folder = _folder(t)
    return jobs.run_to_parquet(stream, f"{folder}/out", f"{folder}/state")


def _events(t):
    """The events table as a stream; a last row far ahead closes all windows."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st3_sliding_windows", """WITH w AS (SELECT event_type, value, unnest(range(0, 7)) AS k, date_trunc('day', ts) AS d, ts FROM events),
  g AS (SELECT (d - to_days(CAST(k AS INTEGER)))::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY 1, 2)
  SELECT start, event_type, n, value FROM g WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", raw=True)
def _(t):
    # Windows of whole days start at midnight UTC, as the epoch does.
    out = _run(t, jobs.windowed_counts(_events(t)))
    return out.select("start", "event_type", "n", F.round("value", 4).alias("value"))


@query("st7_searches_per_minute", """WITH g AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS start, count(DISTINCT event_type) AS searches FROM events GROUP BY 1) SELECT start, searches FROM g WHERE start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events)::TIMESTAMP - INTERVAL 1 HOUR""", raw=True)
def _(t):
    return _run(t, jobs.searches_per_minute(_events(t)))


@query("st8_sessions", """WITH o AS (SELECT user_id, ts::TIMESTAMP AS ts, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o),
  a AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g) SELECT start, "end", user_id, n FROM a WHERE "end" <= (SELECT max(ts) FROM events)::TIMESTAMP - INTERVAL 1 HOUR""", raw=True)
def _(t):
    return _run(t, jobs.sessions(_events(t)))


@query("st5_attribution", """SELECT s.user_id, s.event_id AS search_id, g.event_id AS get_id FROM events s JOIN events g ON s.user_id = g.user_id AND s.event_type = 'view' AND g.event_type = 'click' AND g.ts >= s.ts AND g.ts <= s.ts + INTERVAL 30 MINUTE""", raw=True)
def _(t):
    found = jobs.attributed(_events(t).where("event_type = 'view'"), _events(t).where("event_type = 'click'"))
    return _run(t, found).select("user_id", "search_id", "get_id")


@query("st6_cooldown")
def _(t):
    return _run(t, jobs.cooled_down(_events(t))).select("user_id", "event_id")


@query("st9_incremental_copy", "SELECT event_id, event_type FROM events", raw=True)
def _(t):
    return _run(t, _events(t).select("event_id", "event_type"))


@query("st2_every_n_rows", "SELECT (count(*) // 100) * 100 AS rows_at_last_run FROM events", raw=True)
def _(t):
    """A job that runs once another hundred rows have come; its log says at how many."""
    folder = _folder(t)
    log = f"{folder}/log"
    job = lambda batch, epoch: batch.agg(F.count(F.lit(1)).alias("rows")).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("append").parquet(log)
    jobs.every_n_rows(_events(t), 100, job, folder).awaitTermination()
    seen = t.spark.read.schema("rows long, epoch long").parquet(f"{folder}/rows/batch=*").agg(F.sum("rows").alias("n"))
    ran = t.spark.read.schema("rows long, epoch long").parquet(log).agg(F.count(F.lit(1)).alias("runs"))
    return seen.crossJoin(ran).where("runs > 0").select((F.floor(F.col("n") / 100) * 100).cast("long").alias("rows_at_last_run"))


def _credits(t):
    """Views as searches that show four users, clicks as reads of one; sessions by event number."""
    events = _events(t).withColumn("session", (F.col("event_id") % 10).cast("string"))
    u, e = F.col("user_id"), F.col("event_id")
    results = F.array(u, (u * 7 + e) % 150, (u + e) % 150, e % 150)
    searches = events.where("event_type = 'view'").select("event_id", "ts", "session", results.alias("results"))
    reads = events.where("event_type = 'click'").select("event_id", "ts", "session", u.alias("memory_id"))
    with U.rocksdb(t.spark):
        return _run(t, U.credits(U.showings(searches, reads)))


_CREDITS = """RECURSIVE s AS (SELECT event_id, ts::TIMESTAMP AS ts, event_id % 10 AS session, [user_id, (user_id * 7 + event_id) % 150, (user_id + event_id) % 150, event_id % 150] AS r FROM events WHERE event_type = 'view'),
  x AS (SELECT event_id, ts, session, m AS memory_id, min(k) AS k FROM (SELECT event_id, ts, session, unnest(r) AS m, generate_subscripts(r, 1) AS k FROM s) GROUP BY ALL),
  sh AS (SELECT event_id, ts, session, memory_id, row_number() OVER (PARTITION BY event_id ORDER BY k) AS p FROM x), top AS (SELECT memory_id, ts, event_id FROM sh WHERE p <= 3),
  mk AS (SELECT memory_id, min(ts) AS ts FROM top GROUP BY 1 UNION ALL SELECT n.memory_id, min(top.ts) FROM mk n JOIN top ON top.memory_id = n.memory_id AND top.ts >= n.ts + INTERVAL 24 HOUR GROUP BY n.memory_id, n.ts),
  a AS (SELECT memory_id, session, ts, event_id, true AS shown FROM sh UNION ALL SELECT user_id, event_id % 10, ts::TIMESTAMP, event_id, false FROM events WHERE event_type = 'click'),
  l AS (SELECT *, lag(shown) OVER w AS before, lag(ts) OVER w AS prior FROM a WINDOW w AS (PARTITION BY memory_id, session ORDER BY ts, event_id)),
  c AS (SELECT memory_id, min(event_id) AS event_id, 'ranked' AS reason FROM mk JOIN top USING (memory_id, ts) GROUP BY memory_id, ts UNION ALL SELECT memory_id, event_id, 'read' FROM l WHERE NOT shown AND before AND ts - prior <= INTERVAL 30 MINUTE)"""


@query("p10_credits", "WITH " + _CREDITS + " SELECT memory_id, event_id, reason FROM c", raw=True)
def _(t):
    """Usefulness credits of searches and reads, by keyed state."""
    return _credits(t).select("memory_id", "event_id", "reason")


@query("p10_useful_counts", "WITH " + _CREDITS + ", ev_ AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) SELECT d.doc_id AS id, coalesce(p, 0) + (SELECT count(*) FROM c WHERE memory_id = doc_id) AS useful_count FROM documents d LEFT JOIN ev_ ON user_id = doc_id", raw=True)
def _(t):
    return U.with_credits(t.memories, _credits(t)).select("id", "useful_count")

"""Import queries (S-8): the conversations written in each format by Spark, and read back as records."""

import uuid

from pyspark.sql import functions as F

from sparkloom.functions.extract import TOPICS
from sparkloom.operators.graph import shared_folder
from sparkloom.plans.registry import query
from sparkloom.sources import imports as I


def _written(t, lines, whole: bool = False):
    """A folder of text files with one column of lines; ``whole`` files have one value each."""
    folder = f"{shared_folder(t.spark)}/import-{uuid.uuid4().hex}"
    lines.write.text(folder, lineSep="\n\n" if whole else "\n")
    return folder


def _turns(t):
    c = t.conversations
    message = F.struct("turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))


_TOPICS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join("contains(lower(x), '" + w.replace("'", "''") + "')" for w in words) + f" THEN '{topic}' END" for topic, words in TOPICS.items()) + "], lambda v: v IS NOT NULL)[1:5]"


def _sql(kind: str, date: str) -> str:
    return rf"""WITH m AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant')),
  c AS (SELECT conv_id, count(*) AS n, '# Talk ' || conv_id || chr(10) || chr(10) || string_agg('**' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || '**: ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS x FROM m WHERE text <> '' GROUP BY 1)
  SELECT sha256(x) AS content, array_to_string(list_concat(['imported', '{kind}'], {_TOPICS}), ',') AS tags, CASE WHEN n > 10 THEN 0.7 ELSE 0.5 END::DOUBLE AS importance, {date} AS original_date FROM c"""


def _shown(rows):
    return rows.select(F.sha2("content", 256).alias("content"), F.array_join("tags", ",").alias("tags"), "importance", "original_date")


@query("s8_chatgpt", _sql("chatgpt", "strftime(to_timestamp(1700000000 + conv_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.000Z'"), raw=True)
def _(t):
    """Conversations as maps of nodes, a line each."""
    node = lambda m: F.struct(F.concat(F.lit("n"), m["turn"].cast("string"), F.lit("-"), F.xxhash64(m["role"], m["text"]).cast("string")), F.struct(F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content")).alias("message")))
    made = _turns(t).select(F.to_json(F.struct(F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), (F.lit(1700000000) + F.col("conv_id")).alias("create_time"), F.map_from_entries(F.transform("m", node)).alias("mapping"))).alias("value"))
    return _shown(I.read_import(t.spark, _written(t, made), "chatgpt", lines=True))


@query("s8_claude", _sql("claude", "'2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0')"), raw=True)
def _(t):
    """Conversations as lists of messages; every other one as typed parts."""
    sender = lambda m: F.when(m["role"] == "user", "human").otherwise(m["role"])
    plain = F.transform("m", lambda m: F.struct(sender(m).alias("sender"), m["text"].alias("text")))
    typed = F.transform("m", lambda m: F.struct(sender(m).alias("sender"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content")))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
    name = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    even = F.to_json(F.struct(name.alias("name"), day.alias("created_at"), plain.alias("chat_messages")))
    odd = F.to_json(F.struct(name.alias("title"), day.alias("updated_at"), typed.alias("messages")))
    made = _turns(t).select(F.when(F.col("conv_id") % 2 == 0, even).otherwise(odd).alias("value"))
    return _shown(I.read_import(t.spark, _written(t, made), "claude", lines=True))


@query("s8_json", "SELECT sha256(text) AS content, coalesce(lang, 'text') AS content_type, CAST(n_chars % 10 AS DOUBLE) / 10 AS importance, source AS tags FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0", raw=True)
def _(t):
    """Documents as records, a line each; every tenth line is a backup with one record."""
    one = F.struct(F.col("text").alias("content"), F.col("lang").alias("content_type"), (F.col("n_chars") % 10 / 10.0).alias("importance"), F.array("source").alias("tags"))
    none = F.array().cast("array<string>")
    backup = F.struct(F.lit(1).alias("version"), F.array(one).alias("memories"), none.alias("entities"), none.alias("memory_entities"), F.struct(F.lit("x").alias("k")).alias("settings"))
    made = t.documents.select(F.when(F.col("doc_id") % 10 == 0, F.to_json(backup)).otherwise(F.to_json(one)).alias("value"))
    found = I.read_import(t.spark, _written(t, made), "json", lines=True)
    return found.select(F.sha2("content", 256).alias("content"), "content_type", "importance", F.array_join("tags", ",").alias("tags"))


_BLOCKS = r"""SELECT sha256(b) AS content, length(b) AS chars FROM (SELECT regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\n\n+')), '^\s+|\s+$', '', 'g') AS b FROM conversations) WHERE b <> ''"""


@query("s8_chatexport", _BLOCKS, raw=True)
def _(t):
    """All turns as blocks between empty lines."""
    made = t.conversations.select(F.coalesce("text", F.lit("")).alias("value"))
    return I.read_import(t.spark, _written(t, made, whole=True), "chatexport").select(F.sha2("content", 256).alias("content"), F.length("content").alias("chars"))


@query("s8_markdown", r"""SELECT sha256(b) AS content, length(b) AS chars FROM (SELECT regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM benchmark) WHERE b <> ''""", raw=True)
def _(t):
    """Benchmark items as sections under headings, with rules between some of them."""
    head = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("## Item "), F.col("item_id").cast("string"))).otherwise("---")
    made = t.benchmark.select(F.concat(F.lit("\n"), head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))
    return I.read_import(t.spark, _written(t, made), "markdown").select(F.sha2("content", 256).alias("content"), F.length("content").alias("chars"))

"""Benchmark decontamination by winnowing.

A run of ``k`` words is hashed at each position, and the positions are kept
that hold the least hash of some window of ``w`` positions. With ``k + w - 1``
equal to the length of a benchmark window (13 words, or all words of a shorter
item), any shared span of that length contains a kept hash on both sides, so
joining the kept hashes misses nothing. Items are winnowed by their own length,
so that a short item leaves the others as they are. Each hit is then extended:
all windows around the shared run are compared word by word with the
benchmark's windows.

Only (document, hash, position) rows meet the benchmark's hashes; words are
read again for the documents that are hit, as slices. The benchmark side is
broadcast only where its counted rows stay under a fixed bound; otherwise both
sides are shuffled, the benchmark side having one row for each hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import keep, lower_ascii

#: What stands between words, which are letters, digits and everything outside ASCII.
ITEM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
#: Most rows of the benchmark side (with overhead under 100 MB) that are broadcast.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), ITEM_GAP), "")


def _doubling(w: int) -> str:
    """Shifts after which a running minimum or maximum spans ``w`` places."""
    steps, width = [], 1
    while 2 * width <= w:
        steps.append(width)
        width *= 2
    return "array(" + ", ".join(str(k) for k in steps + ([w - width] if w > width else [])) + ")"


def fingerprints(rows: DataFrame, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """(id, len, fp, at) of rows (id, words): the kept hashes for windows of each length; ``at`` counts words from 1."""
    made = rows
    for k in sorted({min(gram, n) for n in lengths}):
        run = ", ".join(["x", *[f"words[i + {j}]" for j in range(1, k)]])
        grams = f"CASE WHEN size(words) >= {k} THEN transform(slice(words, 1, size(words) - {k - 1}), (x, i) -> xxhash64({run})) ELSE cast(array() as array<bigint>) END"
        made = made.withColumn(f"_g{k}", F.expr(grams))
    for n in lengths:
        k = min(gram, n)
        w = n - k + 1
        g, low, top = f"_g{k}", f"_low{n}", f"_top{n}"
        if w == 1:
            kept = f"transform({g}, (x, i) -> named_struct('len', {n}, 'fp', x, 'at', i + 1))"
        else:
            none = "cast(array() as array<bigint>)"
            least = f"slice(aggregate({_doubling(w)}, {g}, (a, k) -> zip_with(a, slice(a, k + 1, size(a) - k), (x, y) -> least(x, y))), 1, size({g}) - {w - 1})"
            made = made.withColumn(low, F.expr(f"CASE WHEN size({g}) >= {w} THEN {least} ELSE {none} END"))
            # The largest of the minima of all windows around a position: the position's own hash where it is kept.
            most = f"aggregate({_doubling(w)}, {low}, (a, k) -> zip_with(a, concat(array_repeat(cast(null as bigint), k), a), (x, y) -> greatest(x, y)))"
            made = made.withColumn(top, F.expr(f"CASE WHEN size({low}) > 0 THEN {most} ELSE {none} END"))
            own = f"filter(transform({top}, (x, i) -> named_struct('len', {n}, 'fp', {g}[i], 'at', IF({g}[i] = x, i + 1, 0))), s -> s.at > 0)"
            kept = own
        made = made.withColumn(f"_kept{n}", F.expr(kept))
    return made.select("id", F.expr("inline(concat(" + ", ".join(f"_kept{n}" for n in lengths) + "))"))


def _windows(rows: DataFrame) -> DataFrame:
    """(item, len, window) of the items' windows, each once."""
    each = F.expr("transform(sequence(1, size(words) - len + 1), i -> concat_ws(' ', slice(words, i, len)))")
    return rows.select(F.col("id").alias("item"), "len", F.explode(each).alias("window")).distinct()


def contaminated_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, start, len, window) for each benchmark window found in a document, each once; and the items' windows (item, len, window).

    ``docs`` and ``items`` have columns (id, words). Start counts words from 1.
    """
    sized = keep(items.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window))))
    lengths = sorted(r["len"] for r in sized.select("len").distinct().collect()) or [window]  # at most ``window`` of them
    marks = []
    for n in lengths:
        marks.append(fingerprints(sized.where(F.col("len") == n).select("id", "words"), [n], gram).select("len", "fp"))
    prints = marks[0]
    for more in marks[1:]:
        prints = prints.unionAll(more)
    prints = keep(prints.distinct())
    in_items = keep(_windows(sized))
    # All of these come from the benchmark; their size is counted before any is broadcast.
    few = in_items.count() <= broadcast_rows and prints.count() <= broadcast_rows
    near = F.broadcast if few else (lambda df: df)

    hits = keep(fingerprints(docs, lengths, gram).join(near(prints), ["len", "fp"], "left_semi").select("id", "len", "at").distinct())
    places = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("len", "at"))).alias("hits"))
    places = F.broadcast(places) if hits.count() <= broadcast_rows else places
    # Every window that holds a hit's run of words, each once: hits are in order, and each adds the starts beyond those of the hit before it.
    low = "greatest(1, h.at + least({gram}, h.len) - h.len, IF(i > 0 AND hits[greatest(i - 1, 0)].len = h.len, least(hits[greatest(i - 1, 0)].at, size(words) - h.len + 1) + 1, 1))".format(gram=gram)
    around = f"transform(hits, (h, i) -> named_struct('len', h.len, 'low', {low}, 'high', least(h.at, size(words) - h.len + 1)))"
    spread = "flatten(transform(filter(around, h -> h.low <= h.high), h -> transform(sequence(h.low, h.high), i -> named_struct('start', i, 'len', h.len))))"
    found = docs.join(places.withColumnRenamed("id", "hit_id"), F.col("id").eqNullSafe(F.col("hit_id"))).select("id", "words", F.expr(around).alias("around"))
    found = found.select("id", "words", F.expr(spread).alias("at"))
    cut = found.select("id", F.inline(F.expr("transform(at, x -> named_struct('start', x.start, 'len', x.len, 'window', concat_ws(' ', slice(words, x.start, x.len))))")))
    known = in_items.select("len", "window").distinct()
    return keep(cut.join(near(known), ["len", "window"], "left_semi").select("id", "start", "len", "window").distinct()), near(in_items)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, text: str, doc_id: str, item_id: str, share: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns of ``decontaminate``, with ``id``, a struct of doc_id and text digest, in place of doc_id."""
    # Rows are named by their id and text, so that repeated ids cannot mix.
    name = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"))
    with_words = docs.select(name.alias("id"), words_of(F.col(text)).alias("words"))
    items = benchmark.select(F.col(item_id).alias("id"), words_of(F.col(text)).alias("words"))

    spans, in_items = contaminated_windows(with_words, items, window, GRAM, broadcast_rows)
    # Words covered: positions in order, each span counting what lies beyond the last end.
    covered = "aggregate(sort_array(collect_set(struct(start, start + len as stop))), named_struct('n', 0, 'end', 0), " \
        "(acc, s) -> named_struct('n', acc.n + greatest(0, s.stop - greatest(s.start, acc.end)), 'end', greatest(acc.end, s.stop)), acc -> cast(acc.n as bigint))"
    n_hit = spans.groupBy("id").agg(F.expr(covered).alias("n_hit"))

    digest = F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("item").cast("string"))), ","), 256)
    per_items = (
        spans.select("id", "len", "window").distinct().join(in_items, ["len", "window"])
        .groupBy("id")
        .agg(F.count_distinct("item").alias("n_items"), digest.alias("items_sha256"))
    )
    found = n_hit.join(per_items, "id", "left").withColumnRenamed("id", "found_id")
    counted = with_words.select("id", F.size("words").cast("long").alias("n_words"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, counted.id.eqNullSafe(found.found_id), "left").select(
        "id",
        "n_words",
        n.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n > 0) & (share * n >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    share: int = 20,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each document id: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of ``window`` consecutive
    words of an item (or of a whole item that has fewer). A document is
    contaminated if ``n_hit > 0`` and ``share * n_hit >= n_words``. Null texts
    have no words; items without words never match, and an item with a null id
    hits words but is neither counted nor listed. Rows that repeat a doc_id
    stay separate rows: equal texts get equal results, and rows of one id with
    different texts are told apart by their text's digest. A null doc_id is an
    id like any other. An empty benchmark hits nothing. Only the named columns
    are read, so that others may have any name.
    """
    return _judged(docs, benchmark, window, text, doc_id, item_id, share, broadcast_rows).select("id.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows of one id are told apart by their text."""
    judged = _judged(docs, benchmark, WINDOW, text, doc_id, "item_id", 20)
    bad = judged.where("contaminated").select(F.col("id.doc_id").alias("bad"), F.col("id.h").alias("bad_h")).distinct()
    # The row travels as one struct, so that its columns may have any name.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("own"), F.xxhash64(F.col(text)).alias("own_h"))
    clean = rows.join(bad, F.col("own").eqNullSafe(F.col("bad")) & (F.col("own_h") == F.col("bad_h")), "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same in DuckDB's SQL, by comparing all windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

"""Ranked lexical search over an inverted index with block maxima (Block-Max WAND).

The index is dealt by document: a segment holds some megabytes of whole texts,
and for each of its terms a posting list in compressed blocks of ``BLOCK``
documents. A block's head has its first and last document and its maximum impact, so that
a search moves over heads alone (the shallow moves) and decompresses a block
only if the sum of the maxima that meet there reaches the threshold, the score
of a query's tenth document so far. Stretches with the greatest sums come first,
which raises the threshold early; it is carried from segment to segment of a
task. Segments need no exchange to be built; a search moves the lists of its own
terms only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import _kernel as K
from sparkloom.llm._base import keep, lower_ascii, shared_dir
from sparkloom.llm.order_minhash import LOWER
from sparkloom.shipping import ship

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a posting block.
BLOCK = 128
#: Text bytes and documents of a segment (a longer text is a segment of its own).
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 8192
#: Queries that are searched in one pass over the index.
QUERIES = 500
TOP = 10
#: Documents looked at before the threshold is tested again.
STRETCHES = (256, 2048)

INDEX = "segment long, term string, df int, heads binary, body binary"
HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("impact", "<u4"), ("offset", "<u4"), ("n", "<u2"), ("gap", "u1"), ("tf", "u1")])
_NULL = -(1 << 63)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all terms, and each text's first term."""
    return LOWER[data], *K.runs(K.ALNUM[data], offsets)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for _, data, offsets in K.small_batches(batches, "text"):
        n = np.diff(K.runs(K.ALNUM[data], offsets)[2])
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _put(out: np.ndarray, values: np.ndarray, at: np.ndarray, width: np.ndarray) -> None:
    for j in range(4):
        some = width > j
        out[at[some] + j] = (values[some] >> (8 * j)) & 255


def _segment(segment: int, ids: np.ndarray, parts: list[tuple[pa.Array, np.ndarray]], docs: int, total: int) -> pa.RecordBatch | None:
    """Rows of ``INDEX``: the documents (term '') and the posting list of each term.

    ``parts`` are the term values in order, and how many each document has.
    """
    n = np.concatenate([p[1] for p in parts])
    held = n > 0
    if not held.any():
        return None
    place = np.cumsum(held) - 1
    ids, m = ids[held], 25 + (75 * n[held] * docs) // total
    # Documents by ascending id, so that lists are in the order of ties.
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, m = ids[order], m[order]
    coded = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
    words = coded.dictionary
    doc = rank[place[np.repeat(np.arange(len(n)), n)]]
    key, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(ids) + doc, return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    fresh = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(fresh, len(term)))
    inside = np.arange(len(term)) - np.repeat(fresh, df)
    gap = doc - np.append(-1, doc[:-1])
    gap[fresh] = doc[fresh] + 1
    starts = np.flatnonzero(inside % BLOCK == 0)
    sizes = np.diff(np.append(starts, len(term)))
    wide_gap, wide_tf = _widths(np.maximum.reduceat(gap, starts)), _widths(np.maximum.reduceat(tf, starts))
    block_bytes = sizes * (wide_gap + wide_tf)
    at = np.concatenate([[0], np.cumsum(block_bytes)])
    body = np.empty(at[-1], np.uint8)
    block = np.repeat(np.arange(len(starts)), sizes)
    local = np.arange(len(term)) - starts[block]
    _put(body, gap, at[block] + local * wide_gap[block], wide_gap[block])
    _put(body, tf, at[block] + sizes[block] * wide_gap[block] + local * wide_tf[block], wide_tf[block])
    blocks = -(-df // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    heads = np.zeros(len(starts), HEAD)
    heads["first"] = doc[starts]
    heads["last"], heads["n"], heads["gap"], heads["tf"] = doc[starts + sizes - 1], sizes, wide_gap, wide_tf
    heads["impact"] = np.maximum.reduceat(impact(tf, m[doc]), starts)
    heads["offset"] = at[:-1] - np.repeat(at[first_block[:-1]], blocks)

    raw_heads = np.concatenate([ids.astype("<i8").view(np.uint8), heads.view(np.uint8)])
    raw_body = np.concatenate([m.astype("<i8").view(np.uint8), body])
    head_at = np.append(0, 8 * len(ids) + first_block * HEAD.itemsize)
    body_at = np.append(0, 8 * len(ids) + at[first_block])
    as_binary = lambda offsets, raw: pa.Array.from_buffers(pa.large_binary(), len(df) + 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(df) + 1, segment, np.int64)),
            pa.concat_arrays([pa.array([""]), words.cast(pa.string()).take(pa.array(term[fresh]))]),
            pa.array(np.append(len(ids), df).astype(np.int32)),
            as_binary(head_at, raw_heads),
            as_binary(body_at, raw_body),
        ],
        ["segment", "term", "df", "heads", "body"],
    )


def _index(docs: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        parts, ids, size, rows = [], [], 0, 0

        def closed():
            nonlocal parts, ids, size, rows, segment
            made = _segment(segment, np.concatenate(ids), parts, docs, total) if rows else None
            parts, ids, size, rows, segment = [], [], 0, 0, segment + 1
            return [made] if made else []

        for batch, data, offsets in K.small_batches(batches, "text"):
            if rows and (size + len(data) > SEGMENT_BYTES or rows + batch.num_rows > SEGMENT_DOCS):
                yield from closed()
            low, starts, ends, first = _tokens(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(ends - starts)])
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            body = low[np.cumsum(inside[:-1]) > 0]
            parts.append((pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]), np.diff(first)))
            ids.append(np.asarray(batch.column("doc_id")))
            size, rows = size + len(data), rows + batch.num_rows
        yield from closed()

    return run


def build_index(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the index of all documents to ``folder``: posting lists by segment and term, and the table's counts.

    Documents without a term (null, empty) are not in it. A null id counts as
    the least one; repeated ids are documents of their own. Other columns are
    ignored.
    """
    ship(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("doc_id"), F.col(text).alias("text"))
    counts = read.mapInArrow(_counted, "docs long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms")])
    counts.write.parquet(f"{folder}/counts")
    n, total = docs.sparkSession.read.parquet(f"{folder}/counts").first()
    # In order of terms, so that a reader can leave out row groups.
    read.mapInArrow(_index(n, max(1, total)), INDEX).sortWithinPartitions("term").write.parquet(f"{folder}/lists")


class _List:
    """One term's posting list in a segment; blocks are decompressed when they are asked for, once."""

    def __init__(self, heads: bytes, body: bytes, m: np.ndarray) -> None:
        self.heads, self.body, self.m = np.frombuffer(heads, HEAD), body, m
        n = self.heads["n"].astype(np.int64)
        self.first, self.last, self.most = (self.heads[c].astype(np.int64) for c in ("first", "last", "impact"))
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.docs, self.impacts, self.open = np.empty(self.at[-1], np.int64), np.empty(self.at[-1], np.int64), np.zeros(len(n), bool)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the given blocks (ascending)."""
        for b in blocks[~self.open[blocks]].tolist():
            head, a, z = self.heads[b], self.at[b], self.at[b + 1]
            n, offset, wide = int(head["n"]), int(head["offset"]), int(head["gap"])
            gaps = np.frombuffer(self.body, f"<u{wide}", n, offset)
            tf = np.frombuffer(self.body, f"<u{head['tf']}", n, offset + n * wide).astype(np.int64)
            self.docs[a:z] = np.cumsum(gaps, dtype=np.int64) + (self.last[b - 1] if b else -1)
            self.impacts[a:z] = impact(tf, self.m[self.docs[a:z]])
            self.open[b] = True
        if len(blocks) == len(self.open):
            return self.docs, self.impacts
        if blocks[-1] - blocks[0] + 1 == len(blocks):
            part = slice(self.at[blocks[0]], self.at[blocks[-1] + 1])
            return self.docs[part], self.impacts[part]
        parts = [slice(self.at[b], self.at[b + 1]) for b in blocks.tolist()]
        return np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.impacts[p] for p in parts])


class Ranking:
    """The best documents of one query so far: falling scores, equal ones by ascending id."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """The least score that may still get in (an equal one, by its id)."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.threshold
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            best = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[best], ids[best]


def search_segment(lists: dict[str, _List], ids: np.ndarray, query: list[tuple[str, int]], ranking: Ranking) -> None:
    """Add a segment's documents to the ranking; ``query`` has (term, weight times repeats)."""
    held = [(lists[t], w) for t, w in query if w and t in lists]
    if not held:
        return
    # Between two such places, each list has one block at most; the sum of their maxima bounds every document there.
    ends = np.unique(np.concatenate([part for x, _ in held for part in (x.last, x.first[x.first > 0] - 1)]))
    bound, blocks = np.zeros(len(ends), np.int64), []
    for x, w in held:
        b = np.searchsorted(x.last, ends)
        inside = b < len(x.last)
        inside[inside] = x.first[b[inside]] <= ends[inside]
        b[~inside] = len(x.last)
        blocks.append(b)
        bound[inside] += w * x.most[b[inside]]
    lengths = np.diff(np.append(-1, ends))
    order = np.argsort(-bound, kind="stable")
    upto = np.cumsum(lengths[order])
    done = 0
    for size in (*STRETCHES, int(upto[-1])):
        open_ = int(np.searchsorted(-bound[order], -ranking.threshold, "right"))
        stop = min(open_, int(np.searchsorted(upto, size)) + 1)
        if stop <= done:
            if open_ <= done:
                return
            continue
        chosen = np.zeros(len(ends), bool)
        chosen[order[done:stop]] = True
        done = stop
        wanted = np.repeat(chosen, lengths)
        score = np.zeros(len(wanted), np.int64)
        for (x, w), b in zip(held, blocks, strict=True):
            need = np.unique(b[chosen])
            need = need[need < len(x.last)]
            if len(need):
                docs, impacts = x.postings(need)
                inside = docs < len(wanted)
                score[docs[inside]] += w * impacts[inside]
        found = np.flatnonzero(wanted & (score >= ranking.threshold))
        ranking.add(score[found], ids[found])


def _searcher(queries: list[tuple[int, list[tuple[str, int]]]], top: int):
    """From rows of ``INDEX`` sorted by segment and term: each query's best documents of the task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(top) for _ in queries]
        segment, lists, ids, m = None, {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def searched():
            for (_, query), ranking in zip(queries, rankings, strict=True):
                search_segment(lists, ids, query, ranking)

        for batch in batches:
            columns = [batch.column(c) for c in ("segment", "term", "heads", "body")]
            for s, term, heads, body in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True):
                if s != segment:
                    searched()
                    segment, lists, ids, m = s, {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
                if term == "":
                    ids, m = np.frombuffer(heads.as_py(), "<i8"), np.frombuffer(body.as_py(), "<i8")
                else:
                    lists[term] = _List(heads.as_py(), body.as_py(), m)
        searched()
        sizes = [len(r.scores) for r in rankings]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([q for q, _ in queries], np.int64), sizes)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *[r.ids for r in rankings]])),
                pa.array(np.concatenate([np.zeros(0, np.int64), *[r.scores for r in rankings]])),
            ],
            ["q", "doc_id", "score"],
        )

    return run


def search_index(spark: SparkSession, folder: str, items: DataFrame, text: str = "text", item_id: str = "item_id", top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score.

    Every row of ``items`` is a query of its own, repeated or null ids too; null
    and empty texts, and terms that no document has, find nothing. Queries are
    taken in blocks of ``QUERIES``, each of which reads the lists of its terms
    once. Equal scores go by ascending doc_id, a null one first.
    """
    ship(spark)
    n = spark.read.parquet(f"{folder}/counts").first()["docs"]
    lists = spark.read.schema(INDEX).parquet(f"{folder}/lists")
    named = keep(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("q", F.monotonically_increasing_id()))
    terms = named.select("q", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    counted = keep(terms.groupBy("q", "term").agg(F.count(F.lit(1)).alias("tf")))
    blocks = max(1, math.ceil(named.count() / QUERIES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for b in range(blocks):
        rows = counted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({r["term"] for r in rows} | {""})], "term string"))
        own = lists.join(wanted, "term", "left_semi")
        df = {r[0]: r[1] for r in own.where("term <> ''").groupBy("term").agg(F.sum("df")).collect()}
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in rows:
            if r["term"] in df:
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[r["term"]] + 1)))
                queries.setdefault(r["q"], []).append((r["term"], weight * r["tf"]))
        dealt = own.repartition(parts, "segment").sortWithinPartitions("segment", "term")
        part = dealt.mapInArrow(_searcher(sorted(queries.items()), top), "q long, doc_id long, score long")
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(named.select("q", "item_id")) if blocks == 1 else named.select("q", "item_id"), "q").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score"
    )


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index all documents in the shared folder, and rank them for every item."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    build_index(docs, folder)
    return search_index(spark, folder, items)


#: The same in DuckDB's SQL, without an index.
ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM d, g),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

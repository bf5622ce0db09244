"""Full-text scores of very many queries at once.

A join of queries and documents by term has a row for each pair that shares a
term, which is most of all pairs once queries hold common words. Here texts are
read once into term numbers and counts, which are written to the shared folder;
each task then scores all queries against its own documents and hands on its
best ones only, so that what moves grows with the queries and not with the
pairs. Every pair that shares a term is scored; nothing is left out before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import stored
from sparkloom.operators.postings import K1, B, idf, tokens
from sparkloom.shipping import ship

#: Queries that are scored in one pass over the counts, and documents that a task scores at once.
BLOCK, DOCS = 20_000, 32_768
#: Places to which scores are rounded before they are compared, as in ``search``.
PLACES = 9


def _count(terms: pa.Array, weights: list[float]):
    """(id, len, code, tf): the terms of each record by number, ascending, with their weighted counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            length, row, code, weight = np.zeros(n, np.int64), [], [], []
            for j, b in enumerate(weights):
                column = batch.column(f"t{j}")
                sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                length += sizes
                found = np.asarray(pc.index_in(column.flatten(), value_set=terms).fill_null(-1))
                known = np.flatnonzero(found >= 0)
                row.append(np.repeat(np.arange(n), sizes)[known])
                code.append(found[known].astype(np.int64))
                weight.append(np.full(len(known), b))
            key, at = np.unique(np.concatenate(row) * max(1, len(terms)) + np.concatenate(code), return_inverse=True)
            tf = np.bincount(at, np.concatenate(weight), len(key))
            rows, codes = np.divmod(key, max(1, len(terms)))
            ends = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(length), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf))], ["id", "len", "code", "tf"]
            )

    return run


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, the first of equals."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


class _Best:
    """The k best documents of a query so far: by rounded score, equal ones by id."""

    __slots__ = ("k", "ids", "scores", "rounded", "least")

    def __init__(self, k: int) -> None:
        self.k, self.least = k, -np.inf
        self.ids, self.scores, self.rounded = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """More documents, in order of their ids."""
        kept = np.flatnonzero(scores >= self.least - 2 * 10.0**-PLACES)
        if not len(kept):
            return
        ids, scores = ids[kept], scores[kept]
        rounded = np.round(scores, PLACES)
        some = _first(rounded, self.k)
        ids, scores, rounded = (np.concatenate(x) for x in ((self.ids, ids[some]), (self.scores, scores[some]), (self.rounded, rounded[some])))
        order = np.lexsort((ids, -rounded))[: self.k]
        self.ids, self.scores, self.rounded = ids[order], scores[order], rounded[order]
        if len(order) == self.k:
            self.least = self.rounded[-1]


def _score(asked: list[np.ndarray], heads: list[int], terms: list[int], weight: np.ndarray, avg_len: float, k_all: int, k_any: int):
    """(query, every, id, score): the best documents with all head terms (``every``), and with any term, of a task's documents.

    ``asked`` has the numbers of each query's terms that occur, head terms
    first; ``heads`` how many of them are head terms, or -1 if one occurs
    nowhere or there are too few; ``terms`` how many numbers there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(_Best(k_all), _Best(k_any)) for _ in asked]

        def flush(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks().sort_by("id")
            ids, length = np.asarray(rows["id"].combine_chunks()), np.asarray(rows["len"].combine_chunks()).astype(float)
            sizes = np.asarray(pc.list_value_length(rows["code"]).combine_chunks()).astype(np.int64)
            code = np.asarray(pc.list_flatten(rows["code"]).combine_chunks())
            tf = np.asarray(pc.list_flatten(rows["tf"]).combine_chunks())
            at = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
            gain = weight[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / avg_len))
            order = np.argsort(code, kind="stable")
            at, gain = at[order], gain[order]
            start = np.searchsorted(code[order], np.arange(terms + 1))
            total, none = np.zeros(len(ids)), np.zeros(0, np.int32)
            for q, own in enumerate(asked):
                lists = [at[start[w] : start[w + 1]] for w in own]
                total[:] = 0.0
                every = none
                for i, w in enumerate(own):
                    total[lists[i]] += gain[start[w] : start[w + 1]]
                    if i + 1 == heads[q]:
                        heads_of = sorted(lists[: i + 1], key=len)
                        every = heads_of[0]
                        for other in heads_of[1:]:
                            if not len(every) or not len(other):
                                every = none
                                break
                            place = np.minimum(np.searchsorted(other, every), len(other) - 1)
                            every = every[other[place] == every]
                        if len(every):
                            best[q][0].add(ids[every], total[every])
                least = best[q][1].least
                some = np.flatnonzero(total >= least - 2 * 10.0**-PLACES) if least > 0 else np.flatnonzero(total > 0)
                some = some[total[some] > 0]
                best[q][1].add(ids[some], total[some])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held >= DOCS:
                flush(parts)
                parts, held = [], 0
        if held:
            flush(parts)
        for q in range(0, len(asked), 1000):
            found = [(n, every, b) for n, pair in enumerate(best[q : q + 1000], q) for every, b in zip((True, False), pair, strict=True) if len(b.ids)]
            if found:
                sizes = [len(b.ids) for _, _, b in found]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids, scores = pa.array(np.concatenate([b.ids for _, _, b in found])), pa.array(np.concatenate([b.scores for _, _, b in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _, _ in found], pa.int32()), pa.array([e for _, e, _ in found]), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, scores)], ["query", "every", "id", "score"]
                )

    return run


def best_of_both(terms: DataFrame, docs: DataFrame, k_all: int, k_any: int, heads: int = 8, least_heads: int = 3, boost: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, every, id, score): the best documents with all of the first terms of a query (``every``), and with any of its terms.

    ``terms`` has query_id (each once) and its distinct terms t in their order,
    ``docs`` id (an integer, each once) and the text columns of ``boost``. The
    queries, a few words each, and their distinct terms are on the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    boost = boost or {"content": 1.0}
    table = terms.select("query_id", "t").toArrow()
    names, lists = table.column("query_id").combine_chunks(), table.column("t").to_pylist()
    known = pc.unique(table.column("t").combine_chunks().flatten())
    number = {w: i for i, w in enumerate(known.to_pylist())}
    read = docs.select(F.col("id").cast("long").alias("id"), *[tokens(F.col(c)).alias(f"t{j}") for j, c in enumerate(boost)])
    counts = stored(read.mapInArrow(_count(known, list(boost.values())), "id long, len long, code array<int>, tf array<double>"))
    n_docs, avg_len = counts.agg(F.count(F.lit(1)), F.avg("len")).first()
    df = counts.select(F.explode("code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("code", idf(F.lit(n_docs), F.col("df")).alias("idf")).toArrow()  # a row for each term
    weight = np.zeros(len(known))
    weight[np.asarray(weights.column("code").combine_chunks())] = np.asarray(weights.column("idf").combine_chunks())
    key = terms.schema["query_id"].dataType.simpleString()
    found = None
    for at in range(0, len(lists) or 1, block):
        asked, head = [], []
        for words in lists[at : at + block]:
            numbers = np.array([number[w] for w in words], np.int64)
            first = numbers[:heads]
            head.append(len(first) if len(first) >= least_heads and (weight[first] > 0).all() else -1)
            asked.append(numbers[weight[numbers] > 0])
        best = counts.mapInArrow(_score(asked, head, len(known), weight, avg_len or 1.0, k_all, k_any), "query int, every boolean, id array<long>, score array<double>")
        own = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(asked), dtype=np.int32)), "query_id": names[at : at + block]})).select("query", F.col("query_id").cast(key).alias("query_id"))
        # Dealt by query once; the order below needs no further exchange.
        dealt = best.join(F.broadcast(own), "query").select("query_id", "every", F.arrays_zip("id", "score").alias("x")).repartition("query_id")
        rows = dealt.select("query_id", "every", F.inline("x")).withColumn("score", F.round("score", PLACES))
        order = Window.partitionBy("query_id", "every").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("every"), k_all).otherwise(k_any)).drop("r")
        found = rows if found is None else found.unionAll(rows)
    return stored(found)

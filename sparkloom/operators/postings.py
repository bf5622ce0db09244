"""Persistent posting lists for full-text search.

The lists are written once, in blocks of a term and a range of ids, with each
document's length, and read by every search: only the buckets of the query's
terms are opened. Blocks of all terms share their ranges, so that the maxima of
a block (its greatest count and its shortest document) bound the score of a
whole range for a query; ranges that cannot hold one of the best documents are
left out before their lists are opened.

Changed and deleted records are written as a further version beside the lists.
The newest version of a record counts; ``compact`` writes one version again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import checkpointed

#: Ids of a range, and buckets that terms are dealt to.
RANGE, BUCKETS = 1024, 64
#: Query terms that are named to the reader of the files, so that it can leave out parts of them.
NAMED_TERMS = 1000
K1, B = 1.2, 0.75
PLACES, SLACK = 9, 1e-6


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def counted(docs: DataFrame, boost: dict[str, float] | None = None) -> DataFrame:
    """(id, ws, len): each record's tokens (w, b) from the columns of ``boost``, with its weights, and their number."""
    boost = boost or {"content": 1.0}
    weighted = lambda b: lambda w: F.struct(w.alias("w"), F.lit(b).alias("b"))
    return docs.select("id", F.concat(*[F.transform(tokens(F.col(c)), weighted(b)) for c, b in boost.items()]).alias("ws")).withColumn("len", F.size("ws"))


def gain(tf: Column, length: Column, idf: Column, avg_len: Column) -> Column:
    """The BM25 gain of a term."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.ln((n_docs - df + 0.5) / (df + 0.5)))


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


@dataclass
class Postings:
    """Posting lists in a folder; ``boost`` weighs the text columns that they were made from."""

    spark: SparkSession
    folder: str
    versions: int = 1
    boost: dict[str, float] = field(default_factory=lambda: {"content": 1.0})

    def _write(self, docs: DataFrame, deleted: DataFrame | None, version: int) -> None:
        rows = counted(docs, self.boost)
        records = rows.select("id", "len", F.lit(False).alias("gone"))
        if deleted is not None:
            records = records.unionByName(deleted.select("id", F.lit(0).alias("len"), F.lit(True).alias("gone")))
        records.write.parquet(f"{self.folder}/records/version={version}")
        each = rows.select("id", "len", F.inline("ws")).groupBy("id", "len", "w").agg(F.sum("b").alias("tf"))
        blocks = each.groupBy("w", F.floor(F.col("id") / RANGE).alias("range")).agg(
            F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("list"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest")
        )
        dealt = blocks.withColumn("bucket", _bucket(F.col("w"))).repartitionByRange("bucket", "w", "range").sortWithinPartitions("bucket", "w", "range")
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/lists/version={version}")

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> Postings:
        """The lists with new or changed records (each id once) and without the deleted ids; only these are tokenised."""
        self._write(changed, deleted, self.versions)
        return Postings(self.spark, self.folder, self.versions + 1, self.boost)

    def compact(self, folder: str) -> Postings:
        """The same lists as one version, in a new folder; texts are not read."""
        self.live().select("id", "len", F.lit(False).alias("gone")).write.parquet(f"{folder}/records/version=0")
        lists = self._fresh(self._lists().select("version", "bucket", "w", "range", F.inline("list")))
        blocks = lists.groupBy("bucket", "w", "range").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("list"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"))
        blocks.repartitionByRange("bucket", "w", "range").sortWithinPartitions("bucket", "w", "range").write.partitionBy("bucket").parquet(f"{folder}/lists/version=0")
        return Postings(self.spark, folder, 1, self.boost)

    def _versions(self, what: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{what}").parquet(*[f"{self.folder}/{what}/version={v}" for v in range(self.versions)])

    def _lists(self) -> DataFrame:
        return self._versions("lists")

    def live(self) -> DataFrame:
        """(id, len, version) of the records that count."""
        rows = self._versions("records")
        if self.versions > 1:
            rows = rows.groupBy("id").agg(F.max_by(F.struct("len", "gone", "version"), "version").alias("r")).select("id", "r.*")
        return rows.where("NOT gone").select("id", "len", "version")

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """Rows (version, id, …) without those of an older version of their record."""
        if self.versions == 1:
            return rows.drop("version")
        newer = self._versions("records").where("version > 0").groupBy("id").agg(F.max("version").alias("newest"))
        return rows.join(newer, "id", "left").where("newest IS NULL OR newest = version").drop("version", "newest")

    def stats(self) -> DataFrame:
        """(n_docs, avg_len), one row."""
        return self.live().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of the terms (w): only their buckets are read, and few terms are named to the reader."""
        asked = terms.select("w").distinct()
        few = [r["w"] for r in asked.limit(NAMED_TERMS + 1).collect()]
        rows = self._lists()
        if len(few) <= NAMED_TERMS:
            own = self.spark.createDataFrame([(w,) for w in few], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect()
            return rows.where(F.col("bucket").isin([r["b"] for r in own]) & F.col("w").isin(few)) if few else rows.limit(0)
        return rows.join(asked, "w", "left_semi")

    def hits(self, terms: DataFrame) -> DataFrame:
        """(id, len, w, tf) of the terms' occurrences."""
        return self._fresh(self.blocks(terms).select("version", "w", F.inline("list"))).select("id", "len", "w", "tf")

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of the ``k`` best records of each query (query_id, term), equal ones by id.

        Ranges with the greatest bounds are scored first, as many as have k
        records; the k-th score then leaves out all ranges below it.
        """
        flat = checkpointed(queries.select("query_id", F.col("term").alias("w")).distinct())
        blocks = self.blocks(flat)
        one = self.stats()
        if self.versions > 1:
            # Counts of blocks may hold older versions; the exact ones come from the lists.
            df = self.hits(flat).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
        else:
            df = blocks.groupBy("w").agg(F.sum("n").alias("df"))
        weights = checkpointed(df.crossJoin(F.broadcast(one)).select("w", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len"))
        asked = flat.join(weights, "w")
        bound = gain(F.col("most"), F.col("shortest"), F.col("idf"), F.col("avg_len"))
        bounds = blocks.select("w", "range", "n", "most", "shortest").join(asked, "w").groupBy("query_id", "range").agg(F.sum(bound).alias("bound"), F.max("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        bounds = checkpointed(bounds.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))

        def scored(ranges: DataFrame) -> DataFrame:
            lists = blocks.select("version", "w", "range", "list").join(asked.join(ranges, "query_id"), ["w", "range"]).select("version", "query_id", "idf", "avg_len", F.inline("list"))
            rows = self._fresh(lists).groupBy("query_id", "id").agg(F.sum(gain(F.col("tf"), F.col("len"), F.col("idf"), F.col("avg_len"))).alias("s"))
            return rows.select("query_id", "id", F.round("s", PLACES).alias("score"))

        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        top = lambda rows: rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        first = checkpointed(top(scored(bounds.where(F.col("before") < k).select("query_id", "range"))))
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.where(F.col("before") >= k).join(least, "query_id", "left").where((F.col("bound") >= F.col("least") - SLACK) | F.col("least").isNull())
        return top(first.drop("rank").unionByName(scored(rest.select("query_id", "range"))))


def build_postings(docs: DataFrame, folder: str, boost: dict[str, float] | None = None) -> Postings:
    """Write the lists of all records (id and the text columns of ``boost``) to a new folder.

    Null and empty texts have no terms but count as records. Ids are not null
    and occur once. Other columns are ignored.
    """
    made = Postings(docs.sparkSession, folder, 1, boost or {"content": 1.0})
    made._write(docs, None, 0)
    return made

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; words are what lies between. (Splitting is much faster in Spark than counting or extracting matches.)
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local
    mode, where driver and executors are one process.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc.getCheckpointDir():
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sparkloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the shared folder.

    For loops: a checkpoint keeps the planner's estimate of its size, which
    joins multiply, so that after a dozen rounds the estimates alone fill the
    driver; a table's size is that of its files.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sql_value(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if kind == "string":
        return f"cast(X'{str(value).encode().hex()}' as string)"
    return f"cast('{value!r}' as {kind})"


def rows_of(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small literal table as a local relation, without any RDD."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    names = ", ".join(name for name, _ in fields)
    line = lambda row: "(" + ", ".join(_sql_value(v, kind) for v, (_, kind) in zip(row, fields, strict=True)) + ")"
    rows = list(rows)
    found = spark.sql(f"SELECT * FROM VALUES {', '.join(map(line, rows or [[None] * len(fields)]))} AS t({names})")
    return found if rows else found.where(F.lit(False))


def settled(df: DataFrame, most: int = 1000) -> DataFrame:
    """Cut the lineage of a table that is mostly tiny: as literal rows while it has at most ``most``, else as a checkpoint."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return keep(df)
    return rows_of(df.sparkSession, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


#: Distinct scores of one range in ``best_cut``.
RANGE = 100_000


def best_cut(scored: DataFrame, lost: int | None = None) -> tuple[float | None, float | None] | None:
    """The neighbours of the cut with the least cost among all rows of ``scored`` (score, good).

    Good rows below a cut cost ``lost`` each, other rows from it on 1 each;
    without ``lost`` both classes weigh the same in all. Equal scores are not
    separated; of equal cuts the lowest holds. Returns the score below the cut
    (null: none) and the one above it (null: none), or null without rows of
    both classes. Only sums of ranges of scores and the cut are gathered.
    """
    by = keep(scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")))
    n, good, bad = by.agg(F.count(F.lit(1)), F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not good or not bad:
        return None
    lost, kept = (bad, good) if lost is None else (lost, 1)
    # Written, so that the ranges stay as they are.
    ranged = keep(by.repartitionByRange(max(1, n // RANGE), "score").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.sum("g").alias("gs"), F.sum("b").alias("bs"))
    starts = ranges.select("range", F.max("most").over(before).alias("most"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("gs", "bs")])
    inside = Window.partitionBy("range").orderBy("score")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(c + "s") + F.coalesce(F.sum(c).over(so_far), F.lit(0))
    costs = ranged.join(F.broadcast(starts), "range").select(
        (below("g") * lost + (F.lit(bad) - below("b")) * kept).alias("cost"), "score", F.coalesce(F.lag("score").over(inside), "most").alias("below")
    )
    best, most = costs.agg(F.min(F.struct("cost", "score", "below")), F.max("score")).first()
    return (most, None) if good * lost < best["cost"] else (best["below"], best["score"])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_array(values: Iterable[float], kind: str) -> Column:
    """A constant array of bounded length, as one literal."""
    values = list(values)
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.from_json(F.lit("[" + ",".join(repr(v) for v in values) + "]"), f"array<{kind}>")

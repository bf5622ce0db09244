"""Sinks and backups: versioned Parquet snapshots, JSON exports, encryption, verification."""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int, keep: int = 7) -> list[int]:
    """Write every table under ``root/v=<version>`` and return the versions to keep; older ones are removed.

    Paths go through Hadoop's file system, so that any store Spark reads will do.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    for old in found[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/v={old}"), True)
    return found[-keep:]


def read_snapshot(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}/{name}")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_json(existing: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows of a JSON export that the table doesn't have yet, appended to it."""
    new = existing.sparkSession.read.schema(existing.schema).json(path)
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*existing.columns))


def derive_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(body: Column, key: bytes) -> Column:
    """Authenticated encryption (GCM) of a text column, base64."""
    return F.base64(F.aes_encrypt(body, F.lit(key), F.lit("GCM")))


def decrypted(body: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(body), F.lit(key), F.lit("GCM")).cast("string")


def write_encrypted(df: DataFrame, path: str, password: str) -> None:
    """A backup of rows as encrypted JSON, with the salt of its key beside them."""
    salt = secrets.token_bytes(16)
    row = encrypted(F.to_json(F.struct(*df.columns)), derive_key(password, salt))
    df.select(row.alias("row"), F.lit(salt.hex()).alias("salt")).write.parquet(path)


def read_encrypted(spark: SparkSession, path: str, password: str, schema) -> DataFrame:
    """The rows of an encrypted backup; a wrong password fails."""
    rows = spark.read.parquet(path)
    first = rows.select("salt").first()
    if first is None:
        return spark.createDataFrame([], schema)
    plain = decrypted(F.col("row"), derive_key(password, bytes.fromhex(first["salt"])))
    return rows.select(F.from_json(plain, schema).alias("r")).select("r.*")


def verify_counts(source: dict[str, DataFrame], copy: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table in the source and in the copy, and whether they agree."""
    one = lambda name, side, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
    rows = [one(n, "source", d) for n, d in source.items()] + [one(n, "copy", d) for n, d in copy.items()]
    counted = reduce(DataFrame.unionByName, rows).groupBy("table")
    wide = counted.agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("source", "copy")])
    return wide.withColumn("same", F.col("source") == F.col("copy"))

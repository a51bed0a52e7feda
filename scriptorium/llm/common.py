"""What the operators of this package share: words, shared storage and sized joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it was counted and has no more rows than this; if it is one column of hashes, than that.
BROADCAST_ROWS, BROADCAST_HASHES = 20_000, 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def named(names: list[str]) -> list[Column]:
    """Columns by their names, which may hold dots and backticks."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in names]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary folder is made if driver and executors are one process
    (local tests); anywhere else that is an error, as executors write where the driver can't read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables from which nothing will be computed any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_sized(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored table, broadcast only if its counted rows stay within the bound of its kind."""
    most = BROADCAST_HASHES if [t for _, t in small.dtypes] == ["bigint"] else BROADCAST_ROWS
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return df.join(small, on, how)


def null_safe_key(column: str) -> Column:
    """A string that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def ranked_within(df: DataFrame, keys: list[str], tie: list[Column], part_rows: int = 200_000) -> DataFrame:
    """df with rank: 0, 1, 2, … within keys, in the order of a hash of the ties.

    No window sees more than one part of a group, and there are so many parts that the largest group's
    hold about part_rows each: counts of (keys, part) come first, their running sums give each part's
    first rank, and rows are only numbered inside their part. df is a stored table.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // part_rows))
    df = df.withColumn("__hash", F.xxhash64(*tie)).withColumn("__part", F.pmod("__hash", F.lit(parts)).cast("int"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    firsts = stored(df.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(before, F.lit(0))).drop("__n"))
    df = df.withColumn("__row", F.row_number().over(W.partitionBy(*keys, "__part").orderBy("__hash", *tie)) - 1)
    return join_sized(df, firsts, [*keys, "__part"]).withColumn("rank", F.col("__first") + F.col("__row")).drop("__part", "__hash", "__first", "__row")


def text_slices(batch, column: str, most_bytes: int = 4_000_000):
    """Consecutive slices of an Arrow batch whose texts hold about most_bytes each."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)

"""Versioned stores of chunks, parents and parse results as Parquet tables, and the report sink.

A store is a folder of tables that are only appended to: each batch writes files of
its own, stamped with a version, and last the ids that it replaces (its heads). A
batch counts from the moment its heads are complete; until then nobody reads it, and
the next batch takes its number. An id's rows are those of its last version, even
if that has none. Files are only rewritten by `compact`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Replaced ids are broadcast to the readers of a store up to so many, and meet its rows in a shuffle beyond.
BROADCAST_IDS = 100_000
HEADS = "heads"


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [x.getPath().toString() for x in found] if found is not None else []


def _versions(spark: SparkSession, path: str, table: str, suffix: str = "") -> set[int]:
    return {int(x.removesuffix(suffix).rsplit("=", 1)[1]) for x in _listed(spark, f"{path}/{table}/version=*{suffix}")}


def committed(spark: SparkSession, path: str) -> list[int]:
    """The versions of a store, ascending: those whose heads were written to their end."""
    return sorted(_versions(spark, path, HEADS, "/_SUCCESS"))


def _read(spark: SparkSession, path: str, table: str, versions: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/version={v}" for v in versions])


def write_versioned(tables: dict[str, DataFrame], ids: DataFrame, path: str) -> int:
    """Replaces all rows of the ids, in all tables of the store, by the given ones; returns the version.

    No file is rewritten. Ids without rows have none afterwards. If the job fails, the store reads as before,
    and running it again gives the same store as if it had succeeded at once. Stores have one writer at a time.
    """
    spark, key = ids.sparkSession, ids.columns
    version = max(committed(spark, path), default=0) + 1
    for name, rows in tables.items():
        rows.hint("rebalance", *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    ids.distinct().write.mode("overwrite").parquet(f"{path}/{HEADS}/version={version}")
    return version


def read_versioned(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of each id's last version. Filters on ids reach the files, which are sorted by them."""
    versions = committed(spark, path)
    own = sorted(_versions(spark, path, table) & set(versions))
    if not own:
        raise FileNotFoundError(f"no committed version of {path}/{table}")
    rows = _read(spark, path, table, own)
    heads = _read(spark, path, HEADS, versions)
    key = [c for c in heads.columns if c != "version"]
    replaced = heads.groupBy(*key).agg(F.max("version").alias("__last"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    n = replaced.limit(BROADCAST_IDS + 1).count() if len(versions) > 1 else 0
    if n:
        rows = rows.join(F.broadcast(replaced) if n <= BROADCAST_IDS else replaced, key, "left").where("__last IS NULL OR version = __last").drop("__last")
    return rows.drop("version")


def compact(spark: SparkSession, path: str) -> int:
    """Writes what the store holds as one more version, after which no reader needs the older ones; returns it."""
    versions = committed(spark, path)
    names = [x.rsplit("/", 1)[1] for x in _listed(spark, f"{path}/*")]
    tables = {n: read_versioned(spark, path, n) for n in names if n != HEADS and _versions(spark, path, n) & set(versions)}
    heads = _read(spark, path, HEADS, versions)
    return write_versioned(tables, heads.drop("version"), path)


def vacuum(spark: SparkSession, path: str, before: int) -> None:
    """Deletes the files of versions before a compaction: rows first, so that an interrupted run brings nothing back."""
    names = [x.rsplit("/", 1)[1] for x in _listed(spark, f"{path}/*")]
    for name in sorted(names, key=lambda n: n == HEADS):
        for v in sorted(_versions(spark, path, name)):
            if v < before:
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/version={v}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_chunks(chunks: DataFrame, path: str, papers: DataFrame | None = None) -> int:
    """Replaces all chunks of the given papers (project_id, paper_id; those of the chunks if not given) and keeps the rest."""
    return write_versioned({"chunks": chunks}, (chunks if papers is None else papers).select("project_id", "paper_id"), path)


def read_chunks(spark: SparkSession, path: str, project_id: int | None = None, paper_id: int | None = None) -> DataFrame:
    """Stored chunks, of one project or paper if given. Order by chunk_index where order matters."""
    df = read_versioned(spark, path, "chunks")
    for name, value in (("project_id", project_id), ("paper_id", paper_id)):
        df = df if value is None else df.where(F.col(name) == value)
    return df


def write_parents(parents: DataFrame, path: str, papers: DataFrame | None = None) -> int:
    """Replaces all parents of the given papers (paper_id; those of the parents if not given) and keeps the rest."""
    return write_versioned({"parents": parents}, (parents if papers is None else papers).select("paper_id"), path)


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    return read_versioned(spark, path, "parents")


def parents_by_id(parents: DataFrame, ids: DataFrame) -> DataFrame:
    return parents.join(ids.select("parent_id").distinct(), "parent_id", "left_semi")


def upsert_latest(base: DataFrame, updates: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key, that of the latest time; of equal times the update's."""
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def to_vector_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with text, numbered anew from 0 in each paper, with an id paper_n and project 0 where none is given."""
    df = chunks.where(F.trim("text") != "")
    nr = (F.row_number().over(W.partitionBy("paper_id").orderBy("chunk_index")) - 1).cast("long")
    df = df.withColumn("chunk_index", nr)
    return df.withColumns({"id": F.concat_ws("_", "paper_id", "chunk_index"), "project_id": F.coalesce("project_id", F.lit(0))})


def write_report(report: DataFrame, path: str) -> None:
    """Each row as one JSON document a line."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)

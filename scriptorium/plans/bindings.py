"""The tables of a literature service, built from the tables of a data folder, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking

#: "Now" of the memories: 2024-01-31 00:00 UTC.
AS_OF = 1706659200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a function as a query, with its SQL over the named common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_ctes(sql, *ctes)
        return f

    return register


def with_ctes(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + sql if names else sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SQL = {
    "kw": """SELECT l_orderkey AS paper_id, lower(p_type) AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION SELECT l_orderkey, unnest(string_split(lower(p_name), ' ')) FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "papers": """SELECT o_orderkey AS paper_id, o_custkey AS user_id, o_custkey % 10 AS project_id, CAST(o_orderdate AS DATE) AS publication_date,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'processing' ELSE 'completed' END AS status, o_orderpriority || ' ' || o_orderkey AS title FROM orders""",
    "projects": "SELECT o_custkey % 10 AS project_id, o_custkey % 10 AS owner_id, max(CAST(o_orderdate AS DATE)) AS updated_at FROM orders GROUP BY 1, 2",
    "kwp": "SELECT paper_id, project_id, publication_date, keyword FROM kw JOIN papers USING (paper_id)",
    "docs": "SELECT doc_id AS paper_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 10 AS project_id, text AS abstract, text, lang, source FROM documents",
    "chunks": """SELECT paper_id, project_id, CAST(i / 462 AS BIGINT) AS chunk_index, trim(substr(text, CAST(i AS BIGINT) + 1, 512), ' ' || chr(10)) AS text
        FROM (SELECT paper_id, project_id, text, unnest(range(0, length(text), 462)) AS i FROM docs) WHERE trim(substr(text, CAST(i AS BIGINT) + 1, 512), ' ' || chr(10)) <> ''""",
    "memories": """SELECT event_id AS id, event_type || ' ' || props AS content, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, least(value / 400, 1.0) AS importance, event_id % 12 AS access_count,
        'dynamic' AS memory_type, event_type AS agent_source, user_id % 10 AS project_id FROM events""",
    "works": """SELECT doc_id AS work_id, substr(string_split(text, chr(10))[1], 1, 120) AS title, CASE WHEN doc_id % 2 = 0 THEN '10.1234/' || substr(md5(text), 1, 12) END AS doi, text AS abstract,
        CAST(2015 + doc_id % 10 AS INTEGER) AS year, n_chars % 500 AS citation_count, source, lang, string_split(text, ' ')[1] AS author FROM documents""",
    "answers": "SELECT conv_id * 1000 + turn AS answer_id, text || ' [' || turn || '] [9]' AS text, 8 AS evidence_count FROM conversations WHERE role = 'assistant'",
    "latencies": "SELECT value AS ms, event_type AS kind, event_id % 3 AS round FROM events",
    "edges": """SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)""",
    "shared": """SELECT event_id AS id, event_type AS source_agent, CASE event_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'private' END AS access_level,
        CAST(floor(epoch(ts)) AS BIGINT) AS share_time, list_filter((SELECT list(DISTINCT event_type ORDER BY event_type) FROM events), lambda x: x <> event_type) AS target_agents, user_id % 10 AS project_id FROM events""",
    "vectors": "SELECT vec_id // 5 AS paper_id, vec_id % 5 AS chunk_index, label AS project_id, CAST(embedding AS DOUBLE[]) AS vector, vec_id FROM embeddings",
}


def papers(spark: SparkSession, sf_dir: str, keywords: bool = True) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "processing").otherwise("completed")
    df = orders.select(
        F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 10).alias("project_id"), F.to_date("o_orderdate").alias("publication_date"),
        status.alias("status"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"),
    )
    if not keywords:
        return df
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.array(F.lower("p_type")), F.split(F.lower("p_name"), " ")).alias("k"))
    kw = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select(F.col("l_orderkey").alias("paper_id"), F.explode("k").alias("k"))
    return df.join(kw.groupBy("paper_id").agg(F.sort_array(F.collect_set("k")).alias("keywords")), "paper_id", "left")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("o_custkey") % 10).alias("project_id")
    return read(spark, sf_dir, "orders").groupBy(key).agg(F.max(F.to_date("o_orderdate")).alias("updated_at")).withColumn("owner_id", F.col("project_id"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.regexp_extract("source", "[0-9]+", 0).cast("long") % 10
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), project.alias("project_id"), F.col("text").alias("abstract"), "text", "lang", "source")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlap_chunks(docs(spark, sf_dir).select("paper_id", "project_id", "text"), 512, 50)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", "props").alias("content"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.least(F.col("value") / 400, F.lit(1.0)).alias("importance"), (F.col("event_id") % 12).alias("access_count"), F.lit("dynamic").alias("memory_type"),
        F.col("event_type").alias("agent_source"), (F.col("user_id") % 10).alias("project_id"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1234/"), F.substring(F.md5(F.col("text").cast("binary")), 1, 12)))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("work_id"), F.substring(F.get(F.split("text", "\n"), 0), 1, 120).alias("title"), doi.alias("doi"), F.col("text").alias("abstract"),
        (2015 + F.col("doc_id") % 10).cast("int").alias("year"), (F.col("n_chars") % 500).alias("citation_count"), "source", "lang", F.get(F.split("text", " "), 0).alias("author"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", F.lit(" ["), "turn", F.lit("] [9]")).alias("text"), F.lit(8).alias("evidence_count"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("value").alias("ms"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("round"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    df = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst"))
    return df.where("src != dst").distinct()


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kinds = events.agg(F.sort_array(F.collect_set("event_type"))).scalar()
    level = F.when(F.col("event_id") % 3 == 0, "public").when(F.col("event_id") % 3 == 1, "restricted").otherwise("private")
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("source_agent"), level.alias("access_level"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("share_time"), F.array_remove(kinds, F.col("event_type")).alias("target_agents"), (F.col("user_id") % 10).alias("project_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("long").alias("paper_id"), (F.col("vec_id") % 5).alias("chunk_index"), F.col("label").alias("project_id"), F.col("embedding").alias("vector"), "vec_id"
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a query."""
    rows = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


SQL["turns"] = "SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"

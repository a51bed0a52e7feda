"""Queries on keyword trends, with their SQL."""

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import trends as T
from . import bindings as B
from .bindings import query

STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
B.SQL["kwc"] = f"SELECT keyword, count(*) AS count FROM kwp WHERE length(keyword) > 1 AND keyword NOT IN {STOP} GROUP BY 1"
B.SQL["freq"] = "SELECT row_number() OVER (ORDER BY count DESC, keyword) AS rank, keyword, count, count * 100.0 / sum(count) OVER () AS percentage FROM kwc"
B.SQL["yk"] = "SELECT year, keyword, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY count DESC, keyword) AS rank FROM (SELECT year(publication_date) AS year, keyword, count(*) AS count FROM kwp WHERE length(keyword) > 0 GROUP BY 1, 2)) WHERE rank <= 10"
B.SQL["dterms"] = f"SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '[a-zA-Z]{{3,}}')) AS keyword FROM docs"
B.SQL["dk"] = f"SELECT project_id, keyword FROM (SELECT project_id, unnest(regexp_extract_all(lower(abstract), '[a-zA-Z]{{3,}}')) AS keyword FROM docs) WHERE keyword NOT IN {STOP}"
KW = ("kw", "papers", "kwp")


@query("SELECT CAST(rank AS INTEGER) AS rank, keyword, count, round(percentage, 6) AS percentage FROM freq WHERE rank <= 50", *KW, "kwc", "freq")
def trd01_keyword_frequency(spark, sf):
    return T.keyword_frequency(B.papers(spark, sf)).withColumn("percentage", F.round("percentage", 6))


@query(
    f"SELECT project_id, CAST(rank AS INTEGER) AS rank, keyword, count FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY count DESC, keyword) AS rank FROM (SELECT project_id, keyword, count(*) AS count FROM dk GROUP BY 1, 2)) WHERE rank <= 50",
    "docs", "dk",
)
def trd02_abstract_fallback(spark, sf):
    bare = B.docs(spark, sf).withColumn("keywords", F.array().cast("array<string>"))
    return T.keyword_frequency(bare, ["project_id"]).drop("percentage")


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY round(tfidf, 9) DESC, keyword) AS INTEGER) AS rank, keyword, count, df, round(tfidf, 4) AS tfidf FROM (
    SELECT keyword, count(*) AS count, count(DISTINCT paper_id) AS df, count(*) * ln((SELECT count(*) FROM docs) / count(DISTINCT paper_id) + 1) AS tfidf FROM dterms WHERE keyword NOT IN {STOP} GROUP BY 1)
    ORDER BY rank LIMIT 50""",
    "docs", "dterms",
)
def trd03_tfidf_terms(spark, sf):
    return T.tfidf_terms(B.docs(spark, sf)).select("rank", "keyword", "count", "df", F.round("tfidf", 4).alias("tfidf"))


@query(
    "SELECT CAST(year AS INTEGER) AS year, papers, string_agg(keyword || ':' || count, ',' ORDER BY rank) AS top FROM yk JOIN (SELECT year(publication_date) AS year, count(*) AS papers FROM papers GROUP BY 1) USING (year) GROUP BY 1, 2",
    *KW, "yk",
)
def trd04_timeline(spark, sf):
    return T.timeline(B.papers(spark, sf)).select("year", "papers", F.array_join(F.transform("top_keywords", lambda x: F.concat_ws(":", x["keyword"], x["count"])), ",").alias("top"))


@query("SELECT CAST(rank AS INTEGER) AS rank, keyword, count, round(count / (SELECT max(count) FROM freq), 6) AS hotness FROM freq WHERE rank <= 20", *KW, "kwc", "freq")
def trd05_hotspots(spark, sf):
    return T.hotspots(B.papers(spark, sf)).withColumn("hotness", F.round("hotness", 6))


B.SQL["y"] = "SELECT year, row_number() OVER (ORDER BY year) AS nr, lead(year) OVER (ORDER BY year) AS next_year, count(*) OVER () AS n FROM (SELECT DISTINCT year(publication_date) AS year FROM papers)"
B.SQL["yh"] = "SELECT *, total / n AS mean FROM (SELECT k.keyword, k.count, y.*, sum(k.count) OVER (PARTITION BY k.keyword) AS total FROM yk k JOIN y USING (year)) WHERE total >= 2 AND n >= 2"
B.SQL["runs"] = """SELECT keyword, min(year) AS start_year, arg_max(coalesce(next_year, 99999), nr) AS after, max(year) AS last, max(count / greatest(mean, 0.1)) AS strength FROM (
    SELECT *, nr - row_number() OVER (PARTITION BY keyword ORDER BY nr) AS island FROM yh WHERE count > 1.5 * mean) GROUP BY keyword, island"""


@query(
    """SELECT CAST(row_number() OVER (ORDER BY strength DESC, keyword, start_year) AS INTEGER) AS rank, keyword, CAST(start_year AS INTEGER) AS start_year,
    CAST(CASE WHEN after = 99999 THEN last ELSE after - 1 END AS INTEGER) AS end_year, round(strength, 6) AS strength FROM runs ORDER BY rank LIMIT 30""",
    *KW, "yk", "y", "yh", "runs",
)
def trd06_burst_terms(spark, sf):
    return T.burst_terms(B.papers(spark, sf)).select("rank", "keyword", "start_year", "end_year", F.round("strength", 6).alias("strength"))


B.SQL["dist"] = "SELECT *, CASE WHEN cumulative <= 0.3 THEN 'core' WHEN cumulative <= 0.6 THEN 'hot' WHEN cumulative <= 0.85 THEN 'general' ELSE 'fringe' END AS category FROM (SELECT rank, keyword, count, sum(count) OVER (ORDER BY rank) / sum(count) OVER () AS cumulative FROM freq WHERE rank <= 50)"


@query("SELECT CAST(rank AS INTEGER) AS rank, keyword, count, round(cumulative, 6) AS cumulative, category FROM dist", *KW, "kwc", "freq", "dist")
def trd07_field_distribution(spark, sf):
    return T.field_distribution(B.papers(spark, sf)).withColumn("cumulative", F.round("cumulative", 6))


@query("SELECT category, CAST(sum(count) AS BIGINT) AS count, count(*) AS keywords FROM dist GROUP BY 1", *KW, "kwc", "freq", "dist")
def trd08_category_totals(spark, sf):
    return T.category_totals(T.field_distribution(B.papers(spark, sf)))


@query(
    "SELECT CAST(g.year AS INTEGER) AS year, g.keyword, coalesce(k.count, 0) AS count FROM (SELECT year, keyword FROM (SELECT DISTINCT year FROM yk), (SELECT keyword FROM yk WHERE rank <= 5 GROUP BY 1 ORDER BY min(year * 100 + rank), keyword LIMIT 8)) g LEFT JOIN yk k USING (year, keyword)",
    *KW, "yk",
)
def trd09_keyword_evolution(spark, sf):
    return T.keyword_evolution(B.papers(spark, sf))


@query(
    "SELECT CAST(rank AS INTEGER) AS rank, keyword, count, round((count - min(count) OVER ()) / CASE WHEN max(count) OVER () = min(count) OVER () THEN 1 ELSE max(count) OVER () - min(count) OVER () END, 6) AS weight FROM freq WHERE rank <= 40",
    *KW, "kwc", "freq",
)
def trd10_scale_weights(spark, sf):
    return T.scale_weights(T.keyword_frequency(B.papers(spark, sf))).withColumn("weight", F.round("weight", 6))


@query("SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, concept) AS INTEGER) AS rank, concept, count(*) AS works, CAST(sum(citation_count) AS BIGINT) AS citations FROM (SELECT unnest([lang, source]) AS concept, citation_count FROM works) GROUP BY concept ORDER BY rank LIMIT 20", "works")
def trd11_trending_concepts(spark, sf):
    return T.trending_concepts(B.works(spark, sf).withColumn("concepts", F.array("lang", "source"))).select("rank", "concept", "works", "citations")


def _texts(spark, sf):
    return B.docs(spark, sf).select("project_id", "text")


@query()
def trd12_extract_entities(spark, sf):
    return T.extract_entities(_texts(spark, sf), ["project_id"])


@query()
def trd13_cooccurrence_edges(spark, sf):
    texts = _texts(spark, sf)
    return T.cooccurrence_edges(texts, T.extract_entities(texts, ["project_id"]), ["project_id"])


B.SQL["un"] = "SELECT DISTINCT least(src, dst) AS source, greatest(src, dst) AS target FROM edges"


@query("SELECT source, target FROM un WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "edges", "un")
def trd14_valid_edges(spark, sf):
    nodes = B.read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return T.valid_edges(nodes, _undirected(spark, sf))


def _undirected(spark, sf):
    return B.edges(spark, sf).select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).distinct()


@query("SELECT node, count(DISTINCT other) AS degree, string_agg(DISTINCT CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS neighbours FROM (SELECT source AS node, target AS other FROM un UNION ALL SELECT target, source FROM un) GROUP BY 1", "edges", "un")
def trd15_adjacency(spark, sf):
    df = T.adjacency(_undirected(spark, sf))
    return df.select("node", F.col("degree").cast("long").alias("degree"), F.array_join(F.sort_array(F.transform("neighbours", lambda x: x.cast("string"))), ",").alias("neighbours"))


B.SQL["ptext"] = """SELECT project_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY nr), 1, 8000) AS text FROM (
    SELECT project_id, text, row_number() OVER (PARTITION BY project_id ORDER BY paper_id, chunk_index) AS nr FROM chunks WHERE chunk_index < 10 AND paper_id % 3 = 0) WHERE nr <= 30 GROUP BY 1"""


def _statuses(spark, sf):
    status = F.when(F.col("paper_id") % 3 == 0, "completed").otherwise("pending")
    return B.docs(spark, sf).select("paper_id", "project_id", status.alias("status"))


def _project_chunks(spark, sf):
    return B.chunks(spark, sf).select("paper_id", "chunk_index", "text")


@query("SELECT project_id, md5(text) AS text_md5, length(text) AS n_chars FROM ptext", "docs", "chunks", "ptext")
def trd16_project_text(spark, sf):
    return T.project_text(_statuses(spark, sf), _project_chunks(spark, sf)).select("project_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query()
def trd17_project_graph(spark, sf):
    return T.project_graph(_statuses(spark, sf), _project_chunks(spark, sf))

"""Queries on works of several sources, with their SQL."""

from pyspark.sql import functions as F

from ..functions.text import extract_doi
from ..operators import works as X
from . import bindings as B
from .bindings import query

STOP = "[" + ", ".join(f"'{w}'" for w in X.QUERY_STOP_WORDS) + "]"


def tok(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}')), lambda x: NOT list_contains({STOP}, x))"


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _relevance(df):
    """Rounded, with halves up whatever the last bit says."""
    return df.withColumn("relevance", F.round(F.col("relevance") + 1e-9, 6))


@query("SELECT source, count(*) AS n, count(doi) AS dois FROM (SELECT 'a' AS source, doi FROM works WHERE lang = 'en' UNION ALL SELECT 'b', NULL FROM works WHERE lang <> 'en') GROUP BY 1", "works")
def src05_union_works(spark, sf):
    w = B.works(spark, sf).drop("source")
    return X.union_works(a=w.where("lang = 'en'"), b=w.where("lang <> 'en'").drop("doi")).groupBy("source").agg(F.count("*").alias("n"), F.count("doi").alias("dois"))


@query(
    """SELECT query_id, trim(query) || CASE WHEN e = '' THEN '' ELSE ' ' || e END AS expanded FROM (SELECT query_id, query, concat_ws(' ', CASE WHEN regexp_matches(lower(query), '\\brag\\b') THEN 'retrieval augmented generation large language model' END,
    CASE WHEN contains(lower(query), 'agentic') AND contains(lower(query), 'rag') THEN 'autonomous agents planning tool use' END, CASE WHEN contains(lower(query), 'survey') THEN 'survey review' END) AS e
    FROM (SELECT item_id AS query_id, text || CASE item_id % 3 WHEN 0 THEN ' rag' WHEN 1 THEN ' agentic rag survey' ELSE '' END AS query FROM benchmark))"""
)
def ext01_rewrite_queries(spark, sf):
    extra = F.when(F.col("query_id") % 3 == 0, " rag").when(F.col("query_id") % 3 == 1, " agentic rag survey").otherwise("")
    q = B.benchmark_queries(spark, sf).withColumn("query", F.concat("query", extra))
    return X.rewrite_queries(q).select("query_id", "expanded")


@query()
def ext02_dedupe_works(spark, sf):
    return X.dedupe_works(B.works(spark, sf), ["work_id"]).select("work_id")


def _pairs(spark, sf):
    """Benchmark passages as queries, held against all works that share a word with them."""
    return X.candidate_pairs(B.benchmark_queries(spark, sf), B.works(spark, sf))


def _matches(spark, sf, keep=None):
    """The same pairs, scored by counts of shared words."""
    return X.score_matches(B.benchmark_queries(spark, sf), B.works(spark, sf), keep)


B.SQL["wt"] = f"SELECT *, {tok('title')} AS tt, {tok('abstract')} AS ta FROM works"
B.SQL["qw"] = f"SELECT item_id AS query_id, text AS query, {tok('text')} AS q FROM benchmark"
B.SQL["pairs"] = """SELECT query_id, query, q, w.* FROM (SELECT DISTINCT query_id, work_id FROM (SELECT query_id, unnest(q) AS t FROM qw) JOIN (SELECT work_id, unnest(list_concat(tt, ta)) AS t FROM wt) USING (t))
    JOIN qw USING (query_id) JOIN wt w USING (work_id)"""
B.SQL["scored"] = f"""SELECT *, greatest(least(0.55 * len(list_intersect(q, tt)) / greatest(len(q), 1) + 0.28 * len(list_intersect(q, ta)) / greatest(len(q), 1) + least(ln(1 + citation_count) / 20, 0.15)
    + CASE WHEN year >= 2021 THEN 0.05 ELSE 0 END + CASE WHEN abstract <> '' THEN 0.03 ELSE 0 END, 1), 0) AS relevance FROM pairs"""


B.SQL["tworks"] = "SELECT * REPLACE (CASE WHEN work_id % 3 = 0 THEN '' ELSE abstract END AS abstract), CASE WHEN work_id % 3 = 0 THEN abstract ELSE '' END AS tldr FROM works"
B.SQL["twt"] = B.SQL["wt"].replace("FROM works", "FROM tworks")
B.SQL["tpairs"] = B.SQL["pairs"].replace("FROM wt", "FROM twt").replace("JOIN wt", "JOIN twt")
B.SQL["tscored"] = B.SQL["scored"].replace("FROM pairs", "FROM tpairs")


@query("SELECT query_id, work_id, round(relevance + 1e-9, 6) AS relevance FROM scored", "works", "wt", "qw", "pairs", "scored")
def ext04_score_works(spark, sf):
    return _relevance(_matches(spark, sf).select("query_id", "work_id", "relevance"))


@query(
    f"SELECT query_id, work_id FROM pairs WHERE len(list_filter([{', '.join(repr(t) for t in X.NOISE_TERMS)}], lambda t: contains(lower(title || CASE WHEN work_id % 2 = 0 THEN ' gene mice' ELSE '' END || ' ' || abstract), t))) < 2",
    "works", "wt", "qw", "pairs",
)
def ext03_drop_domain_noise(spark, sf):
    """Queries of this field and works of which half are of another; which of them meet is told by their own words."""
    q, w = B.benchmark_queries(spark, sf), B.works(spark, sf)
    title = F.when(F.col("work_id") % 2 == 0, F.concat("title", F.lit(" gene mice"))).otherwise(F.col("title"))
    noisy = X.score_matches(q.withColumn("ai_context", X.ai_context(F.concat("query", F.lit(" rag")))), w.withColumn("noise", X.noise(title, F.col("abstract"))))
    return X.drop_domain_noise(noisy).select("query_id", "work_id")


@query(
    """SELECT query_id, work_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 6) DESC, citation_count DESC, year DESC, work_id) AS rank FROM scored WHERE relevance >= 0.06) WHERE rank <= 20""",
    "works", "wt", "qw", "pairs", "scored",
)
def ext05_rank_works(spark, sf):
    return X.rank_works(X.score_matches(B.benchmark_queries(spark, sf), B.works(spark, sf)), 10).select("query_id", "work_id", "rank")


@query("SELECT work_id, year FROM works WHERE year BETWEEN 2018 AND 2021 AND (contains(lang, 'e') OR contains(source, 'e')) AND (lang IN ('en', 'src1') OR source IN ('en', 'src1'))", "works")
def ext06_filter_works(spark, sf):
    w = B.works(spark, sf).withColumn("concepts", F.array("lang", "source"))
    return X.filter_works(w, year=(2018, 2021), concept="E", categories=["en", "src1"]).select("work_id", "year")


B.SQL["prim"] = "SELECT DISTINCT query_id, work_id, title FROM scored WHERE round(relevance, 6) >= 0.25"


@query(
    """SELECT query_id, work_id, FALSE AS supplement FROM prim UNION ALL SELECT DISTINCT query_id, work_id, TRUE FROM scored s WHERE query_id NOT IN (SELECT query_id FROM prim GROUP BY 1 HAVING count(*) >= 3)
    AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.query_id = s.query_id AND lower(trim(p.title)) = lower(trim(s.title)))""",
    "works", "wt", "qw", "pairs", "scored", "prim",
)
def ext07_supplement(spark, sf):
    s = _matches(spark, sf, ["title"]).select("query_id", "work_id", "title", "relevance")
    return X.supplement(s.where("round(relevance, 6) >= 0.25").drop("relevance"), s.drop("relevance")).select("query_id", "work_id", "supplement")


@query(
    f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, work_id, round(relevance + 1e-9, 6) AS relevance, md5(CASE WHEN abstract <> '' THEN substr(abstract, 1, 900) ELSE substr(tldr, 1, 600) END) AS text_md5 FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, work_id) AS rank FROM tscored
    WHERE relevance >= 0.25 AND abstract || tldr <> '' AND len(list_intersect(q, list_concat(tt, ta))) / greatest(len(q), 1) >= 0.08) WHERE rank <= 3""",
    "works", "tworks", "twt", "qw", "tpairs", "tscored",
)
def ext08_external_context(spark, sf):
    """Every third work has a tldr and no abstract."""
    bare = F.col("work_id") % 3 == 0
    w = B.works(spark, sf).withColumns({"tldr": F.when(bare, F.col("abstract")), "abstract": F.when(~bare, F.col("abstract"))})
    out = X.external_context(X.score_matches(B.benchmark_queries(spark, sf), w), w)
    return _relevance(out.select("query_id", "rank", "work_id", "relevance", F.md5(F.col("text").cast("binary")).alias("text_md5")))


B.SQL["seeds"] = "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 8000"
B.SQL["outs"] = "SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5"
B.SQL["ins"] = "SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 5"


@query("SELECT src AS source, dst AS target, 'references' AS kind FROM outs WHERE src IN (SELECT id FROM seeds) UNION SELECT src, dst, 'cites' FROM ins WHERE dst IN (SELECT id FROM seeds)", "edges", "seeds", "outs", "ins")
def ext09_citation_network(spark, sf):
    seeds = B.read(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("id"))
    return X.citation_network(B.edges(spark, sf), seeds, 1, 5)[1]


B.SQL["steps"] = "SELECT src AS a, dst AS b, 'referenced' AS kind FROM outs UNION ALL SELECT dst, src, 'citing' FROM ins"
B.SQL["opened"] = "SELECT id FROM seeds UNION SELECT id FROM level1 UNION SELECT id FROM level2"
B.SQL["level1"] = "SELECT b AS id, min(kind) AS kind, 1 AS level FROM seeds JOIN steps ON a = id WHERE b NOT IN (SELECT id FROM seeds) GROUP BY 1"
B.SQL["level2"] = "SELECT b AS id, min(s.kind) AS kind, 2 AS level FROM level1 l JOIN steps s ON a = l.id WHERE b NOT IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM level1) GROUP BY 1"
B.SQL["level3"] = "SELECT b AS id, min(s.kind) AS kind, 3 AS level FROM level2 l JOIN steps s ON a = l.id WHERE b NOT IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM level1) AND b NOT IN (SELECT id FROM level2) GROUP BY 1"


@query("SELECT id, 'center' AS kind, 0 AS level FROM seeds UNION ALL SELECT * FROM level1 UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level3", "edges", "seeds", "outs", "ins", "steps", "level1", "level2", "level3")
def ext09_network_nodes(spark, sf):
    seeds = B.read(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("id"))
    return X.citation_network(B.edges(spark, sf), seeds, 3, 5)[0]


@query(
    "SELECT DISTINCT src AS source, dst AS target, 'references' AS kind FROM outs WHERE src IN (SELECT id FROM opened) UNION SELECT src, dst, 'cites' FROM ins WHERE dst IN (SELECT id FROM opened)",
    "edges", "seeds", "outs", "ins", "steps", "level1", "level2", "opened",
)
def ext09_network_edges(spark, sf):
    seeds = B.read(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("id"))
    return X.citation_network(B.edges(spark, sf), seeds, 3, 5)[1]


@query("SELECT o_orderkey AS work_id, CAST(l_linenumber AS INTEGER) AS nr, p_name AS title, l_partkey AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def ext10_explode_references(spark, sf):
    parts = B.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    none = F.lit(None).cast("string")
    item = F.struct(F.col("l_linenumber").alias("n"), none.alias("doi"), none.alias("title"), F.col("p_name").alias("volume_title"), none.alias("author"), F.col("l_partkey").alias("year"), none.alias("journal"))
    rows = B.read(spark, sf, "lineitem").join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.array_sort(F.collect_list(item)).alias("references"))
    numbers = rows.select("work_id", F.posexplode("references").alias("nr", "r")).select("work_id", "nr", F.col("r.n").alias("line"))
    return X.explode_references(rows).join(numbers, ["work_id", "nr"]).select("work_id", F.col("line").alias("nr"), "title", "year")


@query("SELECT asked, work_id FROM (SELECT 'https://doi.org/' || upper(doi) AS asked, lower(doi) AS d FROM (SELECT DISTINCT doi FROM works WHERE doi IS NOT NULL)) LEFT JOIN works ON lower(doi) = d", "works")
def ext11_resolve_doi(spark, sf):
    w = B.works(spark, sf)
    asked = w.where("doi is not null").select(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi")).distinct()
    return X.resolve_doi(asked, w).select(F.col("doi").alias("asked"), "work_id")


B.SQL["profiles"] = """SELECT author, count(*) AS papers, CAST(sum(citation_count) AS BIGINT) AS citations, count_if(citation_count >= rn) AS h_index, string_agg(DISTINCT source || '/' || lang, ';' ORDER BY source || '/' || lang) AS affiliations
    FROM (SELECT author, citation_count, source, lang, row_number() OVER (PARTITION BY author ORDER BY citation_count DESC) AS rn FROM works) GROUP BY 1"""


def _profiles(spark, sf, name=None):
    """Authors at the sources and languages of their works."""
    w = B.works(spark, sf).withColumn("authors", F.array(F.struct(F.col("author").alias("name"), F.array(F.concat_ws("/", "source", "lang")).alias("affiliations"))))
    return X.author_profiles(w, name).select("author", "papers", "citations", F.col("h_index").cast("long").alias("h_index"), F.array_join("affiliations", ";").alias("affiliations"))


@query("SELECT * FROM profiles", "works", "profiles")
def ext12_author_profiles(spark, sf):
    return _profiles(spark, sf)


@query("SELECT * FROM profiles WHERE contains(lower(author), 'in')", "works", "profiles")
def ext12_author_search(spark, sf):
    return _profiles(spark, sf, "In")


@query()
def ext13_federated_search(spark, sf):
    return _round(X.federated_search(B.benchmark_queries(spark, sf), B.works(spark, sf), limit=5), "relevance")


@query("SELECT work_id, CASE WHEN regexp_matches(t, '10\\.\\d{4,}/\\S+') THEN regexp_extract(t, '(10\\.\\d{4,}/\\S+)', 1) END AS doi FROM (SELECT work_id, abstract || ' ' || coalesce('doi:' || doi, '') AS t FROM works)", "works")
def txt32_extract_doi(spark, sf):
    t = F.concat_ws(" ", "abstract", F.concat(F.lit("doi:"), "doi"))
    return B.works(spark, sf).select("work_id", extract_doi(t).alias("doi"))


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS key, CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'misc' END AS entry_type, 'The {' || t || '} of ' || source AS title, CAST(2000 + doc_id % 20 AS VARCHAR) AS year, md5(b) AS abstract_md5 "
    "FROM (SELECT doc_id, source, translate(substr(text, 1, 40), '{}\"@\\' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS t, translate(text, '{}\"@\\' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS b FROM documents)"
)
def src06_bibtex(spark, sf):
    """Every document written as an entry, in one of three layouts, and read back."""
    from ..functions.lineage import new_folder
    from ..sources.works import read_bibtex

    plain = lambda c: F.translate(c, '{}"@\\\t\n\x0b\x0c\r ', "")
    d = B.read(spark, sf, "documents").select("doc_id", "source", plain(F.substring("text", 1, 40)).alias("t"), plain(F.col("text")).alias("b"), (2000 + F.col("doc_id") % 20).alias("y"))
    three = F.when(F.col("doc_id") % 3 == 0, F.format_string("@article{%s, title = {The {%s} of %s}, year = {%s}, abstract = {%s}}", "doc_id", "t", "source", "y", "b"))
    three = three.when(F.col("doc_id") % 3 == 1, F.format_string('@Book{%s,\n  title = "The " # "{%s} of " # {%s},\n  YEAR = %s,\n  abstract = "%s"\n}\n', "doc_id", "t", "source", "y", "b"))
    three = three.otherwise(F.format_string("@string{y%s = {%s}}\n@misc(%s,title={The {%s} of %s},year=y%s,abstract={%s},)", "doc_id", "y", "doc_id", "t", "source", "doc_id", "b"))
    path = new_folder(spark)
    d.select(three).write.text(path)
    return read_bibtex(spark, path).select("key", "entry_type", "title", "year", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))

"""Queries on retrieval and evidence, with their SQL."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as X
from ..operators import retrieval as R
from . import bindings as B
from .bindings import query

B.SQL["toks"] = "SELECT paper_id, chunk_index, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM chunks"
B.SQL["post"] = "SELECT paper_id, chunk_index, term, count(*) AS tf, dl FROM (SELECT paper_id, chunk_index, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY ALL"
B.SQL["qt"] = "SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark"
B.SQL["bm"] = """SELECT query_id, paper_id, chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id, chunk_index) AS rank FROM (
    SELECT query_id, paper_id, chunk_index, sum(ln(1 + ((SELECT count(*) FROM toks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(t)) FROM toks)))) AS score
    FROM qt JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) USING (term) JOIN post USING (term) GROUP BY 1, 2, 3)) WHERE rank <= 10"""
BM = ("docs", "chunks", "toks", "post", "qt", "bm")
B.SQL["vq"] = "SELECT vec_id AS query_id, vector, paper_id AS qp, chunk_index AS qc FROM vectors WHERE vec_id % 50 = 0"
B.SQL["vs"] = """SELECT query_id, paper_id, chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id, chunk_index) AS rank FROM (
    SELECT query_id, v.paper_id, v.chunk_index, list_cosine_similarity(q.vector, v.vector) AS score FROM vq q, vectors v WHERE NOT (v.paper_id = qp AND v.chunk_index = qc))) WHERE rank <= 10"""


def _opened(spark, sf):
    """The name of a stored index of all chunks, made anew."""
    from ..functions.lineage import new_folder

    path = new_folder(spark)
    name = f"lexicon_{path.rsplit('/', 1)[1]}"
    buckets = X.index_buckets(B.docs(spark, sf))
    X.open_index(spark, name, path, buckets)
    X.add_to_index(B.chunks(spark, sf), name, buckets=buckets, english=False)
    return name


def _index(spark, sf):
    return X.read_index(spark, _opened(spark, sf))


def _bm25(spark, sf, k=10):
    return R.bm25_search(B.benchmark_queries(spark, sf), _index(spark, sf), k)


def _vector_queries(spark, sf):
    return B.vectors(spark, sf).where(F.col("vec_id") % 50 == 0).withColumn("query_id", F.col("vec_id"))


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM post GROUP BY 1", "docs", "chunks", "toks", "post")
def ret01_lexical_index(spark, sf):
    return _index(spark, sf)[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("SELECT query_id, paper_id, chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm", *BM)
def ret02_bm25_search(spark, sf):
    return _round(_bm25(spark, sf), "score")


@query("SELECT query_id, paper_id, chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vs", "vectors", "vq", "vs")
def ret03_vector_search(spark, sf):
    return _round(R.vector_search(_vector_queries(spark, sf), B.vectors(spark, sf), 10, exclude_self=True), "score")


@query()
def ret04_ann_search(spark, sf):
    return _round(R.ann_search(_vector_queries(spark, sf), B.vectors(spark, sf), 10, cells=16, probes=8, exclude_self=True), "score")


B.SQL["lex"] = "SELECT v.vec_id AS query_id, w.paper_id, w.chunk_index, row_number() OVER (PARTITION BY v.vec_id ORDER BY w.vec_id) AS rank, 1.0 / row_number() OVER (PARTITION BY v.vec_id ORDER BY w.vec_id) AS score FROM vectors v JOIN vectors w ON v.project_id = w.project_id AND w.vec_id > v.vec_id WHERE v.vec_id % 50 = 0 QUALIFY rank <= 10"
B.SQL["fused"] = """SELECT query_id, paper_id, chunk_index, coalesce(0.6 / (60 + a.rank), 0) + coalesce(0.4 / (60 + b.rank), 0) AS score FROM vs a FULL JOIN lex b USING (query_id, paper_id, chunk_index)"""


def _label_run(spark, sf):
    """A second run: the next vectors of the query's own label."""
    v = B.vectors(spark, sf).select("paper_id", "chunk_index", "project_id", "vec_id").where("project_id IS NOT NULL")
    own = R.W.partitionBy("project_id").orderBy("vec_id")
    after = F.array_compact(F.array(*(F.lead(F.struct("paper_id", "chunk_index"), i).over(own) for i in range(1, 11))))
    rows = v.withColumn("after", after).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.posexplode("after").alias("at", "x"))
    return rows.select("query_id", "x.*", (F.col("at") + 1).alias("rank"), (1.0 / (F.col("at") + 1)).alias("score"))


@query("SELECT query_id, paper_id, chunk_index, round(score, 9) AS score FROM fused", "vectors", "vq", "vs", "lex", "fused")
def ret05_rrf_fuse(spark, sf):
    vec = R.vector_search(_vector_queries(spark, sf), B.vectors(spark, sf), 10, exclude_self=True)
    return _round(R.rrf_fuse(vec, _label_run(spark, sf)).select("query_id", "paper_id", "chunk_index", "score"), "score", digits=9)


@query(
    "SELECT query_id, paper_id, chunk_index, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id, chunk_index) AS rank FROM fused) WHERE rank <= 5",
    "vectors", "vq", "vs", "lex", "fused",
)
def ret06_fused_top(spark, sf):
    vec = R.vector_search(_vector_queries(spark, sf), B.vectors(spark, sf), 10, exclude_self=True)
    return _round(R.top_per_query(R.rrf_fuse(vec, _label_run(spark, sf)).select("query_id", "paper_id", "chunk_index", "score"), 5), "score", digits=9)


def _hits(spark, sf):
    return R.attach_chunks(_bm25(spark, sf), B.chunks(spark, sf).select("paper_id", "chunk_index", "text"))


@query("SELECT query_id, paper_id, chunk_index, CAST(rank AS INTEGER) AS rank, md5(text) AS text_md5 FROM bm JOIN chunks USING (paper_id, chunk_index)", *BM)
def ret07_attach_chunks(spark, sf):
    return _hits(spark, sf).select("query_id", "paper_id", "chunk_index", "rank", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT query_id, paper_id, CAST(rank AS INTEGER) AS rank, title FROM bm LEFT JOIN (SELECT work_id AS paper_id, title FROM works) USING (paper_id)", *BM, "works")
def ret08_attach_titles(spark, sf):
    titles = B.works(spark, sf).select(F.col("work_id").alias("paper_id"), "title")
    return R.attach_titles(_bm25(spark, sf), titles).select("query_id", "paper_id", "rank", "title")


def sql_reference_like(text: str, head: int) -> str:
    """Whether a text looks like a list of references, by the same patterns under another engine."""
    heading = T.REFERENCE_HEADING.replace("'", "''")
    entry = " OR ".join(f"regexp_matches(x, '{p}')" for p in T.REFERENCE_ENTRIES)
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"coalesce(regexp_matches(substr({text}, 1, {head}), '{heading}') OR (len(list_filter({lines}, lambda x: {entry})) >= 3 AND len(list_filter({lines}, lambda x: {entry})) >= 0.2 * len({lines})), FALSE)"


B.SQL["listed"] = f"SELECT query_id, paper_id, chunk_index, {sql_reference_like('t', 500)} AS ref FROM (SELECT *, CASE WHEN contains(text, 'ing ') THEN replace(text, '. ', '.' || chr(10) || '[7] ') ELSE text END AS t FROM bm JOIN chunks USING (paper_id, chunk_index))"


@query(
    "SELECT query_id, paper_id, chunk_index, refs AS reference_hits FROM (SELECT *, sum(CAST(ref AS BIGINT)) OVER (PARTITION BY query_id) AS refs, count(*) OVER (PARTITION BY query_id) AS n FROM listed) WHERE NOT ref OR refs = n",
    *BM, "listed",
)
def ret09_filter_reference_hits(spark, sf):
    """Sentences of chunks with a certain ending begin like entries of a list; those with enough of them are lists."""
    listed = F.when(F.contains("text", F.lit("ing ")), F.replace("text", F.lit(". "), F.lit(".\n[7] "))).otherwise(F.col("text"))
    return R.filter_reference_hits(_hits(spark, sf).withColumn("text", listed)).select("query_id", "paper_id", "chunk_index", "reference_hits")


B.SQL["low"] = """SELECT * FROM (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best, sum(CASE WHEN score >= 0.65 * best0 THEN 1 ELSE 0 END) OVER w AS goods FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best0 FROM bm) WINDOW w AS (PARTITION BY query_id))
    WHERE NOT (n > 5 AND best > 0 AND goods >= 5) OR score >= 0.65 * best"""


@query("SELECT query_id, paper_id, chunk_index, CAST(rank AS INTEGER) AS rank FROM low", *BM, "low")
def ret11_filter_low_signal(spark, sf):
    return R.filter_low_signal(_hits(spark, sf), 5).select("query_id", "paper_id", "chunk_index", "rank")


@query("SELECT query_id, paper_id, chunk_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS INTEGER) AS rank FROM bm WHERE rank <= 5", *BM)
def ret12_apply_order(spark, sf):
    orders = B.benchmark_queries(spark, sf).select("query_id", F.lit("order: [4, 3, 2, 1, 0, 0, 99]").alias("order_text"))
    return R.apply_order(_bm25(spark, sf), orders, 5).select("query_id", "paper_id", "chunk_index", "rank")


B.SQL["divers"] = """SELECT query_id, paper_id, chunk_index, score, nr AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 OR f = 1 THEN 0 ELSE 1 END, rank) AS nr FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS f, count(*) OVER (PARTITION BY query_id) AS n FROM bm)) WHERE nr <= 5"""


@query("SELECT query_id, paper_id, chunk_index, CAST(rank AS INTEGER) AS rank FROM divers", *BM, "divers")
def ret13_diversify(spark, sf):
    return R.diversify(_bm25(spark, sf), 5).select("query_id", "paper_id", "chunk_index", "rank")


def _parents(spark, sf):
    """Four chunks a parent."""
    rows = B.chunks(spark, sf).withColumn("parent_id", F.concat_ws("_p", "paper_id", F.floor(F.col("chunk_index") / 4)))
    return rows.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _hits_with_parents(spark, sf):
    return _hits(spark, sf).withColumn("parent_id", F.concat_ws("_p", "paper_id", F.floor(F.col("chunk_index") / 4)))


B.SQL["expanded"] = """SELECT query_id, paper_id, chunk_index // 4 AS part, min(rank) AS first, max(score) AS score, string_agg(DISTINCT CAST(chunk_index AS VARCHAR), ',' ORDER BY CAST(chunk_index AS VARCHAR)) AS chunks FROM bm GROUP BY 1, 2, 3"""


@query("SELECT query_id, paper_id, chunks, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS rank FROM expanded", *BM, "expanded")
def ret14_expand_parents(spark, sf):
    df = R.expand_parents(_hits_with_parents(spark, sf), _parents(spark, sf))
    return df.select("query_id", "paper_id", F.array_join(F.sort_array(F.transform("chunks", lambda c: c.cast("string"))), ",").alias("chunks"), F.round("score", 6).alias("score"), "rank")


B.SQL["bm15"] = B.SQL["bm"].replace("rank <= 10", "rank <= 15")
B.SQL["s_cited"] = f"""SELECT * EXCLUDE (refs, n) FROM (SELECT *, sum(CAST(ref AS BIGINT)) OVER (PARTITION BY query_id) AS refs, count(*) OVER (PARTITION BY query_id) AS n FROM (
    SELECT *, {sql_reference_like('text', 500)} AS ref FROM bm15 JOIN chunks USING (paper_id, chunk_index) WHERE trim(text) <> '')) WHERE NOT ref OR refs = n"""
B.SQL["s_signal"] = """SELECT query_id, paper_id, chunk_index, score, rank FROM (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best, sum(CASE WHEN score >= 0.65 * best0 THEN 1 ELSE 0 END) OVER w AS goods
    FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best0 FROM s_cited) WINDOW w AS (PARTITION BY query_id)) WHERE NOT (n > 10 AND best > 0 AND goods >= 10) OR score >= 0.65 * best"""
B.SQL["s_diverse"] = """SELECT query_id, paper_id, chunk_index, score, nr AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 OR f = 1 THEN 0 ELSE 1 END, rank) AS nr FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS f, count(*) OVER (PARTITION BY query_id) AS n FROM s_signal WHERE rank <= 10)) WHERE nr <= 5"""
_COUNTED = " UNION ALL ".join(f"SELECT query_id, count(*) AS n, count(DISTINCT paper_id) AS papers, '{step}' AS step FROM {table} GROUP BY 1" for step, table in (
    ("searched", "bm15"), ("fetched", "bm15"), ("cited", "s_cited"), ("signal", "s_signal"), ("ordered", "(SELECT * FROM s_signal WHERE rank <= 10)"), ("diverse", "s_diverse")
))


@query(_COUNTED, "docs", "chunks", "toks", "post", "qt", "bm15", "s_cited", "s_signal", "s_diverse")
def ret15_evidence_audit(spark, sf):
    hits = _bm25(spark, sf, 15).withColumn("parent_id", F.concat_ws("_p", "paper_id", F.floor(F.col("chunk_index") / 4)))
    return R.prepare_evidence(hits, B.chunks(spark, sf).select("paper_id", "chunk_index", "text"), _parents(spark, sf), 5)[1]


B.SQL["ptexts"] = "SELECT paper_id, chunk_index // 4 AS part, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY 1, 2"


@query(
    """SELECT query_id, md5(CASE WHEN query_id % 2 = 0 THEN '【历史对话记忆】' || chr(10) || chr(10) || '[M1] about ' || query_id || chr(10) || chr(10) || '[M2] more' || chr(10) || chr(10) || chr(10) || chr(10) ELSE '' END || '【文献参考】' || chr(10) || chr(10) ||
        string_agg('[' || nr || '] (paper:' || paper_id || CASE WHEN chunk_index % 3 > 0 THEN ', page:' || chunk_index % 3 ELSE '' END || CASE WHEN chunk_index % 2 = 0 THEN ', section:S' || chunk_index ELSE '' END || ') ' || text, chr(10) || chr(10) ORDER BY nr)) AS context_md5 FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS nr FROM (SELECT query_id, paper_id, chunk_index // 4 AS part, min(rank) AS first, arg_min(chunk_index, rank) AS chunk_index FROM bm GROUP BY 1, 2, 3))
    JOIN ptexts USING (paper_id, part) GROUP BY query_id""",
    *BM, "ptexts",
)
def ret16_build_context(spark, sf):
    """Chunks have pages and sections by their number, every second query two memories."""
    hits = _hits_with_parents(spark, sf).withColumns({"page_number": F.col("chunk_index") % 3, "section_path": F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("S"), "chunk_index"))})
    met = hits.select("query_id").distinct().where("query_id % 2 = 0")
    memories = met.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("about "), "query_id").alias("content")), F.struct(F.lit(2).alias("rank"), F.lit("more").alias("content")))).alias("m")).select("query_id", "m.*")
    df = R.build_context(R.expand_parents(hits, _parents(spark, sf)), memories)
    return df.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(
    """SELECT conv_id, md5(string_agg(role || ': ' || CASE WHEN role = 'assistant' AND length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END, chr(10) ORDER BY turn)) AS history_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10 GROUP BY 1"""
)
def ret17_history_text(spark, sf):
    return R.history_text(B.read(spark, sf, "conversations")).select("conv_id", F.md5(F.col("history").cast("binary")).alias("history_md5"))


@query(
    """SELECT answer_id, CAST(nr AS INTEGER) AS nr, CAST(c AS INTEGER) AS citation FROM (SELECT answer_id, unnest(regexp_extract_all(text, '\\[(\\d{1,3})\\]', 1)) AS c, generate_subscripts(regexp_extract_all(text, '\\[(\\d{1,3})\\]', 1), 1) AS nr FROM answers)""",
    "answers",
)
def ret18_citation_spans(spark, sf):
    return R.citation_spans(B.answers(spark, sf)).select("answer_id", "nr", "citation")


@query(
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, CAST(rank % 3 = 1 AS BIGINT) AS mentions, round(least(greatest(0.55 * CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END
    + 0.30 * CASE WHEN len(q) > 0 THEN len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[\\x{4e00}-\\x{9fff}]{2,}')))) / len(q) ELSE 0 END + 0.15 * CAST(rank % 3 = 1 AS INTEGER), 0), 1), 6) AS display_score
    FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm JOIN chunks USING (paper_id, chunk_index))
    JOIN (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[\\x{4e00}-\\x{9fff}]{2,}')) AS q FROM benchmark) USING (query_id)""",
    *BM,
)
def ret19_display_scores(spark, sf):
    hits = _hits(spark, sf)
    mentions = hits.where("rank % 3 = 1").select("query_id", F.col("rank").alias("citation"))
    return _round(R.display_scores(B.benchmark_queries(spark, sf), hits, mentions).select("query_id", "rank", "paper_id", "mentions", "display_score"), "display_score")


B.SQL["means"] = "SELECT paper_id, list(x ORDER BY i) AS vector FROM (SELECT paper_id, i, avg(x) AS x FROM (SELECT paper_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors) GROUP BY 1, 2) GROUP BY 1"


@query(
    """SELECT query_id, paper_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank FROM (
    SELECT a.paper_id AS query_id, b.paper_id, list_cosine_similarity(a.vector, b.vector) AS score FROM means a, means b WHERE a.paper_id % 50 = 0 AND a.paper_id <> b.paper_id)) WHERE rank <= 10""",
    "vectors", "means",
)
def ret20_similar_papers(spark, sf):
    v = B.vectors(spark, sf)
    return _round(R.similar_papers(v, v.where("paper_id % 50 = 0"), 10), "score")


@query("SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, title, substr(c.text, 1, 200) AS snippet FROM bm JOIN chunks c USING (paper_id, chunk_index) JOIN (SELECT work_id AS paper_id, title FROM works) USING (paper_id)", *BM, "works")
def ret21_suggest_citations(spark, sf):
    titles = B.works(spark, sf).select(F.col("work_id").alias("paper_id"), "title")
    return R.suggest_citations(_bm25(spark, sf), B.chunks(spark, sf).select("paper_id", "chunk_index", "text"), titles)


B.SQL["hq"] = "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE text END AS text FROM benchmark"
B.SQL["hqt"] = "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM hq"
B.SQL["hbm"] = B.SQL["bm"].replace("FROM qt JOIN", "FROM hqt JOIN")
B.SQL["hvs"] = """SELECT query_id, paper_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id, chunk_index) AS rank FROM (
    SELECT q.query_id, v.paper_id, v.chunk_index, list_cosine_similarity(z.vector, v.vector) AS score FROM hq q JOIN vectors z ON z.vec_id = q.query_id, vectors v) QUALIFY rank <= 10"""


@query(
    """SELECT query_id, paper_id, chunk_index, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id, chunk_index) AS rank FROM (
    SELECT query_id, paper_id, chunk_index, coalesce(0.6 / (60 + a.rank), 0) + coalesce(0.4 / (60 + b.rank), 0) AS score FROM hvs a FULL JOIN hbm b USING (query_id, paper_id, chunk_index))) WHERE rank <= 5""",
    "docs", "chunks", "toks", "post", "hq", "hqt", "hbm", "vectors", "hvs",
)
def ret22_hybrid_search(spark, sf):
    """Passages with the vector of their number; every fourth has no words, so it keeps the order of the vectors."""
    v = B.vectors(spark, sf)
    text = F.when(F.col("query_id") % 4 == 0, "").otherwise(F.col("query"))
    q = B.benchmark_queries(spark, sf).withColumn("query", text).join(v.select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    return _round(R.hybrid_search(q, _index(spark, sf), v, 5), "score", digits=9)

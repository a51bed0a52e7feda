"""Queries on layout, metadata and quality gates, with their SQL."""

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import layout as L
from ..operators import metadata as M
from . import bindings as B
from .bindings import query

B.SQL["words"] = """SELECT doc_id, CAST(ord // 480 + 1 AS INTEGER) AS page, ord, text, (ord % 12) * 80 AS x0, 60 + ((ord // 12) % 40) * 22 AS y0, (ord % 12) * 80 + 70 AS x1, 72 + ((ord // 12) % 40) * 22 AS y1
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord FROM documents)"""
B.SQL["lines"] = "SELECT doc_id, page, CAST((ord // 12) % 40 AS BIGINT) AS line, string_agg(text, ' ' ORDER BY ord) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY 1, 2, 3"


def words(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("ord", "text"))
    row = F.floor(F.col("ord") / 12) % 40
    return d.select("doc_id", (F.floor(F.col("ord") / 480) + 1).cast("int").alias("page"), "ord", "text", (F.col("ord") % 12 * 80).alias("x0"), (60 + row * 22).alias("y0"), (F.col("ord") % 12 * 80 + 70).alias("x1"), (72 + row * 22).alias("y1"))


@query("SELECT doc_id, page, line, md5(text) AS text_md5, x0, y0, x1, y1 FROM lines", "words", "lines")
def txt19_words_to_lines(spark, sf):
    return L.words_to_lines(words(spark, sf)).select("doc_id", "page", "line", F.md5(F.col("text").cast("binary")).alias("text_md5"), "x0", "y0", "x1", "y1")


@query(
    """SELECT doc_id, page, CAST((ord % 480) // 6 AS INTEGER) AS line, md5(regexp_replace(string_agg('_' || text, ' ' ORDER BY ord), '[ \t]+', ' ', 'g')) AS text_md5, min(x0) AS x0, max(ord % 480) * 0.5 + 1 AS y1 FROM words GROUP BY 1, 2, 3""",
    "words",
)
def txt19_anchored_lines(spark, sf):
    """Words of pages that slant by half a unit a word, so that six share a line."""
    top = (F.col("ord") % 480) * 0.5
    w = words(spark, sf).withColumns({"text": F.concat(F.lit("_"), "text"), "y0": top, "y1": top + 1})
    return L.anchored_lines(w).select("doc_id", "page", "line", F.md5(F.col("text").cast("binary")).alias("text_md5"), "x0", "y1")


_SQL_TYPE = """CASE WHEN y0 < 50 THEN 'header' WHEN y0 > 950 THEN 'footer' WHEN first AND y0 < 300 AND h > 20 AND c > 200 AND c < 800 AND n < 200 AND NOT dot THEN 'title'
    WHEN first AND y0 > 150 AND y0 < 400 AND regexp_matches(t, '[A-Z][a-z]+\\s+[A-Z][a-z]+') AND n < 300 AND h < 20 THEN 'author' WHEN regexp_matches(t, '^(Abstract|摘\\s*要|ABSTRACT)') THEN 'abstract'
    WHEN regexp_matches(t, '^(\\d+\\.?\\s+|[IVX]+\\.?\\s+|第[一二三四五六七八九十]+[章节])') AND n < 100 AND NOT dot THEN 'section_header' WHEN upper(t) = t AND regexp_matches(t, '\\p{Lu}') AND n < 80 AND n > 3 THEN 'section_header'
    WHEN regexp_matches(t, '^(Keywords?|关键[词字]|KEYWORDS)') THEN 'other' WHEN regexp_matches(t, '^(References?|参考文献|REFERENCES|Bibliography)') THEN 'reference' WHEN regexp_matches(t, '^\\[\\d+\\]') OR regexp_matches(t, '^\\d+\\.\\s+[A-Z]') THEN 'reference'
    WHEN regexp_matches(t, '(?i)^(Fig\\.?|Figure|图)\\s*\\d') OR regexp_matches(t, '(?i)^(Table|表)\\s*\\d') THEN 'caption' WHEN regexp_matches(t, '^[-•*]\\s') OR regexp_matches(t, '^\\([a-z]\\)') THEN 'list'
    WHEN len(regexp_extract_all(t, '[∑∏∫∂∇≤≥±∞≈≠∈∉⊂⊃∩∪αβγδεζηθλμπσφψω]')) > 3 THEN 'formula' ELSE 'paragraph' END"""
B.SQL["typed"] = f"""SELECT doc_id, page, line, text, y0, {_SQL_TYPE} AS type FROM (SELECT *, trim(text) AS t, length(trim(text)) AS n, trim(text) LIKE '%.' AS dot, page = 1 AS first, y1 - y0 AS h, (x0 + x1) / 2 AS c FROM lines)"""


@query("SELECT doc_id, type, count(*) AS lines FROM typed GROUP BY 1, 2", "words", "lines", "typed")
def txt20_classify_lines(spark, sf):
    return L.classify_lines(L.words_to_lines(words(spark, sf))).groupBy("doc_id", "type").agg(F.count("*").alias("lines"))


def _regions(spark, sf):
    return L.classify_lines(L.words_to_lines(words(spark, sf))).withColumnRenamed("line", "order")


@query(
    """SELECT doc_id, page, md5(CASE WHEN length(built) >= greatest(80, length(raw) / 5) THEN built ELSE raw END) AS text_md5 FROM (SELECT doc_id, page, string_agg(text, ' ' ORDER BY ord) AS raw FROM words GROUP BY 1, 2) LEFT JOIN (
    SELECT doc_id, page, string_agg(trim(text), chr(10) ORDER BY line) AS built FROM typed WHERE type NOT IN ('reference', 'header', 'footer') AND NOT (type IN ('other', 'unknown') AND length(trim(text)) < 25) AND trim(text) <> '' GROUP BY 1, 2) USING (doc_id, page)""",
    "words", "lines", "typed",
)
def txt21_page_text(spark, sf):
    """The raw text of a page is that of its lines: words joined by blanks, as in a line."""
    return L.page_text(_regions(spark, sf)).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, page, count_if(type = 'reference') >= 0.5 * count(*) AS is_reference FROM typed GROUP BY 1, 2", "words", "lines", "typed")
def txt22_reference_pages(spark, sf):
    return L.reference_pages(_regions(spark, sf))


@query(
    """SELECT doc_id, nullif(trim(coalesce(string_agg(text, ' ' ORDER BY line) FILTER (type = 'title' AND page = 1), '')), '') AS title, nullif(trim(coalesce(string_agg(text, ' ' ORDER BY line) FILTER (type = 'abstract' AND page = 1), '')), '') AS abstract,
    array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(string_agg(text, ' ' ORDER BY line) FILTER (type = 'author' AND page = 1), ''), '[,;，；]|\\sand\\s'), lambda x: trim(x)), lambda x: length(x) > 1), ';') AS authors,
    coalesce(string_agg(text || ':' || page, ';' ORDER BY page, line) FILTER (type = 'section_header'), '') AS sections FROM typed GROUP BY 1""",
    "words", "lines", "typed",
)
def txt23_layout_metadata(spark, sf):
    return L.layout_metadata(_regions(spark, sf)).select("doc_id", "title", "abstract", F.array_join("authors", ";").alias("authors"), F.array_join("sections", ";").alias("sections"))


@query("SELECT doc_id, round(chars / pages, 6) AS chars_per_page, CASE WHEN chars / pages < 100 THEN 'sanity_text_short' ELSE '' END AS issues FROM (SELECT doc_id, length(text) AS chars, doc_id % 4 + 1 AS pages FROM documents)")
def txt24_sanity_gate(spark, sf):
    d = B.read(spark, sf, "documents").withColumn("pages", F.col("doc_id") % 4 + 1)
    return L.sanity_gate(d).select("doc_id", F.round("chars_per_page", 6).alias("chars_per_page"), F.array_join("issues", ",").alias("issues"))


@query("SELECT doc_id, CASE WHEN bool_and(n <= 50) THEN 'scanned' WHEN doc_id % 7 = 0 THEN 'images' WHEN count(*) > 3 THEN 'multi_page' ELSE 'simple' END AS route FROM (SELECT doc_id, page, sum(length(text)) AS n FROM words GROUP BY 1, 2) GROUP BY 1", "words")
def txt25_route_documents(spark, sf):
    stats = words(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n_chars")).withColumn("n_images", (F.col("doc_id") % 7 == 0).cast("int"))
    return L.route_documents(stats)


_RELIABLE = "coalesce(length(trim({0})) BETWEEN 12 AND 260 AND NOT regexp_matches(lower(trim({0})), '" + "|".join(x.replace(".", r"\.") for x in L.TITLE_NOISE) + "') AND NOT (contains(trim({0}), '.') AND len(regexp_split_to_array(trim({0}), '\\s+')) > 8) AND regexp_matches(trim({0}), '^[\\p{{Lu}}\\x{{4e00}}-\\x{{9fff}}]') AND len(regexp_split_to_array(trim({0}), '\\s+')) > 2 AND length({0}) - length(replace({0}, ';', '')) < 2, FALSE)"


def _sql_author(x: str) -> str:
    """What reliable_authors asks of a name."""
    noise = "|".join(M.AUTHOR_NOISE)
    return f"length({x}) BETWEEN 2 AND 60 AND NOT regexp_matches(lower({x}), '{noise}') AND NOT regexp_matches({x}, '[0-9]') AND length({x}) - length(replace({x}, ',', '')) <= 1 AND len(string_split({x}, ' ')) <= 6 AND (NOT regexp_matches({x}, '[A-Za-z]') OR regexp_matches({x}, '(^| )\\p{{Lu}}'))"


def _sql_abstract(x: str) -> str:
    """What reliable_abstract asks, of a text without runs of blanks."""
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    letters = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    return f"coalesce(length({t}) >= 60 AND NOT (NOT regexp_matches({t}, '[\\x{{4e00}}-\\x{{9fff}}]') AND {letters} > 200 AND length({t}) - length(replace({t}, ' ', '')) < greatest(10, floor({letters} * 0.02))), FALSE)"


B.SQL["two"] = """SELECT work_id AS doc_id, title, t[2] AS title2, 'file ' || work_id AS name, list_filter(w[1:4], lambda x: x <> '') AS authors, list_filter(w[5:7], lambda x: length(x) > 1) AS authors2,
    t[1] AS abstract, CASE WHEN work_id % 3 = 0 THEN replace(abstract, ' ', '') WHEN work_id % 3 = 1 THEN abstract END AS abstract2, CASE WHEN work_id % 2 = 0 THEN t[1:1] ELSE [] END AS sections, t[2:3] AS sections2
    FROM (SELECT *, string_split(abstract, chr(10)) AS t, string_split(abstract, ' ') AS w FROM works)"""


@query(
    f"""SELECT doc_id, CASE WHEN {_RELIABLE.format('title')} THEN title WHEN {_RELIABLE.format('title2')} THEN title2 ELSE name END AS title,
    array_to_string(CASE WHEN len(authors2) > 0 AND NOT (len(authors) > 0 AND len(list_filter(authors, lambda x: {_sql_author('x')})) >= greatest(1, len(authors) // 2)) THEN authors2 ELSE authors END, ';') AS authors,
    md5(CASE WHEN NOT {_sql_abstract('abstract')} AND {_sql_abstract('abstract2')} THEN abstract2 ELSE abstract END) AS abstract_md5, md5(array_to_string(CASE WHEN len(sections) > 0 THEN sections ELSE sections2 END, ';')) AS sections_md5 FROM two""",
    "works", "two",
)
def txt37_merge_metadata(spark, sf):
    """The first line and words as the rules' fields, the ones after them as the layout's; abstracts without blanks, whole or none."""
    w = B.works(spark, sf).withColumns({"t": F.split("abstract", "\n"), "w": F.split("abstract", " ")})
    part = lambda c, start, n, least: F.filter(F.slice(c, start, n), lambda x: F.length(x) >= least)
    key, none = F.col("work_id").alias("doc_id"), F.array().cast("array<string>")
    lines = F.when(F.col("work_id") % 2 == 0, F.slice("t", 1, 1)).otherwise(none)
    rules = w.select(key, "title", F.concat(F.lit("file "), "work_id", F.lit(".pdf")).alias("file_name"), part("w", 1, 4, 1).alias("authors"), F.get("t", 0).alias("abstract"), lines.alias("sections"))
    whole = F.when(F.col("work_id") % 3 == 0, F.replace("abstract", F.lit(" "), F.lit(""))).when(F.col("work_id") % 3 == 1, F.col("abstract"))
    layout = w.select(key, F.get("t", 1).alias("title"), part("w", 5, 3, 2).alias("authors"), whole.alias("abstract"), F.slice("t", 2, 2).alias("sections"))
    df = M.merge_metadata(rules, layout)
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return df.select("doc_id", "title", F.array_join("authors", ";").alias("authors"), "abstract", F.array_join("sections", ";").alias("sections")).select("doc_id", "title", "authors", md5("abstract"), md5("sections"))


@query(
    f"SELECT paper_id, CAST(rank AS INTEGER) AS rank, term, count FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY count DESC, term) AS rank FROM (SELECT paper_id, term, count(*) AS count FROM (SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '[a-zA-Z]{{3,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,6}}')) AS term FROM docs) WHERE term NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}) GROUP BY 1, 2)) WHERE rank <= 10",
    "docs",
)
def txt29_top_terms(spark, sf):
    return L.top_terms(B.docs(spark, sf)).select("paper_id", "rank", "term", "count")


@query("SELECT o_orderkey AS paper_id, CASE WHEN form < 2 THEN d WHEN form < 5 THEN make_date(year(d), 1, 1) END AS published FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey % 6 AS form FROM orders)")
def txt30_publication_date(spark, sf):
    """The dates of orders, in metadata and in the forms that texts name them in; one form names none."""
    d, form = F.to_date("o_orderdate"), F.col("o_custkey") % 6
    meta = F.when(form == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00")))
    text = (
        F.when(form == 1, F.concat(F.lit("A title\nAccepted: "), F.date_format(d, "yyyy/M/d"), F.lit(" and more")))
        .when(form == 2, F.concat(F.lit("Received: "), F.date_format(d, "d MMMM yyyy")))
        .when(form == 3, F.concat(F.lit("Proceedings, "), F.date_format(d, "MMMM yyyy"), F.lit(", pp. 1-9")))
        .when(form == 4, F.concat(F.lit("录用于 "), F.date_format(d, "yyyy"), F.lit(" 年")))
        .otherwise(F.concat(F.lit("Edition of "), F.date_format(d, "yyyy")))
    )
    return B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), L.publication_date(meta, text).alias("published"))


@query("SELECT work_id, coalesce(length(t) BETWEEN 12 AND 260 AND NOT contains(lower(t), 'copyright') AND NOT contains(lower(t), 'whether') AND NOT contains(lower(t), 'despite') AND NOT (contains(t, '.') AND len(string_split(t, ' ')) > 8) AND regexp_matches(t, '^\\p{Lu}') AND len(string_split(t, ' ')) > 2 AND length(t) - length(replace(t, ';', '')) < 2, FALSE) AS reliable FROM (SELECT work_id, trim(title) AS t FROM works)", "works")
def txt31_reliable_title(spark, sf):
    return B.works(spark, sf).select("work_id", L.reliable_title(F.col("title")).alias("reliable"))


@query()
def txt33_structure_score(spark, sf):
    from .text_queries import marked

    kind = F.get(F.array(*map(F.lit, ("simple", "formula_heavy", "table_heavy", "dual_column", "scan"))), (F.col("paper_id") % 5).cast("int"))
    m = marked(spark, sf).withColumns({"pages": F.lit(2), "category": kind})
    return L.structure_score(m).select("paper_id", "category", "score", "headings", "tables", "formulas")


@query(
    """SELECT work_id, '[' || row_number() OVER (PARTITION BY source ORDER BY work_id) || '] ' || coalesce(nullif(author, ''), 'Unknown') || ' (' || year || '). ' || coalesce(nullif(title, ''), 'Untitled') || '. *' || source || '*, *' || citation_count || '*.' || CASE WHEN doi IS NULL THEN '' ELSE ' https://doi.org/' || doi END AS formatted FROM works""",
    "works",
)
def txt34_format_references(spark, sf):
    none = F.lit(None).cast("string")
    w = B.works(spark, sf).select("work_id", "source", F.col("work_id").alias("ord"), "title", "author", "year", F.col("source").alias("journal"), F.col("citation_count").alias("volume"), none.alias("issue"), none.alias("pages"), "doi", none.alias("url"), none.alias("key"))
    return L.format_references(w, "apa", ["source"]).select("work_id", "formatted")


@query("SELECT doc_id, CAST(page AS INTEGER) AS page, md5(string_agg(CASE page WHEN 0 THEN '# ' ELSE '- ' END || line, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM (SELECT doc_id, i, line, least(i, 2) AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)) WHERE trim(line) <> '' GROUP BY 1, 2")
def src08_content_to_pages(spark, sf):
    from ..sources.works import content_to_pages

    d = B.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).where(F.trim("text") != "")
    items = d.select("doc_id", "ord", F.least(F.col("ord"), F.lit(2)).alias("page"), F.when(F.col("ord") == 0, "title").otherwise("list").alias("type"), "text", F.lit(1).alias("level"), F.lit(None).cast("string").alias("body"))
    pages = content_to_pages(items, items.groupBy("doc_id").agg((F.max("page") + 1).alias("pages")))
    return pages.where("markdown != ''").select("doc_id", "page", F.md5(F.col("markdown").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, max(n_chars) AS n_chars FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def src11_upsert_latest(spark, sf):
    from ..sources.stores import upsert_latest

    d = B.read(spark, sf, "documents").select("doc_id", "n_chars", F.lit(1).alias("at"))
    return upsert_latest(d.where("doc_id % 3 != 0"), d.where("doc_id % 2 = 0").withColumns({"n_chars": F.col("n_chars") + 1, "at": F.lit(2)}), "doc_id", "at").select("doc_id", "n_chars")


@query("SELECT paper_id || '_' || (row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) - 1) AS id, paper_id FROM chunks", "docs", "chunks")
def src12_to_vector_rows(spark, sf):
    from ..sources.stores import to_vector_rows

    return to_vector_rows(B.chunks(spark, sf)).select("id", "paper_id")


@query(
    "SELECT paper_id, chunk_index, md5(text || CASE WHEN paper_id % 2 = 0 THEN '!' ELSE '' END) AS text_md5 FROM chunks WHERE paper_id % 5 <> 3",
    "docs", "chunks",
)
def src09_versioned_chunks(spark, sf):
    """All chunks stored, those of every second paper replaced, every fifth paper emptied, and the store compacted between."""
    from ..functions.lineage import new_folder
    from ..sources import stores as S

    path, chunks = new_folder(spark), B.chunks(spark, sf)
    S.write_chunks(chunks, path)
    S.write_chunks(chunks.where("paper_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))), path)
    S.vacuum(spark, path, S.compact(spark, path))
    S.write_chunks(chunks.limit(0), path, B.docs(spark, sf).where("paper_id % 5 = 3").select("project_id", "paper_id"))
    return S.read_chunks(spark, path).select("paper_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "SELECT paper_id, part AS parent, md5(text) AS text_md5 FROM (SELECT paper_id, chunk_index // 4 AS part, text FROM chunks WHERE chunk_index % 4 = 0) WHERE part % 2 = 0",
    "docs", "chunks",
)
def src10_parents_by_id(spark, sf):
    """Every fourth chunk stored as a parent, and every second one fetched by its id."""
    from ..functions.lineage import new_folder
    from ..sources import stores as S

    path, part = new_folder(spark), F.floor(F.col("chunk_index") / 4)
    parents = B.chunks(spark, sf).where("chunk_index % 4 = 0").select("paper_id", F.concat_ws("_p", "paper_id", part).alias("parent_id"), part.alias("parent"), "text")
    S.write_parents(parents, path)
    found = S.parents_by_id(S.read_parents(spark, path), parents.where("parent % 2 = 0").select("parent_id"))
    return found.select("paper_id", "parent", F.md5(F.col("text").cast("binary")).alias("text_md5"))

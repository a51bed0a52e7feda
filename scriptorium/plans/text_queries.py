"""Queries on corpus preparation, with their SQL."""

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..operators import hierarchy as H
from . import bindings as B
from .bindings import query

md5 = lambda c: F.md5(F.col(c).cast("binary"))
B.SQL["marked"] = """SELECT doc_id AS paper_id, string_agg(CASE WHEN i % 5 = 0 THEN repeat('#', 1 + (i // 5) % 3) || ' ' ELSE '' END || line, chr(10) ORDER BY i) AS markdown
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY 1"""


def marked(spark, sf):
    """Documents whose every fifth line is a heading of level 1, 2, 3 in turn."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 5) % 3).cast("int")), F.lit(" "), x)).otherwise(x))
    return B.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.array_join(lines, "\n").alias("markdown"))


@query(
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || chr(9) || ' x ' || chr(1), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10))) AS text_md5 FROM documents"""
)
def txt01_clean_text(spark, sf):
    d = B.read(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\n\n\n\t x \x01")))
    return d.withColumn("text", T.clean_text(F.col("text"))).select("doc_id", md5("text").alias("text_md5"))


@query()
def txt02_semantic_chunks(spark, sf):
    return K.semantic_chunks(B.docs(spark, sf).select("paper_id", "text")).select("paper_id", "chunk_index", "start", "end", md5("text").alias("text_md5"))


@query("SELECT paper_id, chunk_index, md5(text) AS text_md5 FROM chunks", "docs", "chunks")
def txt03_overlap_chunks(spark, sf):
    return B.chunks(spark, sf).select("paper_id", "chunk_index", md5("text").alias("text_md5"))


@query()
def txt04_sentence_chunks(spark, sf):
    return K.sentence_chunks(B.docs(spark, sf).select("paper_id", "text")).select("paper_id", "chunk_index", md5("text").alias("text_md5"))


@query(
    """SELECT paper_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '-\\n(\\S)', '\\1', 'g'), '\\\\\\((.+?)\\\\\\)', '$\\1$', 'g'), '\\|[\\s:]*-{2,}[\\s:]*', '| --- ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_md5
    FROM (SELECT paper_id, markdown || ' \\(a+b\\) |:-----:| x-' || chr(10) || 'y' AS t FROM marked)""",
    "marked",
)
def txt05_clean_markdown(spark, sf):
    d = marked(spark, sf).withColumn("markdown", F.concat("markdown", F.lit(" \\(a+b\\) |:-----:| x-\ny")))
    return d.withColumn("markdown", T.clean_markdown(F.col("markdown"))).select("paper_id", md5("markdown").alias("text_md5"))


def _sql_rules(text: str, rules: list[tuple[str, str]]) -> str:
    """The same replacements under another engine: it has no flag d, and writes groups otherwise."""
    for pattern, by in rules:
        pattern = re.sub(r"^\(\?(\w+)\)", lambda m: f"(?{m[1].replace('d', '')})" if m[1] != "d" else "", pattern)
        by = by.replace("\\$", "\0").replace("$1", "\\1").replace("\0", "$")
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


@query(f"SELECT paper_id, md5({_sql_rules('markdown', T.MARKDOWN_MARKS)}) AS text_md5 FROM marked", "marked")
def txt06_markdown_to_text(spark, sf):
    return marked(spark, sf).withColumn("markdown", T.markdown_to_text(F.col("markdown"))).select("paper_id", md5("markdown").alias("text_md5"))


@query()
def txt07_markdown_metadata(spark, sf):
    return H.markdown_metadata(marked(spark, sf)).select("paper_id", "title", F.size("section_titles").alias("sections"), "has_tables", "has_formulas", "has_figures")


B.SQL["heads"] = """SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1 AS nr, length(regexp_extract(line, '^(#+) ', 1)) AS level, trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) AS title, pos AS char_start,
    coalesce(lead(pos) OVER (PARTITION BY paper_id ORDER BY i), total) AS char_end FROM (SELECT paper_id, i, line, total, coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM (SELECT paper_id, length(markdown) AS total, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM marked)) WHERE regexp_matches(line, '^#{1,3}\\s+\\S')"""


@query("SELECT paper_id, CAST(nr AS INTEGER) AS nr, CAST(level AS INTEGER) AS level, title, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM heads", "marked", "heads")
def txt08_split_sections(spark, sf):
    return H.split_sections(marked(spark, sf)).select("paper_id", "nr", "level", "title", "char_start", "char_end")


B.SQL["tree"] = """SELECT *, CASE WHEN level = 3 AND l2 IS NOT NULL AND (l1 IS NULL OR l2 > l1) THEN l2 WHEN level > 1 THEN l1 END AS parent FROM (SELECT *, max(CASE WHEN level = 1 THEN nr END) OVER p AS l1, max(CASE WHEN level = 2 THEN nr END) OVER p AS l2,
    lead(level) OVER (PARTITION BY paper_id ORDER BY nr) AS nl FROM heads WINDOW p AS (PARTITION BY paper_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("SELECT paper_id, CAST(nr AS INTEGER) AS nr, CAST(parent AS INTEGER) AS parent, coalesce(nl <= level, TRUE) AS is_leaf FROM tree", "marked", "heads", "tree")
def txt09_section_tree(spark, sf):
    return H.section_tree(H.split_sections(marked(spark, sf))).select("paper_id", "nr", "parent", "is_leaf")


@query("SELECT paper_id, CAST(nr AS INTEGER) AS nr, CAST(1 + nr // 2 AS INTEGER) AS page_start FROM heads", "marked", "heads")
def txt10_map_section_pages(spark, sf):
    s = H.split_sections(marked(spark, sf))
    known = s.select("paper_id", F.col("nr").alias("ord"), "title", "level", (1 + F.floor(F.col("nr") / 2)).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    return H.map_section_pages(s, known).select("paper_id", "nr", "page_start")


@query("SELECT paper_id, CAST(nr AS INTEGER) AS nr, CAST(1 + char_start // 1002 AS BIGINT) AS page_start FROM heads", "marked", "heads")
def txt11_offset_to_page(spark, sf):
    m = marked(spark, sf)
    pages = m.select("paper_id", F.explode(F.sequence(F.lit(1).cast("long"), (F.length("markdown") / 1002 + 1).cast("long"))).alias("page"), F.lit(1000).alias("n_chars"))
    return H.offset_to_page(H.split_sections(m), pages).select("paper_id", "nr", "page_start")


@query()
def txt16_hierarchical_chunks(spark, sf):
    return H.hierarchical_chunks(marked(spark, sf))[0].select("paper_id", "child_seq", "parent_id", "section_anchor", "page_number", md5("text").alias("text_md5"))


@query()
def txt18_prune_reference_chunks(spark, sf):
    return H.prune_reference_chunks(*H.hierarchical_chunks(marked(spark, sf)))[1].select("parent_id", "paper_id", F.array_join("child_chunk_indices", ",").alias("children"))


#: What is put before and after a text, by doc_id % 8: headings, enough or too few entries of each form, entries among many lines.
_AROUND = [("References\n", ""), ("", "\n[1] a\n[2] b\n[3] c"), ("", "\n1. Abc\n22. Bcd\n333. Cde"), ("", "\n[1] a\n2. Bcd"), ("", "\nA et al.b\nsee doi: 10.1234/x\n DOI:10.12345/y"), ("", "\n[1] a\n[2] b\n[3] c" + "\nplain" * 20), ("", ""), (" Bibliography  \n", "\n[1234] a")]
_ENTRIES = ["^\\s*\\[\\d{1,3}\\]\\s+", "^\\s*\\d{1,3}\\.\\s+[A-Z]", "(?i)\\bet al\\.\\b", "(?i)\\bdoi:\\s*10\\.\\d{4,9}/"]


def _sql_around(k: int) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '" + pair[k].replace("\n", "' || chr(10) || '") + "'" for i, pair in enumerate(_AROUND)) + " END"


@query(
    f"""SELECT doc_id, heading OR (hits >= 3 AND hits >= 0.2 * n) AS flag, heading OR (hits >= 3 AND hits >= 0.2 * n) OR doc_id % 5 = 0 AS by_region FROM (SELECT doc_id, regexp_matches(substr(t, 1, 400), '(?im)^\\s*(references?|bibliography)\\s*$') AS heading,
    len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS n, len(list_filter(string_split(t, chr(10)), lambda x: {" OR ".join(f"regexp_matches(trim(x), '{e}')" for e in _ENTRIES)})) AS hits
    FROM (SELECT doc_id, {_sql_around(0)} || text || {_sql_around(1)} AS t FROM documents))"""
)
def txt17_reference_like(spark, sf):
    d = B.read(spark, sf, "documents")
    put = [F.get(F.array(*(F.lit(x) for x in side)), (F.col("doc_id") % 8).cast("int")) for side in zip(*_AROUND)]
    regions = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("paragraph"), F.lit("Reference"))).when(F.col("doc_id") % 5 == 1, F.array(F.lit("title"), F.lit(None)))
    text = F.concat(put[0], "text", put[1])
    return d.select("doc_id", T.is_reference_like(text).alias("flag"), T.is_reference_like(text, region_types=regions).alias("by_region"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE CASE WHEN e > 250 THEN substr(text, 1, e) ELSE substr(text, 1, 500) END || '...' END) AS text_md5 FROM (SELECT doc_id, text, length(regexp_extract(substr(text, 1, 500), '(?s)^(.*[.。!！?？])', 1)) AS e FROM documents)")
def txt35_truncate_summary(spark, sf):
    return B.read(spark, sf, "documents").withColumn("text", T.truncate_summary(F.col("text"))).select("doc_id", md5("text").alias("text_md5"))

"""Queries on metadata from raw text and the whole processing of papers, with their SQL."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import hierarchy as H
from ..operators import metadata as M
from . import bindings as B
from .bindings import query
from .text_queries import marked


@query()
def txt26_extract_metadata(spark, sf):
    df = M.extract_metadata(B.docs(spark, sf).select("paper_id", "text"))
    return df.select("paper_id", "title", F.array_join("authors", ";").alias("authors"), "abstract", F.array_join("keywords", ";").alias("keywords"))


def _sections(spark, sf):
    s = H.section_tree(H.split_sections(marked(spark, sf)))
    return s.withColumns({"page_start": F.lit(1), "page_end": F.lit(3)})


@query()
def txt12_parent_segments(spark, sf):
    return H.parent_segments(_sections(spark, sf)).select("paper_id", "nr", "seg", "parent_id", "seg_start", "seg_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def txt13_child_chunks(spark, sf):
    rows = H.estimate_page(H.child_chunks(_sections(spark, sf), most=H.PARENT))
    return rows.select("paper_id", "child_seq", "parent_id", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _parsed(spark, sf):
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.col("markdown").alias("text"), F.col("markdown").alias("markdown")))
    meta = F.create_map(F.lit("date"), F.concat(2000 + F.col("paper_id") % 20, F.lit("-01-02")), F.lit("file_name"), F.concat("paper_id", F.lit(".pdf")))
    return marked(spark, sf).select("paper_id", "markdown", pages.alias("pages"), meta.alias("metadata"))


@query()
def txt36_process_papers(spark, sf):
    papers = M.process_papers(_parsed(spark, sf))[0]
    return papers.select("paper_id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "published", F.array_join("issues", ",").alias("issues"), "chunk_count", "skipped_chunks", "status")


#: Pieces of words that stand for hints and phrases of forms, so that a text's words decide.
_ADMIN = {"ing": "签字", "tion": "真实性", "que": "公章", "ción": "国家安全", "ich": "联系方式", "her": "学术不端", "thand": "无违法违纪行为", "ou": "知识产权"}


def _sql_admin() -> str:
    text = "text"
    for a, b in _ADMIN.items():
        text = f"replace({text}, '{a}', '{b}')"
    count = lambda tests: " + ".join(f"CAST({t} AS INTEGER)" for t in tests)
    strong, weak = count(f"regexp_matches(h, '{p}')" for p in T.ADMIN_PATTERNS), count(f"contains(h, '{x}')" for x in T.ADMIN_HINTS)
    return f"SELECT doc_id, coalesce(({strong}) >= 2 OR ({weak}) >= 3, FALSE) AS noise FROM (SELECT doc_id, substr({text}, 1, 1200) AS h FROM documents)"


@query(_sql_admin())
def ret10_admin_noise(spark, sf):
    text = F.col("text")
    for a, b in _ADMIN.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return B.read(spark, sf, "documents").select("doc_id", T.is_admin_noise(text).alias("noise"))


B.SQL["parse"] = """SELECT doc_id, lower(trim(substr(text, 1, 60))) AS got, lower(trim(substr(text, 21, 60))) AS want, coalesce(string_split(text, chr(10))[2], '') AS abstract, n_chars, len(string_split(text, chr(10))) AS lines, contains(text, '|') AS bars, contains(text, '#') AS marks FROM documents"""
B.SQL["pscores"] = """SELECT doc_id, list_filter([
    CASE WHEN want <> '' THEN CAST(contains(got, want) OR contains(want, got) OR len(list_intersect(gw, ww)) / greatest(len(gw), len(ww), 1) >= 0.6 AS DOUBLE) END,
    CAST((abstract <> '') = (n_chars > 1000) AS DOUBLE), least(length(abstract) / 100, 1.0), greatest(1 - abs(lines - (n_chars // 400 + 1)) / greatest(n_chars // 400 + 1, 1), 0.0),
    greatest(1 - abs(n_chars // 1000 + 1 - (n_chars // 700 + 1)) / greatest(n_chars // 700 + 1, 1), 0.0), CAST(bars = (n_chars > 3000) AS DOUBLE), CAST(marks AS DOUBLE)], lambda x: x IS NOT NULL) AS s
    FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(got, '\\s+'), lambda w: w <> '')) AS gw, list_distinct(list_filter(regexp_split_to_array(want, '\\s+'), lambda w: w <> '')) AS ww FROM parse)"""


@query("SELECT doc_id, round(list_sum(s) / len(s), 6) AS score, len(s) AS items FROM pscores", "parse", "pscores")
def evl07_parse_quality(spark, sf):
    """What the head, second line, lines and marks of each text are against what its length and a later part of it let expect."""
    none, lines = F.lit(None), F.split("text", "\n", -1)
    whole = lambda n: (F.floor(F.col("n_chars") / n) + 1).cast("int")
    parsed = F.struct(
        F.substring("text", 1, 60).alias("title"), F.coalesce(F.get(lines, 1), F.lit("")).alias("abstract"), lines.alias("section_names"), whole(1000).alias("page_count"),
        F.contains("text", F.lit("|")).alias("has_tables"), F.contains("text", F.lit("#")).alias("has_formulas"), none.cast("boolean").alias("has_figures"),
    )
    expected = F.struct(
        F.substring("text", 21, 60).alias("title"), (F.col("n_chars") > 1000).alias("has_abstract"), F.lit(100).alias("abstract_min_length"), whole(400).alias("section_count_approx"), none.cast("array<string>").alias("known_sections"),
        whole(700).alias("page_count_approx"), (F.col("n_chars") > 3000).alias("has_tables"), F.lit(True).alias("has_formulas"), none.cast("boolean").alias("has_figures"),
    )
    pairs = B.read(spark, sf, "documents").select("doc_id", parsed.alias("parsed"), expected.alias("expected"))
    return E.parse_quality(pairs).withColumn("score", F.round("score", 6))

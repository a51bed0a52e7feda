"""Sections, parents and children of Markdown documents, over whole tables.

A document's headings are rows; windows run within one document, whose rows are
never more than its headings or chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut_lineage
from ..functions.text import is_reference_like
from .chunking import _blanks_cut, _trim, semantic_chunks

# A heading has a word on its own line; \x0b counts as one, as under the engine of the SQL.
HEADING = r"(?md)^(#{1,3})[ \t\f\r]+([^ \t\f\r\n][^\n]*)"
#: Characters of a parent at most.
PARENT = 2000


def markdown_metadata(df: DataFrame, text: str = "markdown") -> DataFrame:
    """df with title, abstract, section_titles, has_tables, has_formulas and has_figures."""
    t = F.col(text)
    null_if_empty = lambda c: F.when(c != "", c)
    abstract = _trim(F.regexp_extract(t, r"(?mi)^#{1,3}\s+(?:Abstract|摘\s*要)\s*\n([\s\S]+?)(?=\n#{1,3}\s+|\z)", 1))
    formula = t.rlike(r"(?s)\$\$.+?\$\$") | t.rlike(r"(?<!\$)\$(?!\$)(?!\s).+?(?<!\s)(?<!\$)\$(?!\$)")
    return df.withColumns({
        "title": null_if_empty(_trim(F.regexp_extract(t, r"(?md)^#\s+(.+)$", 1))),
        "abstract": F.when(F.length(abstract) > 50, F.substring(abstract, 1, 2000)),
        "section_titles": F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?md)^(#{1,3})\s+(.+)$"), 2), _trim), lambda x: x != ""),
        "has_tables": t.rlike(r"(?d)\|.+\|.+\|"), "has_formulas": formula, "has_figures": t.rlike(r"(?d)!\[.*?\]\(.*?\)"),
    })


def split_sections(df: DataFrame, key: str = "paper_id", text: str = "markdown") -> DataFrame:
    """key, nr, level, title, text, char_start and char_end of each section, from its heading to the next.

    What stands before the first heading belongs to none; a document without
    headings is one section "(document)" of level 0. Blank documents have none.
    Marks without a word on their line are text.
    """
    pieces = F.split(text, HEADING.replace("^", "(?=^", 1) + ")", -1)
    rows = df.where(_trim(F.col(text)) != "").select(key, F.posexplode(pieces).alias("piece", "text"))
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumns({"char_start": before, "level": F.length(F.regexp_extract("text", HEADING, 1)).cast("int")})
    has = F.max("level").over(W.partitionBy(key)) > 0
    heads = rows.withColumn("__has", has).where((F.col("level") > 0) | ~F.col("__has"))
    title = F.when(F.col("level") > 0, _trim(F.regexp_extract("text", HEADING, 2))).otherwise("(document)")
    nr = F.row_number().over(W.partitionBy(key).orderBy("piece")) - 1
    return heads.select(key, nr.alias("nr"), "level", title.alias("title"), "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


def slug(path: Column) -> Column:
    """Lower-case words of a path joined by hyphens, 128 characters at most."""
    s = F.regexp_replace(F.lower(path), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_>]+", "-"), r"-{2,}", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+\z", ""), 1, 128)


def section_tree(sections: DataFrame, key: str = "paper_id") -> DataFrame:
    """sections with parent (its nr), path, anchor and is_leaf.

    The parent is the nearest heading before of a lower level. With three levels
    that is the last heading of level 2 or 1, whichever counts after higher ones.
    """
    past = W.partitionBy(key).orderBy("nr").rowsBetween(W.unboundedPreceding, -1)
    last = lambda level, c: F.last(F.when(F.col("level") == level, F.col(c)), ignorenulls=True).over(past)
    following = F.lead("level").over(W.partitionBy(key).orderBy("nr"))
    df = sections.withColumns({"__1": last(1, "nr"), "__t1": last(1, "title"), "__2": last(2, "nr"), "__t2": last(2, "title"), "__leaf": F.coalesce(following <= F.col("level"), F.lit(True))})
    two = F.col("__2").isNotNull() & (F.col("__1").isNull() | (F.col("__2") > F.col("__1"))) & (F.col("level") == 3)
    one = F.col("__1").isNotNull() & (F.col("level") > 1)
    parent = F.when(two, F.col("__2")).when(one, F.col("__1"))
    # a second-level parent hangs on the first-level heading before it
    up2 = F.when(two & F.col("__1").isNotNull(), F.col("__t1"))
    path = F.when(two, F.concat_ws(" > ", up2, "__t2", "title")).when(one, F.concat_ws(" > ", "__t1", "title")).otherwise(F.col("title"))
    df = df.withColumns({"parent": parent, "path": path})
    base = F.when(F.col("level") == 0, "sec-document").otherwise(F.concat(F.lit("sec-"), slug(F.col("path"))))
    df = df.withColumn("__base", base).withColumn("__k", F.row_number().over(W.partitionBy(key, "__base").orderBy("nr")))
    anchor = F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", "__k"))
    df = df.withColumns({"anchor": anchor, "is_leaf": F.col("__leaf")})
    return df.drop("__leaf", "__1", "__t1", "__2", "__t2", "__base", "__k")


def map_section_pages(sections: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    """sections with page_start and page_end of the known section of equal title, level and occurrence; else page 1."""
    turn = lambda order: F.row_number().over(W.partitionBy(key, "__t", "level").orderBy(order))
    named = lambda df, order: df.withColumn("__t", F.lower(F.trim("title"))).withColumn("__k", turn(order))
    pages = named(known, "ord").select(key, "__t", "level", "__k", "page_start", "page_end")
    df = named(sections, "nr").join(pages, [key, "__t", "level", "__k"], "left").drop("__t", "__k")
    return df.withColumns({"page_end": F.coalesce("page_end", "page_start", F.lit(1)), "page_start": F.coalesce("page_start", F.lit(1))})


def offset_to_page(sections: DataFrame, pages: DataFrame, key: str = "paper_id") -> DataFrame:
    """sections with the page that holds their start, and page_end from the next section's start.

    pages: (key, page, n_chars); a page's text is followed by two separators.
    """
    at = F.coalesce(F.sum(F.col("n_chars") + 2).over(W.partitionBy(key).orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # beginnings of pages and sections in one order; a section's page is the last that began
    none = lambda kind: F.lit(None).cast(kind)
    begins = pages.select(key, at.cast("long").alias("at"), F.col("page"), none("int").alias("nr"))
    heads = sections.select(key, F.col("char_start").cast("long").alias("at"), none(dict(pages.dtypes)["page"]).alias("page"), "nr")
    order = W.partitionBy(key).orderBy("at", F.col("nr").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = begins.unionByName(heads).withColumn("page_start", F.coalesce(F.last("page", ignorenulls=True).over(order), F.lit(1))).where("nr is not null")
    start = sections.join(found.select(key, "nr", "page_start"), [key, "nr"])
    return start.withColumn("page_end", F.coalesce(F.lead("page_start").over(W.partitionBy(key).orderBy("nr")), F.col("page_start")))


def _packed(text: str, most: int) -> list[str]:
    """Paragraphs packed into segments of at most `most` characters; longer paragraphs are cut hard."""
    if len(text) <= most:
        return [text]
    packed, now, n = [], [], 0
    for p in re.split(r"\n{2,}", text):
        if n and n + len(p) + 2 > most:
            packed.append(_blanks_cut("\n\n".join(now)))
            now, n = [], 0
        if n:  # a first paragraph that is empty counts for nothing
            now.append(p)
            n += len(p) + 2
        else:
            now, n = [p], len(p)
    packed.append(_blanks_cut("\n\n".join(now)))
    hard = lambda s: [s[i : i + most] for i in range(0, len(s), most)]
    return [x for s in packed for x in (hard(s) if len(s) > most else [s]) if _blanks_cut(x)]


def _pack_texts(most: int):
    """Of an Arrow column of sections, for each a list of (text, start, n) of its n segments: where each next occurs, else where the last one ended."""

    def pack(texts):
        import pyarrow as pa

        sizes, segments, starts, many = [0], [], [], []
        for text in texts.to_pylist():
            at, packed = 0, _packed(text, most)
            for s in packed:
                place = text.find(s, at)
                at = place if place >= 0 else at
                starts.append(at)
                at += len(s)
            segments += packed
            many += [len(packed)] * len(packed)
            sizes.append(len(segments))
        ints = [pa.array(x, pa.int32()) for x in (starts, many)]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(segments, pa.string()), *ints], names=["text", "start", "n"]))

    return pack


def _segment_bounds(most: int):
    """The same segments as (seg, start, end), without their texts."""
    pack = _pack_texts(most)

    def bounds(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pack(texts)
        text, start, _ = lists.flatten().flatten()
        cuts = lists.offsets.to_numpy()
        seg = np.arange(len(text)) - np.repeat(cuts[:-1], np.diff(cuts))
        parts = [pa.array(seg, pa.int32()), start, pc.add(start, pc.utf8_length(text))]
        return pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(parts, names=["seg", "start", "end"]))

    return bounds


def _parent_id(key: str, seg: Column, n: Column) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit("_p"), F.col("nr"), F.when(n > 1, F.concat(F.lit("_"), seg)).otherwise(""))


def parent_segments(sections: DataFrame, most: int = PARENT, key: str = "paper_id") -> DataFrame:
    """key, nr, seg, parent_id, text, seg_start and seg_end (in the section) of each parent.

    Ids count sections in pre-order, references included, which have no parents. A section is packed
    in Arrow batches, in time by its length.
    """
    pack = F.arrow_udf(_pack_texts(most), "array<struct<text:string,start:int,n:int>>")
    rows = sections.where(~is_reference_like(F.col("text"))).select(key, "nr", "path", "anchor", F.posexplode(pack("text")).alias("seg", "__s"))
    start, text = F.col("__s.start"), F.col("__s.text")
    return rows.select(key, "nr", "seg", _parent_id(key, F.col("seg"), F.col("__s.n")).alias("parent_id"), "path", "anchor", text.alias("text"), start.alias("seg_start"), (start + F.length(text)).alias("seg_end"))


def _holding(segments: Column, start: Column, end: Column) -> Column:
    """Of an ordered array of segments the first that holds the middle between start and end, else the last."""
    middle = (start + end) / 2
    inside = F.filter(segments, lambda s: (s["start"] <= middle) & (middle <= s["end"]))
    return F.coalesce(F.get(inside, F.lit(0)), F.element_at(segments, -1))


def child_chunks(sections: DataFrame, size: int = 400, overlap: int = 50, key: str = "paper_id", most: int | None = None) -> DataFrame:
    """key, nr, child_seq, text, start and end of the chunks of each section's own text, numbered through the paper.

    most: with parent_id, as assign_parents finds it among parent_segments of that size; a section's
    segments are told where its text is cut, so that neither texts nor segments are moved for it.
    """
    own = sections.where(~is_reference_like(F.col("text"))).select(key, "nr", "path", "anchor", "page_start", "page_end", "is_leaf", F.col("text").alias("body"))
    # a section's text ends at the next heading of any level, so its own text is all of it
    own = own.where((_trim(F.col("body")) != "") & (F.col("is_leaf") | (F.length(_trim(F.col("body"))) >= 20))).withColumn("source_len", F.length("body"))
    if most is not None:
        own = own.withColumn("__segs", F.arrow_udf(_segment_bounds(most), "array<struct<seg:int,start:int,end:int>>")("body"))
    rows = semantic_chunks(own, size, overlap, "body")
    if most is not None:
        rows = rows.withColumn("parent_id", _parent_id(key, _holding(F.col("__segs"), F.col("start"), F.col("end"))["seg"], F.size("__segs"))).drop("__segs")
    seq = F.row_number().over(W.partitionBy(key).orderBy("nr", "chunk_index")) - 1
    return rows.withColumn("child_seq", seq).withColumnRenamed("body", "text")


def assign_parents(children: DataFrame, segments: DataFrame, key: str = "paper_id") -> DataFrame:
    """children with the parent_id of the segment that holds their middle, else of the section's last.

    A section's segments come as one array, so that no child's text meets more than one row.
    """
    own = segments.groupBy(key, "nr").agg(F.array_sort(F.collect_list(F.struct("seg", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "parent_id"))).alias("__segs"))
    met = children.join(own, [key, "nr"])
    return met.withColumn("parent_id", _holding(F.col("__segs"), F.col("start"), F.col("end"))["parent_id"]).drop("__segs")


def estimate_page(children: DataFrame) -> DataFrame:
    """children with page_number by their middle's share of the section's text."""
    pages = F.col("page_end") - F.col("page_start") + 1
    share = F.greatest(F.least((F.col("start") + F.col("end")) / 2 / F.greatest(F.col("source_len"), F.lit(1)), F.lit(1.0)), F.lit(0.0))
    page = F.when((F.col("page_end") <= F.col("page_start")) | (F.col("source_len") <= 0), F.col("page_start")).otherwise(F.col("page_start") + F.least(pages - 1, F.floor(share * pages)))
    return children.withColumn("page_number", page.cast("int"))


def hierarchical_chunks(docs: DataFrame, known: DataFrame | None = None, key: str = "paper_id", text: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """children (key, child_seq, parent_id, text, section_path, section_anchor, page_number) and parents with their children.

    Papers whose sections yield no child have flat chunks without a parent. The children are checkpointed, as both
    results and the search for such papers are made of them.
    """
    sections = section_tree(split_sections(docs, key, text), key)
    none = sections.select(key, F.lit(0).alias("ord"), "title", "level", F.lit(1).alias("page_start"), F.lit(1).alias("page_end")).limit(0)
    sections = map_section_pages(sections, known if known is not None else none, key)
    segments = parent_segments(sections, PARENT, key)
    children = estimate_page(child_chunks(sections, key=key, most=PARENT))
    children = cut_lineage(children.select(key, "child_seq", "parent_id", "text", F.col("path").alias("section_path"), F.col("anchor").alias("section_anchor"), "page_number"))
    bare = docs.join(children.select(key).distinct(), key, "left_anti").select(key, F.col(text).alias("text"))
    flat = semantic_chunks(bare, 400, 50).select(key, F.col("chunk_index").cast("int").alias("child_seq"), F.lit(None).cast("string").alias("parent_id"), "text", F.lit(None).cast("string").alias("section_path"), F.lit(None).cast("string").alias("section_anchor"), F.lit(1).alias("page_number"))
    own = children.groupBy("parent_id").agg(F.sort_array(F.collect_list("child_seq")).alias("child_chunk_indices"))
    parents = segments.select("parent_id", key, F.col("path").alias("section_path"), F.col("anchor").alias("section_anchor"), "text").join(own, "parent_id", "left")
    return children.unionByName(flat), parents.withColumn("child_chunk_indices", F.coalesce("child_chunk_indices", F.array().cast("array<int>")))


def prune_reference_chunks(children: DataFrame, parents: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Without children that look like references, numbered anew; parents with the new numbers, those without children go."""
    kept = children.where(~is_reference_like(F.col("text")))
    kept = kept.withColumn("child_seq", F.row_number().over(W.partitionBy(key).orderBy("child_seq")) - 1)
    own = kept.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.sort_array(F.collect_list("child_seq")).alias("child_chunk_indices"))
    return kept, parents.drop("child_chunk_indices").join(own, "parent_id")

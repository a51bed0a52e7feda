"""Title, authors, abstract and keywords from raw text, and the whole processing of parsed papers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clean_markdown, is_reference_like
from .chunking import semantic_chunks
from .hierarchy import hierarchical_chunks, markdown_metadata, prune_reference_chunks
from .layout import publication_date, reliable_title, route_documents, sanity_gate, top_terms

#: Metadata is looked for in so many first characters.
HEAD = 5000
# Words of notices and mastheads, of what no title, author or abstract holds.
NOTICE_WORDS = [
    "permission", "license", "copyright", "granted", "attribution", "provided", "rights reserved", "published by", "preprint", "arxiv", "proceedings", "conference",
    "journal of", "vol.", "pages ", "pp.", "©", "doi:", "issn", "ieee", "acm", "springer", "elsevier", "under review", "information 20", "editorial", "journal", "mdpi",
]
TITLE_NOISE = ["academiceditors", "received:", "accepted:", "published:", "citation:", "doi:", "keywords", "ourdailylives", "despitetheirawareness", "inthisarticle"]
AUTHOR_NOISE = ["open access", "citation", "article", "published", "license", "doi", "received", "accepted", "correspondence"]
ABSTRACT_ENDS = ["keywords", "index terms", "introduction", "1.", "i.", "citation:"]
ABSTRACT_FORMS = [r"(?is)Abstract[:\s]*\n?(.+?)(?:\n\n|Keywords|Introduction)", r"(?is)摘\s*要[：:\s]*(.+?)(?:\n\n|关键[词字]|引\s*言)"]
KEYWORD_FORMS = [r"(?is)Keywords?[:\s]+(.+?)(?:\n\n|\n[A-Z])", r"(?is)关键[词字][：:\s]+(.+?)(?:\n\n|\n\d)"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _held(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, p: a + F.contains(text, F.lit(p)).cast("int"), parts, F.lit(0))


def likely_title(text: Column) -> Column:
    """The rules that a candidate for a title must pass."""
    low, words = F.lower(text), F.size(F.split(text, " "))
    digits = F.regexp_count(text, F.lit(r"\d")) / F.greatest(F.length(text), F.lit(1))
    return (
        (_held(low, NOTICE_WORDS) < 2) & F.length(text).between(12, 200) & (digits <= 0.2) & (words <= 28) & ~((text == low) & (F.length(text) > 80))
        & ((words > 2) | text.rlike(r"[\x{4e00}-\x{9fff}]")) & (_held(F.replace(low, F.lit(" "), F.lit("")), TITLE_NOISE) == 0)
        & ~(text.endswith(".") & (words > 6)) & (F.regexp_count(text, F.lit(";")) < 2)
    )


def title_score(text: Column) -> Column:
    words = F.size(F.split(text, " "))
    score = F.least(F.length(text), F.lit(160)) / 40 + F.when(words.between(4, 24), 2.0).otherwise(0.0)
    score = score + F.when(text.rlike("[:-]"), 0.6).otherwise(0.0) + F.when(text.rlike("[A-Z][a-z]+"), 0.4).otherwise(0.0)
    return score - 1.5 * _held(F.lower(text), NOTICE_WORDS)


def extract_title(text: Column) -> Column:
    """The best candidate among marked titles and the first forty lines; the first of equals; null without any."""
    head = F.substring(text, 1, HEAD)
    marked = F.array(F.regexp_extract(head, r"^\s*([^\n]{12,220})\n", 1), F.regexp_extract(head, r"(?im)^title[:\s]+([^\n]{10,220})$", 1))
    lines = F.transform(F.concat(marked, F.slice(F.split(head, "\n"), 1, 40)), squeezed)
    fit = F.filter(lines, likely_title)
    ranked = F.transform(fit, lambda t, i: F.struct((-title_score(t)).alias("s"), i.alias("i"), t.alias("t")))
    return F.get(F.array_sort(ranked), 0)["t"]


def valid_author(name: Column) -> Column:
    tokens = F.split(name, " ")
    upper = F.exists(tokens, lambda t: t.rlike(r"^\p{Lu}"))
    return F.length(name).between(2, 60) & (_held(F.lower(name), AUTHOR_NOISE) == 0) & ~name.rlike(r"\d") & (F.regexp_count(name, F.lit(",")) <= 1) & (F.size(tokens) <= 6) & (~name.rlike("[A-Za-z]") | upper)


def extract_authors(text: Column) -> Column:
    """Distinct names in order, ten at most: after "Authors:" or "By", else of the first line with two to eight names."""
    head = F.regexp_replace(F.substring(text, 1, 1500), r"(?is)(?:\babstract\b|摘\s*要).*", "")
    parts = lambda line: F.filter(F.transform(F.split(line, r"[,;，；]|\sand\s"), squeezed), valid_author)
    named = F.flatten(F.transform(F.regexp_extract_all(head, F.lit(r"(?i)(?:Authors?|By)[:\s]+([^\n]+)"), 1), parts))
    lines = F.filter(F.slice(F.split(head, "\n"), 1, 25), lambda x: (squeezed(x) != "") & ~F.lower(x).rlike("abstract|citation|doi|keywords|introduction"))
    listed = F.filter(F.transform(lines, parts), lambda x: F.size(x).between(2, 8))
    found = F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.get(listed, 0), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(found), 1, 10)


def reliable_abstract(text: Column) -> Column:
    letters, blanks = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(" "))
    starved = ~text.rlike(r"[\x{4e00}-\x{9fff}]") & (letters > 200) & (blanks < F.greatest(F.lit(10), F.floor(letters * 0.02)))
    return F.coalesce((F.length(text) >= 60) & ~starved, F.lit(False))


def extract_abstract(text: Column) -> Column:
    """The abstract of the first form that gives a reliable one, cut before what follows it, 2000 characters at most."""
    found = []
    for form in ABSTRACT_FORMS:
        body = squeezed(F.regexp_extract(F.substring(text, 1, HEAD), form, 1))
        at = [F.instr(F.substring(F.lower(body), 82, 10**6), end) for end in ABSTRACT_ENDS]
        cut = F.least(*(F.when(a > 0, a + 80).otherwise(F.length(body)) for a in at))
        body = F.trim(F.substring(body, F.lit(1), cut))
        found.append(F.when(reliable_abstract(body), F.substring(body, 1, 2000)))
    return F.coalesce(*found)


def reliable_authors(names: Column) -> Column:
    """Whether half of the names, one at least, can be names."""
    n, good = F.size(names), F.size(F.filter(names, valid_author))
    return F.coalesce((n > 0) & (good >= F.greatest(F.lit(1), F.floor(n / 2))), F.lit(False))


def merge_metadata(rules: DataFrame, layout: DataFrame) -> DataFrame:
    """doc_id, title, authors, abstract, and layout's other columns, each field by its own reliability.

    Title: that of rules if it is reliable, else the layout's if that is, else the file
    name without its ending. Authors: the layout's where rules has no reliable ones.
    Abstract: the layout's where only that is reliable. Any other column (sections, …):
    that of rules if there is one that isn't null or empty, else the layout's. Fields
    that either side lacks come from the other; documents without layout keep their rules.
    """
    mine, theirs = set(rules.columns), set(layout.columns)
    df = rules.join(layout.select("doc_id", F.struct(*(c for c in layout.columns if c != "doc_id")).alias("__l")), "doc_id", "left")
    types = dict(rules.dtypes) | dict(layout.dtypes)
    ours = lambda c: F.col(c) if c in mine else F.lit(None).cast(types[c])
    found = lambda c: F.col("__l").getField(c) if c in theirs else F.lit(None).cast(types[c])
    sized = lambda x, c: F.size(x) > 0 if types[c].startswith(("array", "map")) else F.length(x) > 0 if types[c] == "string" else x.isNotNull()
    given = lambda x, c: F.coalesce(sized(x, c), F.lit(False))
    name = F.substring(F.regexp_replace(F.col("file_name"), r"\.[^.]*$", ""), 1, 500) if "file_name" in mine else F.lit(None).cast("string")
    out = {}
    for c in [*(c for c in ("title", "authors", "abstract") if c in mine | theirs), *(c for c in layout.columns if c not in ("doc_id", "title", "authors", "abstract"))]:
        a, b = ours(c), found(c)
        if c == "title":
            out[c] = F.when(reliable_title(a), a).when(reliable_title(b), b).otherwise(F.coalesce(name, a))
        elif c == "authors":
            out[c] = F.when(given(b, c) & ~reliable_authors(a), b).otherwise(a)
        elif c == "abstract":
            out[c] = F.when(~reliable_abstract(squeezed(a)) & reliable_abstract(squeezed(b)), b).otherwise(a)
        else:
            out[c] = F.when(given(a, c) | ~given(b, c), a).otherwise(b)
    return df.select("doc_id", *(v.alias(c) for c, v in out.items()))


def extract_keywords(text: Column) -> Column:
    """Distinct keywords of 2 to 49 characters, in order of the alphabet, twenty at most."""
    head = F.substring(text, 1, HEAD)
    parts = F.flatten(F.array(*(F.split(F.regexp_extract(head, f, 1), "[,;，；、]") for f in KEYWORD_FORMS)))
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x).between(2, 49)))), 1, 20)


def extract_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """df with title, authors, abstract and keywords of each text."""
    t = F.col(text)
    return df.withColumns({"title": extract_title(t), "authors": extract_authors(t), "abstract": extract_abstract(t), "keywords": extract_keywords(t)})


def reference_dominant(types: Column, text: Column) -> Column:
    """Whether a page's region types (and text, if few regions tell) say that it only lists references."""
    lowered = F.filter(F.transform(types, lambda t: F.lower(t)), lambda t: t != "")
    n = F.size(F.filter(lowered, lambda t: t == "reference"))
    other = F.exists(lowered, lambda t: t.isin("paragraph", "abstract", "section_header", "title"))
    listed = (n > 0) & is_reference_like(text) | (n >= F.greatest(F.lit(2), F.floor(F.size(lowered) * 0.6)))
    return F.coalesce((F.size(lowered) > 0) & (text != "") & ~other & listed, F.lit(False))


def _pages(parsed: DataFrame) -> DataFrame:
    """paper_id, page_number, text, n_images and skipped of each page."""
    fields = parsed.schema["pages"].dataType.elementType.names
    rows = parsed.select("paper_id", F.explode("pages").alias("p"))
    types = F.col("p.region_types") if "region_types" in fields else F.lit(None)
    text = F.coalesce(F.nullif(F.trim("p.text"), F.lit("")), F.trim("p.markdown"), F.lit(""))
    rows = rows.select("paper_id", "p.page_number", text.alias("text"), F.regexp_count(F.coalesce("p.markdown", F.lit("")), F.lit(r"!\[")).alias("n_images"), F.coalesce(types, F.array()).cast("array<string>").alias("types"))
    return rows.withColumn("skipped", reference_dominant(F.col("types"), F.col("text"))).drop("types")


def page_chunks(pages: DataFrame, size: int = 1024, overlap: int = 128) -> tuple[DataFrame, DataFrame]:
    """(kept, all) chunks of papers by page: pages of references are skipped, chunks that look like them go.

    A paper of which nothing is left is cut from its whole text, without page numbers.
    """
    whole = pages.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("text"))
    cut = lambda df: semantic_chunks(df, size, overlap).select("paper_id", "page_number", "chunk_index", "text", is_reference_like(F.col("text")).alias("listed"))
    by_page = cut(pages.where("NOT skipped AND text != ''").select("paper_id", "page_number", "text"))
    rest = whole.where("text != ''").join(by_page.where("NOT listed").select("paper_id").distinct(), "paper_id", "left_anti")
    every = by_page.unionByName(cut(rest.select("paper_id", F.lit(None).cast(dict(pages.dtypes)["page_number"]).alias("page_number"), "text")))
    nr = F.row_number().over(W.partitionBy("paper_id").orderBy("page_number", "chunk_index")) - 1
    return every.where("NOT listed").withColumn("child_seq", nr).drop("chunk_index", "listed"), every


def process_papers(parsed: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, children, parents) of parsed documents (paper_id, markdown, pages, metadata).

    papers: title, authors, abstract, keywords, date, issues, route, what the text holds, chunk_count, skipped_chunks,
    skipped_pages and status: failed without text, else completed. Documents without Markdown are cut page by page,
    others by sections. A document that fails leaves the others alone. keep: what is done with tables that more than one
    of the three results is made of (persisting them, if all three are written).
    """
    text, mark = F.lit(None).cast("string"), F.coalesce("markdown", F.lit(""))
    pages, cleaned = _pages(parsed), parsed.select("paper_id", clean_markdown(mark).alias("markdown"))
    df = parsed.select("paper_id", clean_markdown(mark).alias("markdown"), F.greatest(F.size("pages"), F.lit(1)).alias("n_pages"), F.element_at("metadata", F.lit("date")).alias("__date"), F.element_at("metadata", F.lit("file_name")).alias("__file"))
    by_page = pages.groupBy("paper_id").agg(F.count_if("skipped").alias("skipped_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("__pages"))
    df = df.join(by_page, "paper_id", "left").join(route_documents(pages.select(F.col("paper_id").alias("doc_id"), F.lit(1).alias("page"), F.length("text").alias("n_chars"), "n_images")).withColumnRenamed("doc_id", "paper_id"), "paper_id", "left")
    df = markdown_metadata(df).withColumn("__text", F.coalesce(F.nullif("markdown", F.lit("")), F.trim("__pages"), F.lit(""))).withColumn("__raw", extract_title(F.col("__text")))
    name = F.regexp_replace("__file", r"\.[^.]*$", "")
    title = F.when(reliable_title(F.col("title")), F.col("title")).when(reliable_title(F.col("__raw")), F.col("__raw")).otherwise(F.coalesce(name, "title"))
    whole = F.col("__text")
    df = df.withColumns({"title": title, "abstract": F.coalesce("abstract", extract_abstract(whole)), "published": publication_date(F.col("__date"), whole), "authors": extract_authors(whole), "keywords": extract_keywords(whole)})
    # keywords that aren't given come from the abstract
    lacking = df.where((F.size("keywords") == 0) & F.col("abstract").isNotNull()).select("paper_id", "abstract")
    found = top_terms(lacking).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("__terms"))
    df = keep(df.join(found, "paper_id", "left").withColumn("keywords", F.coalesce("__terms", "keywords")))
    children, parents = map(keep, hierarchical_chunks(cleaned.where(F.col("markdown") != "")))
    kept, owners = prune_reference_chunks(children, parents)
    bare = cleaned.where(F.col("markdown") == "").select("paper_id")
    flat, flat_all = map(keep, page_chunks(pages.join(bare, "paper_id", "left_semi")))
    none = {c: text for c in ("parent_id", "section_path", "section_anchor")}
    flat = flat.withColumns(none | {"page_number": F.col("page_number").cast(dict(kept.dtypes)["page_number"]), "child_seq": F.col("child_seq").cast(dict(kept.dtypes)["child_seq"])})
    kept = kept.unionByName(flat.select(kept.columns))
    count = lambda rows, c: rows.groupBy("paper_id").agg(F.count("*").alias(c))
    every = children.select("paper_id").unionAll(flat_all.select("paper_id"))
    out = sanity_gate(df, "__text", "n_pages").join(count(every, "all"), "paper_id", "left").join(count(kept, "chunk_count"), "paper_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    papers = out.select(
        "paper_id", "title", "authors", "abstract", "keywords", "published", "issues", "route", "n_pages", "has_tables", "has_formulas", "has_figures", F.size("section_titles").alias("section_count"),
        zero("chunk_count"), (F.coalesce("all", F.lit(0)) - F.coalesce("chunk_count", F.lit(0))).alias("skipped_chunks"), F.when(F.col("markdown") == "", F.col("skipped_pages")).otherwise(0).alias("skipped_pages"),
        F.when(F.col("__text") == "", "failed").otherwise("completed").alias("status"),
    )
    return papers.withColumn("skipped_pages", F.coalesce("skipped_pages", F.lit(0))), kept, owners

"""Lines, regions and pages of parsed documents; document metadata; quality gates; reference lists.

Rows are words, lines or regions of a page; windows run within one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import STOP_WORDS, letters_or_ideographs
from .chunking import _trim

PAGE = ["doc_id", "page"]
#: Types of regions that no page text holds.
DROPPED = ["reference", "header", "footer"]
# What no title holds.
TITLE_NOISE = ["keywords:", "citation:", "academic editors", "academiceditors", "received:", "accepted:", "doi:", "copyright", "in this article", "our daily lives", "despite", "whether"]
MATH = "∑∏∫∂∇≤≥±∞≈≠∈∉⊂⊃∩∪αβγδεζηθλμπσφψω"
# Forms of a publication date, with the number of date parts that each gives.
DATE_FORMS = [
    (r"(?i)(?:published|accepted|received|submitted)[:\s]+(\d{4})[.-/](\d{1,2})[.-/](\d{1,2})", 3),
    (r"(?i)(?:published|accepted|received|submitted)[:\s]+\d{1,2}\s+\w+\s+(\d{4})", 1),
    (r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})", 1),
    (r"(\d{4})\s*年", 1),
]


def words_to_lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line, text, x0, y0, x1 and y1 from words in reading order.

    A new line begins where the middle moves by more than half the height of the
    word before, or by ten units.
    """
    order = W.partitionBy(*PAGE).orderBy("ord")
    middle = (F.col("y0") + F.col("y1")) / 2
    moved = F.abs(middle - F.lag(middle).over(order)) > F.greatest(0.5 * F.lag(F.col("y1") - F.col("y0")).over(order), F.lit(10.0))
    rows = words.withColumn("__new", F.coalesce(moved.cast("int"), F.lit(0))).withColumn("line", F.sum("__new").over(order))
    lines = rows.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return lines.select(*PAGE, "line", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "x0", "y0", "x1", "y1")


def _line_starts(gap: float):
    """Of an Arrow column of lists of tops in order, for each the places where a line begins."""

    def starts(tops):
        import pyarrow as pa

        sizes, out = [0], []
        for page in tops.to_pylist():
            top = None
            for i, y in enumerate(page):
                if top is None or y is not None and not abs(y - top) <= gap:
                    out.append(i)
                    top = y
            sizes.append(len(out))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(out, pa.int32()))

    return starts


def anchored_lines(words: DataFrame, gap: float = 2.5) -> DataFrame:
    """doc_id, page, line, text, x0, y0, x1 and y1 from words of a page by their top, then their left side.

    A word belongs to a line as long as its top is within `gap` of that of the line's first word; blank words go. So a
    page that slants slowly is cut where it has moved by `gap` in all, however small each step is. Words move once, and a
    line is a slice of its page's words.
    """
    # words in the same place are put in the order of their number where they have one, else of their text
    word = F.struct("y0", "x0", (F.col("ord") if "ord" in words.columns else F.lit(0)).alias("nr"), F.trim("text").alias("text"), "x1", "y1")
    page = words.where(F.trim("text") != "").groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("w"))
    starts = F.arrow_udf(_line_starts(gap), "array<int>")(F.transform("w", lambda w: w["y0"].cast("double")))

    def line(start: Column, nr: Column) -> Column:
        own = F.slice("w", start + 1, F.coalesce(F.get("l", nr + 1), F.size("w")) - start)
        side = lambda c: F.transform(own, lambda w: w[c])
        text = F.regexp_replace(F.array_join(side("text"), " "), r"[ \t]+", " ")
        return F.struct(nr.alias("line"), text.alias("text"), *(f(side(c)).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))))

    lines = page.withColumn("l", starts).select(*PAGE, F.explode(F.transform("l", line)).alias("e"))
    return lines.select(*PAGE, "e.*")


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines with type and confidence; the first rule that fits counts."""
    t = F.trim("text")
    y, height, centre, first = F.col("y0"), F.col("y1") - F.col("y0"), (F.col("x0") + F.col("x1")) / 2, F.col("page") == 1
    n, dot = F.length(t), t.endswith(".")
    rules = [
        (y < 50, "header", 0.8), (y > 950, "footer", 0.8),
        (first & (y < 300) & (height > 20) & (centre > 200) & (centre < 800) & (n < 200) & ~dot, "title", 0.85),
        (first & (y > 150) & (y < 400) & t.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+") & (n < 300) & (height < 20), "author", 0.7),
        (t.rlike(r"^(Abstract|摘\s*要|ABSTRACT)"), "abstract", 0.95),
        (t.rlike(r"^(\d+\.?\s+|[IVX]+\.?\s+|第[一二三四五六七八九十]+[章节])") & (n < 100) & ~dot, "section_header", 0.85),
        ((F.upper(t) == t) & t.rlike(r"\p{Lu}") & (n < 80) & (n > 3), "section_header", 0.75),
        (t.rlike("^(Keywords?|关键[词字]|KEYWORDS)"), "other", 0.7),
        (t.rlike("^(References?|参考文献|REFERENCES|Bibliography)"), "reference", 0.9),
        (t.rlike(r"^\[\d+\]") | t.rlike(r"^\d+\.\s+[A-Z]"), "reference", 0.7),
        (t.rlike(r"(?i)^(Fig\.?|Figure|图)\s*\d") | t.rlike(r"(?i)^(Table|表)\s*\d"), "caption", 0.85),
        (t.rlike(r"^[-•*]\s") | t.rlike(r"^\([a-z]\)"), "list", 0.7),
        (F.regexp_count(t, F.lit(f"[{MATH}]")) > 3, "formula", 0.7),
    ]
    kind, sure = F.lit("paragraph"), F.lit(0.6)
    for test, name, confidence in reversed(rules):
        kind, sure = F.when(test, name).otherwise(kind), F.when(test, confidence).otherwise(sure)
    return lines.withColumns({"type": kind, "confidence": sure})


def page_text(regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page and text: regions in order without references, headers, footers and short unknown ones.

    Where that leaves less than max(80, a fifth of the raw text) the raw text stays. pages: (doc_id, page, raw); without
    them a page's raw text is that of all its regions in order, joined by blanks, and regions are grouped once.
    """
    keep = ~F.col("type").isin(DROPPED) & ~(F.col("type").isin("other", "unknown") & (F.length(F.trim("text")) < 25)) & (F.trim("text") != "")
    rows = regions.where(keep) if pages is not None else regions
    rows = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("order", "y0", "text", keep.alias("keep")))).alias("t"))
    built = F.array_join(F.transform(F.filter("t", lambda x: x["keep"]), lambda x: F.trim(x["text"])), "\n").alias("built")
    if pages is None:
        both = rows.select(*PAGE, built, F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("raw"))
    else:
        both = pages.join(rows.select(*PAGE, built), PAGE, "left")
    enough = F.length("built") >= F.greatest(F.lit(80), F.length("raw") / 5)
    return both.select(*PAGE, F.when(enough, F.col("built")).otherwise(F.col("raw")).alias("text"))


def reference_pages(regions: DataFrame) -> DataFrame:
    """doc_id, page and is_reference: whether references are half of the page's regions or more."""
    return regions.groupBy(*PAGE).agg((F.count_if(F.col("type") == "reference") >= 0.5 * F.count("*")).alias("is_reference"))


def layout_metadata(regions: DataFrame) -> DataFrame:
    """doc_id, title, authors, abstract (from the first page's regions) and sections (title:page, in order)."""
    text = lambda kind, only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("type") == kind) & only, F.struct("page", "order", "text")))), lambda x: x["text"]), " ")
    first = F.col("page") == 1
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "section_header", F.struct("page", "order", "text")))), lambda x: F.concat_ws(":", x["text"], x["page"]))
    out = regions.groupBy("doc_id").agg(text("title", first).alias("title"), text("author", first).alias("a"), text("abstract", first).alias("abstract"), heads.alias("sections"))
    names = F.filter(F.transform(F.split("a", r"[,;，；]|\sand\s"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    given = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return out.select("doc_id", given("title"), names.alias("authors"), given("abstract"), "sections")


def reliable_title(title: Column) -> Column:
    """Whether a string can be a paper's title."""
    t = F.trim(title)
    words = F.size(F.split(t, r"\s+"))
    noise = F.lower(t).rlike("|".join(x.replace(".", r"\.") for x in TITLE_NOISE))
    good = F.length(t).between(12, 260) & ~noise & (F.regexp_count(t, F.lit(";")) < 2) & ~(F.contains(t, F.lit(".")) & (words > 8)) & t.rlike(r"^[\p{Lu}\x{4e00}-\x{9fff}]") & (words > 2)
    return F.coalesce(good, F.lit(False))


def garble_share(text: Column) -> Column:
    """The share of characters that are neither ASCII nor letters, digits, marks, symbols, punctuation or blanks."""
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F\p{L}\p{N}\p{P}\p{S}\p{M}\p{Z}]", ""))
    return F.when(F.length(text) > 0, odd / F.length(text)).otherwise(0.0)


def sanity_gate(df: DataFrame, text: str = "text", pages: str = "pages") -> DataFrame:
    """df with garble, chars_per_page and issues; without issues a document passes."""
    per_page = F.length(text) / F.greatest(F.col(pages), F.lit(1))
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    df = df.withColumns({"garble": F.coalesce(garble_share(F.col(text)), F.lit(0.0)), "chars_per_page": F.coalesce(per_page, F.lit(0.0))})
    issues = F.when(empty, F.array(F.lit("sanity_empty_output"))).otherwise(F.array_compact(F.array(F.when(F.col("garble") > 0.15, "sanity_garble"), F.when(F.col("chars_per_page") < 100, "sanity_text_short"))))
    return df.withColumn("issues", issues)


def route_documents(page_stats: DataFrame) -> DataFrame:
    """doc_id and route from (doc_id, page, n_chars, n_images): scanned, images, multi_page or simple."""
    out = page_stats.groupBy("doc_id").agg(F.bool_and(F.col("n_chars") <= 50).alias("bare"), F.bool_or(F.col("n_images") > 0).alias("images"), F.count("*").alias("n"))
    return out.select("doc_id", F.when(F.col("bare"), "scanned").when(F.col("images"), "images").when(F.col("n") > 3, "multi_page").otherwise("simple").alias("route"))


def top_terms(df: DataFrame, n: int = 10, key: str = "paper_id", text: str = "abstract") -> DataFrame:
    """key, rank, term and count of the most frequent words of each text, stop words left out."""
    rows = df.select(key, F.explode(letters_or_ideographs(F.col(text), "6")).alias("term")).where(~F.col("term").isin(STOP_WORDS))
    counts = rows.groupBy(key, "term").count()
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col("count").desc(), "term"))).where(F.col("rank") <= n)


def publication_date(meta: Column, text: Column) -> Column:
    """The metadata's ISO date, else the first form found in the first 3000 characters; lone years 1990 to 2030 count from January."""
    head = F.substring(text, 1, 3000)
    found = [F.try_to_date(F.substring(meta, 1, 10), "yyyy-MM-dd")]
    for form, parts in DATE_FORMS:
        got = [F.regexp_extract(head, form, k) for k in range(1, parts + 1)]
        if parts == 3:
            found.append(F.try_to_date(F.when(got[0] != "", F.concat_ws("-", got[0], F.lpad(got[1], 2, "0"), F.lpad(got[2], 2, "0"))), "yyyy-MM-dd"))
        else:
            found.append(F.when(got[0].try_cast("int").between(1990, 2030), F.try_to_date(F.concat(got[0], F.lit("-01-01")), "yyyy-MM-dd")))
    return F.coalesce(*found)


def structure_score(df: DataFrame, text: str = "markdown") -> DataFrame:
    """df (markdown, pages, category) with score 0 to 100, headings, tables, formulas and garble."""
    t = F.col(text)
    heads = F.regexp_count(t, F.lit(r"(?md)^#{1,3}\s+.+$"))
    tables = F.regexp_count(t, F.lit(r"(?md)^\|(?:\s*:?-{3,}:?\s*\|)+$"))
    blocks = F.regexp_count(t, F.lit(r"(?s)\$\$.+?\$\$"))
    inline = F.regexp_count(t, F.lit(r"(?d)(?<!\$)\$(?!\$)(?!\s).+?(?<!\s)\$(?!\$)"))
    df = df.withColumns({"headings": heads, "tables": tables, "formulas": blocks + inline, "garble": garble_share(t), "__blocks": blocks, "__cpp": F.length(t) / F.greatest(F.col("pages"), F.lit(1))})
    step = lambda v, *marks: _step(v, marks)
    bonus = (
        F.when(F.col("category") == "formula_heavy", F.when(F.col("__blocks") >= 3, 20).when(F.col("formulas") > 0, 10).otherwise(0))
        .when(F.col("category") == "table_heavy", F.when(F.col("tables") >= 1, 20).otherwise(0))
        .when(F.col("category") == "dual_column", F.when((F.col("headings") >= 3) & (F.col("__cpp") >= 500), 20).when(F.col("headings") >= 2, 10).otherwise(0))
        .when(F.col("category") == "scan", F.when(F.col("__cpp") >= 200, 20).when(F.col("__cpp") >= 50, 10).otherwise(0))
        .otherwise(15)
    )
    garbled = F.when(F.col("garble") <= 0.05, 15).when(F.col("garble") <= 0.15, 8).otherwise(0)
    score = 20 + step(F.col("headings"), (2, 15), (1, 8)) + garbled + step(F.col("__cpp"), (300, 15), (100, 8)) + bonus
    empty = F.coalesce(_trim(t), F.lit("")) == ""
    return df.withColumn("score", F.when(empty, 0.0).otherwise(F.least(score, F.lit(100)).cast("double"))).drop("__blocks", "__cpp")


def _step(value: Column, marks: tuple) -> Column:
    out = F.lit(0)
    for least, points in reversed(marks):
        out = F.when(value >= least, points).otherwise(out)
    return out


def format_references(refs: DataFrame, style: str = "apa", by: list[str] | None = None) -> DataFrame:
    """refs with nr and formatted, numbered by ord within by; missing parts are left out with their marks.

    refs: ord, title, author, year, journal, volume, issue, pages, doi, url, key.
    """
    by = by or []
    df = refs.withColumn("nr", F.row_number().over(W.partitionBy(*(by or [F.lit(1)])).orderBy("ord")))
    text = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d))
    title, author, year = text("title", "Untitled"), text("author", "Unknown"), text("year", "n.d.")
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(after)), F.lit(""))
    journal = lambda before, after, *inner: F.when(text("journal", "") != "", F.concat(F.lit(before), F.col("journal"), F.lit(after), *inner, F.lit("."))).otherwise("")
    mark = F.concat(F.lit("["), F.col("nr"), F.lit("] "))
    forms = {
        "apa": [mark, author, F.lit(" ("), year, F.lit("). "), title, F.lit("."), journal(" *", "*", part(", *", "volume", "*"), part("(", "issue", ")"), part(", ", "pages")), part(" https://doi.org/", "doi")],
        "mla": [mark, author, F.lit('. "'), title, F.lit('."'), journal(" *", "*", part(", vol. ", "volume"), part(", no. ", "issue"), F.lit(", "), year, part(", pp. ", "pages")), part(" doi:", "doi", ".")],
        "chicago": [mark, author, F.lit(". "), year, F.lit('. "'), title, F.lit('."'), journal(" *", "*", part(" ", "volume"), part(", no. ", "issue"), part(": ", "pages")), part(" https://doi.org/", "doi", ".")],
        "gb_t_7714": [mark, author, F.lit(". "), title, F.lit("[J]."), journal(" ", "", F.lit(", "), year, part(", ", "volume"), part("(", "issue", ")"), part(": ", "pages")), part(" DOI: ", "doi", ".")],
        "bibtex": [
            F.lit("@article{"), F.coalesce("key", F.concat(F.lit("ref"), "nr")), F.lit(",\n  title = {"), title, F.lit("},\n  author = {"), author, F.lit("},\n  year = {"), year, F.lit("},\n"),
            *(part(f"  {name} = {{", c, "},\n") for name, c in (("journal", "journal"), ("volume", "volume"), ("number", "issue"), ("pages", "pages"), ("doi", "doi"), ("url", "url"))), F.lit("}"),
        ],
    }
    plain = [mark, author, F.lit(". "), title, F.lit(". "), text("journal", ""), F.lit(" ("), year, F.lit(")."), part(" DOI: ", "doi")]
    return df.withColumn("formatted", F.concat(*forms.get(style, plain)))

"""Readers of work records from four kinds of files, BibTeX, parsed documents and benches.

Every reader declares its schema, so no file is read twice; missing and null
values become nulls or zeros as stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPENALEX = """id string, title string, display_name string, abstract_inverted_index map<string,array<int>>, publication_year int, cited_by_count int, doi string,
    authorships array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<display_name:string>>>>,
    concepts array<struct<display_name:string,level:int,score:double>>, open_access struct<is_oa:boolean,oa_url:string>,
    primary_location struct<source:struct<display_name:string>,landing_page_url:string>"""
S2 = """paperId string, title string, abstract string, year int, citationCount int, referenceCount int, authors array<struct<authorId:string,name:string>>, venue string, url string,
    externalIds struct<DOI:string,ArXiv:string>, fieldsOfStudy array<string>, tldr struct<text:string>, isOpenAccess boolean"""
CROSSREF = """DOI string, title array<string>, author array<struct<given:string,family:string>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>,
    `container-title` array<string>, volume string, issue string, page string, publisher string, `is-referenced-by-count` int, `references-count` int, URL string, type string"""
ATOM = """id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>,
    link array<struct<_href:string,_title:string>>, `arxiv:doi` string, `arxiv:comment` string"""
PARSED = """paper_id bigint, project_id bigint, markdown string, pages array<struct<page_number:int,text:string,markdown:string,region_types:array<string>>>, metadata map<string,string>, parser_version string, elapsed_ms bigint"""


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def rebuilt_abstract(index: Column) -> Column:
    """The text of an inverted index {word: positions}: words in order of position, then of word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line. Values of an unexpected kind count as missing."""
    df = spark.read.schema(OPENALEX).json(path)
    authors = F.transform("authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"), a["author"]["id"].alias("id"), F.get(a["institutions"], 0)["display_name"].alias("institution")))
    concepts = F.transform("concepts", lambda c: F.struct(c["display_name"].alias("name"), c["level"].alias("level"), c["score"].alias("score")))
    return df.select(
        F.col("id").alias("external_id"), F.coalesce("title", "display_name").alias("title"), rebuilt_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").alias("year"),
        zero("cited_by_count").alias("citation_count"), F.coalesce(authors, F.array().cast("array<struct<name:string,id:string,institution:string>>")).alias("authors"),
        F.regexp_replace("doi", r"^https?://doi\.org/", "").alias("doi"), F.coalesce(concepts, F.array().cast("array<struct<name:string,level:int,score:double>>")).alias("concepts"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"), F.col("primary_location.source.display_name").alias("venue"), F.col("primary_location.landing_page_url").alias("url"),
    )


def read_s2(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(S2).json(path)
    return df.select(
        F.col("paperId").alias("external_id"), "title", "abstract", "year", zero("citationCount").alias("citation_count"), zero("referenceCount").alias("reference_count"),
        F.transform("authors", lambda a: F.struct(a["name"].alias("name"), a["authorId"].alias("id"), F.lit(None).cast("string").alias("institution"))).alias("authors"),
        "venue", "url", F.col("externalIds.DOI").alias("doi"), F.col("fieldsOfStudy").alias("fields"), F.col("tldr.text").alias("tldr"), F.coalesce("isOpenAccess", F.lit(False)).alias("is_open_access"),
    )


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(CROSSREF).json(path)
    names = F.filter(F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    year = lambda c: F.get(F.get(F.col(f"`{c}`.`date-parts`"), 0), 0)
    return df.select(
        F.col("DOI").alias("doi"), F.get("title", 0).alias("title"), F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("institution"))).alias("authors"),
        F.coalesce(year("published-print"), year("published-online")).alias("year"), F.get(F.col("`container-title`"), 0).alias("venue"), "volume", "issue", "page", "publisher",
        zero("is-referenced-by-count").alias("citation_count"), zero("references-count").alias("reference_count"), F.col("URL").alias("url"), "type",
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds in XML."""
    df = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "false").schema(ATOM).load(path)
    return df.select(
        F.regexp_extract("id", r"/abs/(.+)$", 1).alias("external_id"), squeezed(F.col("title")).alias("title"), squeezed(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: F.struct(a["name"].alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("institution"))).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"), F.get(F.filter("link", lambda x: x["_title"] == "pdf"), 0)["_href"].alias("pdf_url"),
        F.substring("published", 1, 10).alias("published"), F.substring("updated", 1, 10).alias("updated"), F.substring("published", 1, 4).cast("int").alias("year"), F.col("`arxiv:doi`").alias("doi"), F.col("`arxiv:comment`").alias("comment"),
    )


#: Bare words in values are put between these until their abbreviations are looked up.
_OPEN, _SHUT = "\x01", "\x02"
_ENTRY = "struct<type:string,key:string,fields:array<struct<n:string,v:string>>>"
_TOKENS = re.compile(r"(?s)\\.|[{}\"@,=#()]|[^\\{}\"@,=#()]+|\\")
#: A kind of entry so far; the last three end a line, so one of them may follow.
_KIND = re.compile(r"(?:[A-Za-z0-9_]+[ \t\n\x0b\f\r]*[\x85\u2028\u2029]?)?\Z")
_NUMBER = re.compile(r"[0-9]+[\x85\u2028\u2029]?\Z")
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
_UNMARKED = str.maketrans("", "", _OPEN + _SHUT)


def _parsed_entries(text: str) -> list[dict]:
    """The entries of a piece: one pass over its tokens that carries the depth of braces, in time by their length."""
    depth, quoted, round_, kind, key, name, value, fields, done = 0, False, False, "", None, None, [], [], []
    for x in _TOKENS.findall(text):
        if depth == 0:
            if x == "@":
                kind = ""
            elif x in "{(" and kind:
                depth, round_, key, name, fields = 1, x == "(", "" if kind.strip(" ").lower() == "string" else None, None, []
            elif kind is not None:  # None: whatever follows, this names no kind any more
                kind = kind + x if _KIND.match(kind + x) else None
            value = []
            continue
        if depth == 1 and x == '"':
            quoted = not quoted
        elif depth == 1 and not quoted:
            shut = x == (")" if round_ else "}")
            if shut or x == ",":
                if key is None:  # what stands before the first comma is the key; abbreviations have none
                    key = "".join(value).strip(" ").translate(_UNMARKED)
                if name is not None:
                    fields.append({"n": name, "v": "".join(value)})
                name, value = None, []
                if shut:
                    done.append({"type": kind.strip(" ").lower(), "key": key, "fields": fields})
                    depth, key, fields = 0, None, []
            elif x == "=" and name is None and key is not None:
                name, value = "".join(value).strip(" ").translate(_UNMARKED), []
            elif x == "{":
                depth = 2
            elif x != "#":
                word = _SPACES.sub(" ", x).strip(" ")
                value.append(word if not word or _NUMBER.match(word) else _OPEN + word + _SHUT)
        elif x == "{":
            value.append(x)
            depth += 1
        elif x == "}" and depth > 1:
            depth -= 1
            if depth > 1 or quoted:
                value.append(x)
        else:
            value.append(x)
    return done


def _entries_of(texts):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("type", pa.string()), ("key", pa.string()), ("fields", pa.list_(pa.struct([("n", pa.string()), ("v", pa.string())])))]))
    return pa.array([None if x is None else _parsed_entries(x) for x in texts.to_pylist()], kind)


def bibtex_entries(text: Column) -> Column:
    """The entries of a piece of BibTeX as an array of (type, key, fields), read in Arrow batches.

    Entries begin at an @ outside of all braces and end where the depth is back at 0, wherever that is in a line. Values
    are in braces (of any depth), quotes, or bare, and # joins them; escaped braces and quotes are plain characters.
    An entry that never ends is left out.
    """
    found = F.arrow_udf(_entries_of, f"array<{_ENTRY}>")(text)
    return F.transform(found, lambda e: F.struct(e["type"].alias("type"), e["key"].alias("key"), F.transform(e["fields"], lambda f: F.struct(F.lower(f["n"]).alias("n"), f["v"].alias("v"))).alias("fields")))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """entry_type, key and fields (lower-case names) of the entries of BibTeX files; of repeated fields the last counts.

    Files are cut before each @ at the beginning of a line, which begins an entry whatever went before, so that large
    files are read in pieces and an entry without its end takes no other along. Abbreviations (@string) hold in their
    file, those of months everywhere; @comment and @preamble are no entries.
    """
    pieces = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.when(F.col("value").startswith("@"), F.col("value")).otherwise(F.concat(F.lit("@"), "value")).alias("value"))
    found = pieces.select("file", F.explode(bibtex_entries(F.col("value"))).alias("e")).select("file", "e.*")
    short = found.where("type = 'string'").select("file", F.explode("fields").alias("f")).groupBy("file", F.col("f.n").alias("n")).agg(F.max("f.v").alias("v"))
    months = {m[:3].lower(): m for m in "January February March April May June July August September October November December".split()}
    named = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    words = F.lit(rf"{_OPEN}([^{_SHUT}]*){_SHUT}")
    bare = F.transform(F.flatten(F.transform("fields", lambda f: F.regexp_extract_all(f["v"], words, 1))), F.lower)
    df = found.where("NOT type IN ('string', 'comment', 'preamble') AND key != ''").withColumn("__w", F.array_distinct(F.filter(bare, lambda w: ~w.isin(*months))))
    # entries with other words than months meet what their own words stand for, never all abbreviations of the file
    asked = df.where(F.size("__w") > 0)
    own = asked.select("file", "__w").distinct().select("file", "__w", F.explode("__w").alias("n")).join(short, ["file", "n"])
    own = own.groupBy("file", "__w").agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("__known"))
    df = asked.join(own, ["file", "__w"], "left").unionByName(df.where(F.size("__w") == 0), allowMissingColumns=True)
    meaning = lambda w: F.coalesce(F.element_at(named, F.lower(w)), F.element_at("__known", F.lower(w)), w)
    filled = lambda v: F.aggregate(F.array_distinct(F.regexp_extract_all(v, words, 1)), v, lambda t, w: F.replace(t, F.concat(F.lit(_OPEN), w, F.lit(_SHUT)), meaning(w)))
    pairs = F.transform("fields", lambda f: F.struct(f["n"].alias("n"), squeezed(F.translate(filled(f["v"]), _OPEN + _SHUT, "")).alias("v")))
    df = df.withColumn("__p", pairs)
    last = F.filter("__p", lambda p, i: ~F.exists(F.slice("__p", i + 2, F.size("__p")), lambda q: q["n"] == p["n"]))
    df = df.withColumn("fields", F.map_from_entries(last))
    at = lambda c: F.element_at("fields", F.lit(c)).alias(c)
    return df.select(F.col("type").alias("entry_type"), "key", at("title"), at("author"), at("year"), at("journal"), at("doi"), at("abstract"), "fields")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON object a line; without pages they have none."""
    df = spark.read.schema(PARSED).json(path)
    return df.withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string,markdown:string,region_types:array<string>>>")))


def content_to_pages(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc_id, page and markdown from (doc_id, ord, page, type, text, level, body); pages without items are empty.

    Negative pages count as the first; headers, footers and page numbers go.
    """
    kind = F.col("type")
    md = (
        F.when(kind.isin("header", "footer", "page_number"), None)
        .when(kind == "table", F.coalesce("body", "text"))
        .when(kind == "list", F.concat(F.lit("- "), "text"))
        .when(kind == "title", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(3))), F.lit(" "), "text"))
        .when(kind == "equation", F.concat(F.lit("$$\n"), "text", F.lit("\n$$")))
        .otherwise(F.col("text"))
    )
    rows = items.withColumns({"md": md, "page": F.greatest("page", F.lit(0)).cast("int")}).where(F.trim("md") != "")
    text = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "md"))).alias("x")).select("doc_id", "page", F.array_join(F.transform("x", lambda r: r["md"]), "\n\n").alias("markdown"))
    spine = page_counts.where("pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("pages") - 1).cast("int"))).alias("page"))
    return spine.join(text, ["doc_id", "page"], "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


def tables_to_records(tables: DataFrame) -> DataFrame:
    """table_id, records (maps by the first row's cells), rows and columns of (table_id, cells); rows of other widths go."""
    head = F.get("cells", 0)
    same = F.filter(F.slice("cells", 2, F.size("cells")), lambda r: F.size(r) == F.size(head))
    # of repeated headers the last cell counts
    last = lambda r: F.filter(F.arrays_zip(head.alias("h"), r.alias("v")), lambda p, i: ~F.array_contains(F.slice(head, i + 2, F.size(head)), p["h"]))
    out = tables.where(F.size("cells") > 0).withColumn("__r", same)
    return out.select("table_id", F.transform("__r", lambda r: F.map_from_entries(last(r))).alias("records"), F.size("__r").alias("rows"), F.size(head).alias("columns"))


def read_bench(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Items of a retrieval, answer or parse bench; a retrieval bench's paper keys become their names in its index."""
    item = {
        "retrieval": "id string, query string, category string, relevant_papers array<string>, relevant_keywords array<string>, difficulty string",
        "answer": "id string, category string, question string, related_papers array<string>, expected_answer_points array<string>, difficulty string, eval_focus array<string>",
        "parse": "id string, pdf_filename string, category string, language string, expected struct<title:string,has_abstract:boolean,abstract_min_length:int,section_count_approx:int,has_tables:boolean,has_formulas:boolean,has_figures:boolean,page_count_approx:int,known_sections:array<string>>",
    }[kind]
    fields = item if kind != "parse" else item
    schema = f"version string, paper_index map<string,string>, items array<struct<{', '.join(_typed(fields))}>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = df.select("paper_index", F.explode("items").alias("i"))
    if kind == "retrieval":
        return rows.select("i.*", F.transform("i.relevant_papers", lambda p: F.coalesce(F.element_at("paper_index", p), p)).alias("papers"))
    return rows.select("i.*")


def _typed(fields: str) -> list[str]:
    """"a string, b struct<…>" as ["a:string", "b:struct<…>"]; commas inside brackets separate nothing."""
    out, depth, now = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip().replace(" ", ":", 1))
            now = ""
        else:
            now += c
    return [*out, now.strip().replace(" ", ":", 1)]

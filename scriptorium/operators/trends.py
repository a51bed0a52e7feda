"""Keyword trends and co-occurrence over tables of papers.

Keyword tables are small next to the papers they come from: every operator first
counts by keyword (and year or project) with partial aggregation, and ranks
afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import STOP_WORDS, letters_or_ideographs

#: Groups with keywords that are sent to the abstracts at most.
MOST_GROUPS = 20_000


def keyword_list(df: DataFrame, column: str = "keywords") -> Column:
    """An array of keywords from an array or from a delimited string."""
    return F.split(column, "[,;，；]") if dict(df.dtypes)[column] == "string" else F.col(column)


def top_rows(df: DataFrame, by: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first rows of each group by order, with their rank from 1; without groups by a distributed top-k."""
    if by:
        return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= limit)
    return df.orderBy(*order).limit(limit).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def exploded_keywords(papers: DataFrame, keep: list[str]) -> DataFrame:
    """One row a counted keyword: trimmed, lower case, no stop word, two characters or more."""
    key = F.lower(F.trim(F.col("keyword")))
    rows = papers.select(*keep, F.explode(keyword_list(papers)).alias("keyword")).withColumn("keyword", key)
    return rows.where((F.length("keyword") > 1) & ~F.col("keyword").isin(STOP_WORDS))


def abstract_terms(papers: DataFrame, keep: list[str]) -> DataFrame:
    rows = papers.where(F.col("abstract").isNotNull()).select(*keep, F.explode(letters_or_ideographs(F.col("abstract"), "6")).alias("keyword"))
    return rows.where(~F.col("keyword").isin(STOP_WORDS))


def keyword_counts(papers: DataFrame, by: list[str]) -> DataFrame:
    """by, keyword and count; a group without any keyword counts the words of its abstracts.

    Abstracts stay where they are: up to MOST_GROUPS groups with keywords are sent to them; beyond that the words of all
    abstracts are counted and the counts of these groups go.
    """
    counts = exploded_keywords(papers, by).groupBy(*by, "keyword").count()
    if "abstract" not in papers.columns:
        return counts
    if by:
        covered = exploded_keywords(papers, by).select(*by).distinct()
        few = covered.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
        bare = papers.join(F.broadcast(covered), by, "left_anti") if few else papers
        words = abstract_terms(bare, by).groupBy(*by, "keyword").count()
        return counts.unionByName(words if few else words.join(covered, by, "left_anti"))
    bare = papers.where(counts.agg(F.count("*")).scalar() == 0)
    return counts.unionByName(abstract_terms(bare, by).groupBy(*by, "keyword").count())


def keyword_frequency(papers: DataFrame, by: list[str] | None = None, limit: int = 50) -> DataFrame:
    """by, keyword, count and percentage of all counts of the group: the `limit` most frequent."""
    by = by or []
    counts = keyword_counts(papers, by)
    totals = counts.groupBy(*by).agg(F.sum("count").alias("__total"))
    top = top_rows(counts, by, [F.col("count").desc(), F.col("keyword")], limit)
    top = top.join(totals, by) if by else top.withColumn("__total", totals.select("__total").scalar())
    return top.select(*by, "rank", "keyword", "count", (F.col("count") / F.col("__total") * 100).alias("percentage"))


def tfidf_terms(papers: DataFrame, limit: int = 50) -> DataFrame:
    """keyword, count and tfidf = count * ln(abstracts / texts with it + 1) of the abstracts' words."""
    texts = papers.where(F.col("abstract").isNotNull())
    each = texts.select("paper_id", F.explode(letters_or_ideographs(F.col("abstract"))).alias("keyword")).where(~F.col("keyword").isin(STOP_WORDS))
    per_text = each.groupBy("keyword", "paper_id").count()
    terms = per_text.groupBy("keyword").agg(F.sum("count").alias("count"), F.count("*").alias("df"))
    terms = terms.withColumn("tfidf", F.col("count") * F.log(texts.agg(F.count("*")).scalar() / F.col("df") + 1))
    return top_rows(terms, [], [F.col("tfidf").desc(), F.col("keyword")], limit)


def with_year(papers: DataFrame) -> DataFrame:
    at = F.coalesce("publication_date", F.to_date("created_at")) if "created_at" in papers.columns else F.col("publication_date")
    return papers.withColumn("year", F.year(at))


def year_keywords(papers: DataFrame, by: list[str] | None = None, top: int = 10) -> DataFrame:
    """by, year, rank, keyword and count: the most frequent keywords of each year, stop words included."""
    by = [*(by or []), "year"]
    rows = with_year(papers).where(F.col("year").isNotNull())
    rows = rows.select(*by, F.explode(keyword_list(papers)).alias("keyword")).withColumn("keyword", F.lower(F.trim("keyword"))).where(F.length("keyword") > 0)
    counts = rows.groupBy(*by, "keyword").count()
    return top_rows(counts, by, [F.col("count").desc(), F.col("keyword")], top)


def timeline(papers: DataFrame) -> DataFrame:
    """year, papers and top_keywords (an array of keyword and count, in order)."""
    years = with_year(papers).where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("papers"))
    tops = year_keywords(papers).groupBy("year").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "count"))).alias("t"))
    tops = tops.select("year", F.transform("t", lambda x: F.struct(x["keyword"].alias("keyword"), x["count"].alias("count"))).alias("top_keywords"))
    return years.join(tops, "year", "left")


def hotspots(papers: DataFrame, limit: int = 20, among: int = 100) -> DataFrame:
    """keyword, count and hotness: counts by the largest of them."""
    top = keyword_frequency(papers, limit=among)
    return top.withColumn("hotness", F.col("count") / F.max("count").over(W.partitionBy(F.lit(1)))).where(F.col("rank") <= limit).select("rank", "keyword", "count", "hotness")


def burst_terms(papers: DataFrame, min_frequency: int = 2, limit: int = 30) -> DataFrame:
    """keyword, start_year, end_year and strength of runs of years with more than 1.5 times the mean count.

    Counts are those of each year's ten most frequent keywords; years are those
    with papers. Fewer than two years have no bursts.
    """
    years = with_year(papers).where(F.col("year").isNotNull()).select("year").distinct()
    years = years.withColumn("nr", F.row_number().over(W.orderBy("year")))  # one row a year
    years = years.withColumn("next_year", F.lead("year").over(W.orderBy("year"))).withColumn("n", F.count("*").over(W.partitionBy(F.lit(1))))
    found = year_keywords(papers).select("year", "keyword", "count").join(F.broadcast(years), "year")
    own = W.partitionBy("keyword")
    found = found.withColumn("total", F.sum("count").over(own)).where((F.col("total") >= min_frequency) & (F.col("n") >= 2)).withColumn("mean", F.col("total") / F.col("n"))
    hot = found.where(F.col("count") > 1.5 * F.col("mean"))
    hot = hot.withColumn("island", F.col("nr") - F.row_number().over(W.partitionBy("keyword").orderBy("nr")))
    hot = hot.withColumn("strength", F.col("count") / F.greatest(F.col("mean"), F.lit(0.1)))
    runs = hot.groupBy("keyword", "island").agg(F.min("year").alias("start_year"), F.max_by("next_year", "nr").alias("after"), F.max("year").alias("last"), F.max("strength").alias("strength"))
    runs = runs.select("keyword", "start_year", F.when(F.col("after").isNull(), F.col("last")).otherwise(F.col("after") - 1).alias("end_year"), "strength")
    return top_rows(runs, [], [F.col("strength").desc(), F.col("keyword"), F.col("start_year")], limit)


def field_distribution(papers: DataFrame, limit: int = 50) -> DataFrame:
    """rank, keyword, count, cumulative share of the counts, and category: core, hot, general or fringe."""
    top = keyword_frequency(papers, limit=limit)  # at most `limit` rows from here on
    running = F.sum("count").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) / F.sum("count").over(W.partitionBy(F.lit(1)))
    kind = F.when(F.col("cumulative") <= 0.3, "core").when(F.col("cumulative") <= 0.6, "hot").when(F.col("cumulative") <= 0.85, "general").otherwise("fringe")
    return top.withColumn("cumulative", running).withColumn("category", kind).select("rank", "keyword", "count", "cumulative", "category")


def category_totals(distribution: DataFrame) -> DataFrame:
    return distribution.groupBy("category").agg(F.sum("count").alias("count"), F.count("*").alias("keywords"))


def keyword_evolution(papers: DataFrame, keywords: int = 8, top: int = 5) -> DataFrame:
    """year, keyword and count (0 if missing) for the first distinct keywords among each year's top ones."""
    years = year_keywords(papers)
    first = years.where(F.col("rank") <= top).groupBy("keyword").agg(F.min(F.struct("year", "rank")).alias("at"))
    chosen = top_rows(first, [], [F.col("at"), F.col("keyword")], keywords, "nr").select("keyword")
    grid = years.select("year").distinct().crossJoin(F.broadcast(chosen))  # years by at most `keywords`
    return grid.join(years, ["year", "keyword"], "left").select("year", "keyword", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def scale_weights(frequency: DataFrame, n: int = 40) -> DataFrame:
    """rank, keyword, count and weight: counts of the first n between 0 and 1."""
    top = frequency.where(F.col("rank") <= n)
    whole = W.partitionBy(F.lit(1))
    low, high = F.min("count").over(whole), F.max("count").over(whole)
    return top.select("rank", "keyword", "count", ((F.col("count") - low) / F.when(high == low, F.lit(1)).otherwise(high - low)).alias("weight"))


def trending_concepts(works: DataFrame, field: str | None = None, limit: int = 20) -> DataFrame:
    """concept, works and citations of the concepts with most works; field: only those whose name holds it."""
    rows = works.select("citation_count", F.explode("concepts").alias("concept"))
    if field:
        rows = rows.where(F.contains(F.lower("concept"), F.lit(field.lower())))
    counts = rows.groupBy("concept").agg(F.count("*").alias("works"), F.sum("citation_count").alias("citations"))
    return top_rows(counts, [], [F.col("works").desc(), F.col("concept")], limit)


# Words that are no entities, parts that no entity holds, and the forms of entities.
NO_ENTITIES = [
    "The", "This", "That", "These", "Those", "With", "From", "However", "Although", "Because", "Table", "Figure", "Section", "Chapter", "Abstract",
    "Introduction", "Conclusion", "References", "Page", "的", "了", "是", "在", "有", "和", "与", "及", "或", "等", "对", "为", "从", "到", "中", "上", "下", "也", "但",
    "并", "这个", "那个", "一个", "我们", "他们", "可以", "已经", "进行", "使用", "通过", "其中", "以及", "由于", "因此", "然而",
]
NOISE_ENTITIES = [
    "however", "moreover", "nevertheless", "forexample", "example", "information", "keywords", "academiceditors", "citation", "results", "discussion",
    "method", "methods",
]
NOISE_PARTS = "http|www|doi|figure|table|page"
ENTITY_FORMS = [r"(?U)\b[A-Z][A-Za-z]*(?:-[A-Za-z]+)*(?:\s+[A-Z][A-Za-z]*)*\b", r"(?U)\b[A-Z]{2,}(?:-\d+)?\b", r"[\x{4e00}-\x{9fff}]{2,8}"]


def is_entity(entity: Column) -> Column:
    plain = F.replace(F.lower(entity), F.lit(" "), F.lit(""))
    latin = entity.rlike("[A-Za-z]")
    proper = (F.size(F.split(entity, " ")) <= 8) & (entity.rlike(r"\b[A-Z]{2,}\b") | entity.rlike(r"(?:^| )\p{Lu}"))
    return F.length(entity).between(2, 80) & ~entity.isin(NO_ENTITIES) & ~plain.isin(NOISE_ENTITIES) & ~plain.rlike(NOISE_PARTS) & ~entity.rlike(r"(?U)^[0-9\W_]+$") & (~latin | proper)


def extract_entities(texts: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    """by, rank, entity and count: capitalised phrases, acronyms and runs of ideographs, the k most frequent."""
    by = by or []
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), 0) for p in ENTITY_FORMS))
    rows = texts.select(*by, F.explode(found).alias("entity")).withColumn("entity", F.trim(F.regexp_replace("entity", r"\s+", " ")))
    rows = rows.where(is_entity(F.col("entity")))
    return top_rows(rows.groupBy(*by, "entity").count(), by, [F.col("count").desc(), F.col("entity")], k)


def cooccurrence_edges(texts: DataFrame, entities: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    """by, source, target (in order) and weight: sentences that hold both; the max(3k, 20) heaviest.

    A group has at most k entities, which are sent to its sentences as one array.
    """
    by = by or []
    names = entities.groupBy(*by).agg(F.sort_array(F.collect_set("entity")).alias("names"))
    sentences = texts.select(*by, F.explode(F.split("text", r"[.!?。！？\n]+")).alias("sentence")).where(F.trim("sentence") != "")
    joined = sentences.join(names, by) if by else sentences.withColumn("names", names.scalar())
    present = joined.select(*by, F.filter("names", lambda x: F.contains(F.col("sentence"), x)).alias("p")).where(F.size("p") >= 2)
    # pairs of at most k entities of one sentence
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    counts = present.select(*by, F.explode(pairs).alias("e")).groupBy(*by, "e.source", "e.target").agg(F.count("*").alias("weight"))
    return top_rows(counts, by, [F.col("weight").desc(), F.col("source"), F.col("target")], max(3 * k, 20))


def valid_edges(nodes: DataFrame, edges: DataFrame, node: str = "entity") -> DataFrame:
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    return edges.join(ids, edges["source"] == ids["__id"], "left_semi").join(ids, edges["target"] == ids["__id"], "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, degree and neighbours (sorted) of undirected edges."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("neighbours")).withColumn("degree", F.size("neighbours"))


def project_text(papers: DataFrame, chunks: DataFrame, per_paper: int = 10, per_project: int = 30, chars: int = 8000) -> DataFrame:
    """project_id and text: the first chunks of completed papers, within the limits, one after another."""
    done = papers.where(F.col("status") == "completed").select("paper_id", "project_id")
    rows = chunks.where(F.col("chunk_index") < per_paper).join(done, "paper_id").select("project_id", "paper_id", "chunk_index", "text")
    rows = top_rows(rows, ["project_id"], [F.col("paper_id"), F.col("chunk_index")], per_project, "nr")
    texts = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("nr", "text"))).alias("t"))
    return texts.select("project_id", F.substring(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), 1, chars).alias("text"))


def project_graph(papers: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """project_id, nodes, edges and message: sizes of each project's entity graph."""
    texts = project_text(papers, chunks)
    nodes = extract_entities(texts, ["project_id"], k)
    edges = cooccurrence_edges(texts, nodes, ["project_id"], k)
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = papers.select("project_id").distinct().join(texts.withColumn("__t", F.lit(True)).drop("text"), "project_id", "left")
    out = out.join(count(nodes, "nodes"), "project_id", "left").join(count(edges, "edges"), "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("project_id", zero("nodes"), zero("edges"), F.when(F.col("__t").isNull(), "no text").alias("message"))

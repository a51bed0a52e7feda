"""Metrics of retrieval, answers, parsing and latency, and comparison of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut_lineage

#: Bins that a range of values is counted by, rows that are sorted at once, and ranges that are broadcast at most.
BINS, FEW, MOST_RANGES = 4096, 10_000, 20_000
# Which metrics are compared how, with the share by which latency may rise.
HIGHER_BETTER = [
    "avg_recall_at_10", "avg_recall_at_20", "avg_ndcg_at_10", "avg_keyword_hit_rate", "avg_coverage_ratio", "avg_consistency_ratio",
    "avg_structure_completeness", "avg_parse_score",
]
LOWER_BETTER = {"retrieval_p95": 0.20, "answer_p95": 0.20, "latency_p95": 0.20}
# Headings of a structured answer.
HEADINGS = [r"##\s*结论", r"##\s*依据[与和]分析", r"##\s*局限[与和]?不确定性", r"##\s*参考来源"]


def recall_at_k(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id and recall: distinct relevant papers in the first k by all relevant ones; 1 without any."""
    truth = qrels.select("query_id", "paper_id").distinct()
    got = run.where(F.col("rank") <= k).select("query_id", "paper_id").distinct().withColumn("__hit", F.lit(1))
    per = truth.join(got, ["query_id", "paper_id"], "left").groupBy("query_id").agg((F.count("__hit") / F.count("*")).alias("recall"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


def ndcg_at_k(queries: DataFrame, run: DataFrame, qrels: DataFrame, k: int = 10, dedupe: bool = False) -> DataFrame:
    """query_id and ndcg with gains 1 / log2(rank + 1); dedupe: a paper gains at its first rank only."""
    truth = qrels.select("query_id", "paper_id").distinct()
    top = run.where(F.col("rank") <= k)
    if dedupe:
        top = top.groupBy("query_id", "paper_id").agg(F.min("rank").alias("rank"))
    gains = top.join(truth, ["query_id", "paper_id"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    best = truth.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("ideal", ideal)
    df = queries.select("query_id").join(best, "query_id", "left").join(gains, "query_id", "left")
    return df.select("query_id", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def keyword_hit_rate(hits: DataFrame, keywords: DataFrame, k: int = 10) -> DataFrame:
    """query_id and rate: keywords (an array) that some text of the first k holds, whatever the case; 1 without keywords."""
    texts = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t")))).alias("x"))
    texts = texts.select("query_id", F.array_join(F.transform("x", lambda r: r["t"]), " ").alias("all"))
    df = keywords.join(texts, "query_id", "left")
    found = F.size(F.filter("keywords", lambda w: F.contains(F.coalesce("all", F.lit("")), F.lower(w))))
    return df.select("query_id", F.when(F.size("keywords") > 0, found / F.size("keywords")).otherwise(1.0).alias("rate"))


def citation_consistency(answers: DataFrame) -> DataFrame:
    """answer_id, total, valid and ratio of citations [n] with 1 <= n <= evidence_count; 1 without citations."""
    found = F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1)
    df = answers.withColumn("__c", F.transform(found, lambda x: x.cast("decimal(38,0)")))
    valid = F.size(F.filter("__c", lambda c: (c >= 1) & (c <= F.col("evidence_count"))))
    return df.select("answer_id", F.size("__c").cast("long").alias("total"), valid.cast("long").alias("valid"), F.when(F.size("__c") > 0, valid / F.size("__c")).otherwise(1.0).alias("ratio"))


def answer_coverage(answers: DataFrame) -> DataFrame:
    """answer_id, points, covered and ratio: a point is covered if a part of it (split at , ; /) occurs; 1 without points."""
    low = F.lower("text")
    parts = lambda p: F.filter(F.transform(F.split(p, "[,;，；/]"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    covered = F.size(F.filter("points", lambda p: F.exists(parts(p), lambda t: F.contains(low, t))))
    return answers.select("answer_id", F.size("points").cast("long").alias("points"), covered.cast("long").alias("covered"), F.when(F.size("points") > 0, covered / F.size("points")).otherwise(1.0).alias("ratio"))


def structured_output(answers: DataFrame) -> DataFrame:
    """answer_id and completeness: the share of the four headings that the answer has."""
    return answers.select("answer_id", (sum((F.col("text").rlike(h).cast("int") for h in HEADINGS[1:]), F.col("text").rlike(HEADINGS[0]).cast("int")) / 4).alias("completeness"))


def parse_quality(pairs: DataFrame) -> DataFrame:
    """doc_id, score and items: the mean of what parsed and expected (structs) allow to compare."""
    p, e = lambda c: F.col(f"parsed.{c}"), lambda c: F.col(f"expected.{c}")
    got, want = F.lower(F.trim(F.coalesce(p("title"), F.lit("")))), F.lower(F.trim(F.coalesce(e("title"), F.lit(""))))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(got), words(want))) / F.greatest(F.size(words(got)), F.size(words(want)), F.lit(1))
    title = F.when(want != "", (F.contains(got, want) | F.contains(want, got) | (shared >= 0.6)).cast("double"))
    abstract = F.coalesce(p("abstract"), F.lit(""))
    has = F.when(e("has_abstract").isNotNull(), ((abstract != "") == e("has_abstract")).cast("double"))
    length = F.when(e("abstract_min_length") > 0, F.least(F.length(abstract) / e("abstract_min_length"), F.lit(1.0)))
    near = lambda a, b: F.when(b.isNotNull(), F.greatest(1 - F.abs(F.coalesce(a, F.lit(0)) - b) / F.greatest(b, F.lit(1)), F.lit(0.0)))
    names = F.transform(p("section_names"), F.lower)
    hits = F.size(F.filter(e("known_sections"), lambda s: F.exists(names, lambda n: F.contains(n, F.lower(s)) | F.contains(F.lower(s), n))))
    known = F.when((F.size(e("known_sections")) > 0) & p("section_names").isNotNull(), hits / F.size(e("known_sections")))
    flags = [F.when(e(c).isNotNull() & p(c).isNotNull(), (e(c) == p(c)).cast("double")) for c in ("has_tables", "has_formulas", "has_figures")]
    scores = F.filter(F.array(title, has, length, near(F.size(p("section_names")), e("section_count_approx")), known, near(p("page_count"), e("page_count_approx")), *flags), lambda x: x.isNotNull())
    df = pairs.withColumn("__s", scores)
    return df.select("doc_id", F.when(F.size("__s") > 0, F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / F.size("__s")).otherwise(0.0).alias("score"), F.size("__s").cast("long").alias("items"))


def exact_ranks(values: DataFrame, wanted: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(g, rank, value): the value of each wanted (g, rank), ranks counted from 1, among the finite values of its group (g, value).

    No group is gathered or sorted as a whole. Counts by bins of a group's range tell which bin holds a rank; that
    bin's own range is counted next, until it has one value or at most `few` rows, which are sorted. A bin is never its
    whole range, so each round leaves less; counts are combined on the map side. wanted: a few ranks a group.
    """
    values = values.select("g", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    ends = values.groupBy("g").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    open_ = cut_lineage(wanted.join(ends, "g").select("g", "rank", F.lit(0).cast("long").alias("below"), "low", "high", "n"))
    done = []
    while open_.limit(1).count():
        settled = (F.col("low") == F.col("high")) | (F.col("n") <= few)
        done.append(open_.where(settled))
        rest = open_.where(~settled)
        ranges = rest.select("g", "low", "high").distinct()
        met = _sized(values, ranges, "g").where(F.col("value").between(F.col("low"), F.col("high")))
        share = F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)  # halves don't overflow
        inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
        place = F.when(F.col("value") == F.col("low"), 0).when(F.col("value") == F.col("high"), bins - 1).otherwise(inner)
        counts = met.groupBy("g", "low", "high", place.alias("bin")).agg(F.count("*").alias("m"), F.min("value").alias("l"), F.max("value").alias("h"))
        upto = F.sum("m").over(W.partitionBy("g", "low", "high").orderBy("bin"))  # `bins` rows at most
        counts = counts.withColumn("before", upto - F.col("m"))
        at = F.col("rank") - F.col("below") - F.col("before")
        open_ = cut_lineage(rest.join(counts, ["g", "low", "high"]).where((at >= 1) & (at <= F.col("m"))).select("g", "rank", (F.col("below") + F.col("before")).alias("below"), F.col("l").alias("low"), F.col("h").alias("high"), F.col("m").alias("n")))
    if not done:
        return wanted.limit(0).select("g", "rank", F.lit(0.0).alias("value"))
    found = cut_lineage(reduce(DataFrame.unionByName, done))
    ties = found.where("low = high").select("g", "rank", F.col("low").alias("value"))
    small = found.where("low < high")
    rows = _sized(values, small.select("g", "low", "high").distinct(), "g").where(F.col("value").between(F.col("low"), F.col("high")))
    rows = rows.withColumn("nr", F.row_number().over(W.partitionBy("g", "low", "high").orderBy("value")))
    return ties.unionByName(small.join(rows, ["g", "low", "high"]).where("nr = rank - below").select("g", "rank", "value"))


def _sized(values: DataFrame, ranges: DataFrame, on: str) -> DataFrame:
    """values with the ranges of their group, which are sent to them if they are few."""
    few = ranges.limit(MOST_RANGES + 1).count() <= MOST_RANGES
    return values.join(F.broadcast(ranges) if few else ranges, on)


def latency_stats(latencies: DataFrame, by: list[str]) -> DataFrame:
    """by with count, mean, median, nearest-rank percentiles, min and max of ms; zeros for an empty table without groups.

    Percentiles are exact and found in parts (exact_ranks). ms: finite numbers; nulls are left out, groups of nulls
    alone have null statistics.
    """
    keyed = latencies.withColumn("g", F.to_json(F.struct(F.lit(0).alias("_"), *by)))
    plain = [F.count("ms").alias("count"), F.avg("ms").alias("mean"), F.min("ms").alias("min"), F.max("ms").alias("max")]
    sums = cut_lineage(keyed.groupBy("g", *by).agg(*plain) if by else keyed.agg(*plain).select(F.to_json(F.struct(F.lit(0).alias("_"))).alias("g"), "*"))
    n = F.col("count")
    ranks = {f"p{q}": F.greatest(F.ceil(n * q / 100), F.lit(1)) for q in (50, 95, 99)} | {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}
    wanted = sums.where("count > 0").select("g", F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks.values()]))).alias("rank"))
    found = exact_ranks(keyed.select("g", F.col("ms").alias("value")), wanted).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__v"))
    df = sums.join(found, "g", "left")
    at = {k: F.element_at("__v", r.cast("long")) for k, r in ranks.items()}
    out = df.select(*by, "count", "mean", ((at["low"] + at["high"]) / 2).alias("median"), *[at[f"p{q}"].alias(f"p{q}") for q in (50, 95, 99)], "min", "max")
    return out if by else out.na.fill(0.0)


def latency_rounds(latencies: DataFrame) -> DataFrame:
    """latency_stats for each (round, kind), each kind, and all; null stands for all."""
    none = [F.lit(None).cast(t).alias(c) for c, t in latencies.dtypes if c in ("round", "kind")]
    name = dict(zip([c for c, _ in latencies.dtypes if c in ("round", "kind")], none))
    levels = F.array(F.struct(F.lit(0).alias("level"), "round", "kind"), F.struct(F.lit(1).alias("level"), name["round"], "kind"), F.struct(F.lit(2).alias("level"), name["round"], name["kind"]))
    return latency_stats(latencies.select("ms", F.explode(levels).alias("l")).select("ms", "l.*"), ["level", "round", "kind"]).drop("level")


def aggregate_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """avg_<metric> of every numeric column, nulls left out."""
    numeric = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint") and c not in (by or [])]
    return rows.groupBy(*(by or [])).agg(*(F.avg(c).alias(f"avg_{c}") for c in numeric))


def flatten_report(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, metric, value) of reports with retrieval, answer, latency: (aggregated, latency) maps, and avg_parse_score. by tells reports apart."""
    by = by or []
    maps = [("retrieval_bench.aggregated", ""), ("retrieval_bench.latency", "retrieval_"), ("answer_bench.aggregated", ""), ("answer_bench.latency", "answer_"), ("latency_bench.aggregated", "latency_")]
    out = report.select(*by, F.lit("avg_parse_score").alias("metric"), F.col("parse_bench.avg_parse_score").alias("value"))
    for path, prefix in maps:
        each = report.select(*by, F.explode(path).alias("metric", "value"))
        out = out.unionByName(each.select(*by, F.concat(F.lit(prefix), "metric").alias("metric"), "value"))
    return out.where(F.col("value").isNotNull())


def compare_runs(base: DataFrame, candidate: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, metric, baseline, candidate, delta, delta_pct and status: PASS, FAIL, SKIP (missing) or INFO (no rule). by: keys of pairs of runs."""
    by = by or []
    df = base.select(*by, "metric", F.col("value").alias("baseline")).join(candidate.select(*by, "metric", F.col("value").alias("candidate")), [*by, "metric"], "full")
    delta = F.col("candidate") - F.col("baseline")
    pct = F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).when(delta == 0, 0.0).when(delta.isNotNull(), F.lit(float("inf")))
    rise = F.lit(None).cast("double")
    for metric, most in LOWER_BETTER.items():
        rise = F.when(F.col("metric") == metric, most).otherwise(rise)
    status = (
        F.when(F.col("baseline").isNull() | F.col("candidate").isNull(), "SKIP")
        .when(F.col("metric").isin(HIGHER_BETTER), F.when(delta < 0, "FAIL").otherwise("PASS"))
        .when(rise.isNotNull(), F.when((F.col("baseline") > 0) & (delta / F.col("baseline") > rise), "FAIL").otherwise("PASS"))
        .otherwise("INFO")
    )
    return df.select(*by, "metric", "baseline", "candidate", delta.alias("delta"), pct.alias("delta_pct"), status.alias("status"))


def gates(report: DataFrame, thresholds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, metric, value, threshold and passed; a metric that the report lacks fails."""
    by = by or []
    return thresholds.join(report, [*by, "metric"], "left").select(*by, "metric", "value", "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def subset_coverage(per_query: DataFrame, ids: DataFrame, metric: str) -> DataFrame:
    return per_query.join(ids.select("query_id").distinct(), "query_id", "left_semi").agg(F.avg(metric).alias("value"), F.count("*").alias("queries"))


def category_summary(scores: DataFrame) -> DataFrame:
    """category (null for all), n, mean score, and the share of rows with tables and with formulas."""
    rate = lambda c: (F.count_if(F.col(c) > 0) / F.count("*")).alias(f"{c}_rate")
    return scores.rollup("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), rate("tables"), rate("formulas"))


def infer_structure(hits: DataFrame, most: int = 20) -> DataFrame:
    """paper_id, headers (distinct lines that look like headings), has_tables, has_formulas and has_figures of its texts."""
    lines = hits.select("paper_id", "chunk_index", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    heads = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^(\d+(\.\d+)*\.?\s+)?[A-Z][A-Za-z][A-Za-z ,:-]{1,60}$"))
    first = heads.groupBy("paper_id", "line").agg(F.min(F.struct("chunk_index", "nr")).alias("at"))
    first = first.withColumn("__n", F.row_number().over(W.partitionBy("paper_id").orderBy("at", "line"))).where(F.col("__n") <= most)
    named = first.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("x")).select("paper_id", F.transform("x", lambda r: r["line"]).alias("headers"))
    flags = hits.groupBy("paper_id").agg(
        F.bool_or(F.col("text").rlike(r"(?i)\btable\s+\d|\|.*\|")).alias("has_tables"),
        (F.sum(F.regexp_count("text", F.lit(r"[=∑∫√±≤≥≈]"))) >= 2).alias("has_formulas"),
        F.bool_or(F.col("text").rlike(r"(?i)\bfig(ure|\.)\s*\d")).alias("has_figures"),
    )
    return flags.join(named, "paper_id", "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))

import statistics

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import evaluation as E
from scriptorium.operators import layout as L


@pytest.mark.parametrize("bins,few", [(4, 3), (4096, 10_000)])
def test_exact_ranks(spark, bins, few):
    """Ties, one value, negative and very unequal values, and a group that holds most rows: every rank against sorting."""
    groups = {"ties": [1.0, 2.0, 2.0, 2.0, 3.0] * 7, "one": [5.5], "same": [7.0] * 40, "mixed": [-1e308, 1e308, -3.0, 0.0, 1e-300, 2e-300, -5e-324] * 3, "hot": [float((k * 7919) % 1009) / 7 for k in range(1500)]}
    values = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("nulls", None)], "g string, value double")
    asked = [(g, r) for g, vs in groups.items() for r in range(1, len(vs) + 1, 1 if len(vs) < 50 else 97)]
    got = {(r.g, r.rank): r.value for r in E.exact_ranks(values, spark.createDataFrame(asked, "g string, rank long"), bins, few).collect()}
    assert got == {(g, r): sorted(groups[g])[r - 1] for g, r in asked}
    assert E.exact_ranks(values.limit(0), spark.createDataFrame(asked, "g string, rank long"), bins, few).count() == 0


def test_latencies_of_odd_tables(spark):
    rows = [("a", k % 4) for k in range(10)] + [("b", 3), (None, 1), (None, 8), ("c", None)]
    df = spark.createDataFrame(rows, "kind string, ms int").withColumn("ms", F.col("ms").cast("double"))
    got = {r.kind: r for r in E.latency_stats(df, ["kind"]).collect()}
    assert got["a"].median == statistics.median([k % 4 for k in range(10)]) and (got["a"].p50, got["a"].p95, got["a"]["count"]) == (1, 3, 10)
    assert (got["b"].median, got["b"].p99, got[None].median, got[None].p50, got["c"]["count"], got["c"].p50) == (3, 3, 4.5, 1, 0, None)
    (empty,) = E.latency_stats(df.limit(0), []).collect()
    assert (empty["count"], empty.p50, empty.median) == (0, 0, 0)


def test_anchored_lines(spark):
    """A slanting page: the lines by neighbours see one line, those by their first word cut it."""
    words = spark.createDataFrame([(1, 1, k, f"w{k}", 10.0 * k, 100 + 1.0 * k, 10.0 * k + 9, 110 + 1.0 * k) for k in range(7)] + [(1, 1, 9, " ", 0.0, 0.0, 1.0, 1.0)], "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in L.words_to_lines(words.where("ord < 9")).orderBy("line").collect()] == ["w0 w1 w2 w3 w4 w5 w6"]
    assert [(r.line, r.text) for r in L.anchored_lines(words).orderBy("line").collect()] == [(0, "w0 w1 w2"), (1, "w3 w4 w5"), (2, "w6")]


def test_anchored_lines_of_full_pages(spark):
    """against plain Python, with ties, tops that are missing or no numbers, and 30,000 words on a page; lines aren't put together by a second grouping."""
    import random

    rng = random.Random(3)
    tops = lambda n: [rng.choice([None, float("nan"), 100.0, 101.0, 103.0, 104.0, rng.uniform(90, 140)]) for _ in range(n)]
    rows = [(d, 1, k, rng.choice(["a", "b  c", " d "]), float(rng.randrange(3)), y, float(k), 1.0) for d, n in enumerate((1, 2, 40, 30_000)) for k, y in enumerate(tops(n))]
    words = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    found = L.anchored_lines(words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    want = {}
    for d in range(4):
        line, top = -1, None
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[5] is not None, r[5] != r[5] if r[5] is not None else False, 0 if r[5] is None or r[5] != r[5] else r[5], r[4], r[2])):
            if top is None or r[5] is not None and not abs(r[5] - top) <= 2.5:
                line, top = line + 1, r[5]
            want.setdefault((d, line), []).append(" ".join(r[3].strip().split()))
    got = {(r.doc_id, r.line): r.text for r in found.collect()}
    assert got == {k: " ".join(v) for k, v in want.items()}


def test_page_text_groups_once(spark):
    """without pages the raw text is the regions' own, as it is with them, and no page is moved a second time."""
    rows = [(d, 1, k, 10.0 * k, kind, text) for d, found in enumerate(([("paragraph", "a" * 90), ("reference", "[1] x")], [("other", " short "), ("paragraph", " b "), ("header", "")], [("header", "h" * 100)], [(None, "n" * 90)])) for k, (kind, text) in enumerate(found)]
    regions = spark.createDataFrame(rows[::-1], 'doc_id int, page int, `order` int, y0 double, type string, text string')
    pages = regions.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), " ").alias("raw"))
    found = L.page_text(regions)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == {r.doc_id: r.text for r in L.page_text(regions, pages).collect()} == {0: "a" * 90, 1: " short   b  ", 2: "h" * 100, 3: "n" * 90}

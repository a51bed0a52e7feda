"""Recall by shared vectors and neighbours in time, held against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import memory as M
from scriptorium.operators import retrieval as R


def _told(spark, n=300):
    """Memories of which many share a vector, some vectors are alike, and one is missing or null."""
    vectors = [(v, [math.sin(v % 9), math.cos(v % 9), float(v % 2)]) for v in range(20)] + [(20, None), (21, [0.0, 0.0, 0.0])]
    rows = [(i, f"m{i}", None if i % 50 == 7 else i % 3, (i * i) % 24, 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, content string, project_id long, vector_id long, access_count long"), spark.createDataFrame(vectors, "vector_id long, vector array<float>")


def test_memories_that_share_a_vector_are_searched_as_one(spark, monkeypatch):
    """what is sent to the search follows the vectors of a project; hits are those of a search of all memories."""
    memories, vectors = _told(spark)
    queries = memories.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vector_id", "project_id")
    queries = queries.unionByName(queries.where("query_id < 9").withColumn("project_id", F.lit(1).cast("long")))  # one query in two projects
    sent, search = [], M.vector_search

    def counted(q, v, *args, **kwargs):
        sent.append((q.count(), v.count()))
        return search(q, v, *args, **kwargs)

    monkeypatch.setattr(M, "vector_search", counted)
    plain = lambda df: sorted(((r.query_id, r["rank"], r.id, None if r.score is None else round(r.score, 6)) for r in df.collect()), key=repr)
    with_vectors = lambda df: df.join(vectors, "vector_id")
    want = M.recall(with_vectors(queries), with_vectors(memories), 7)
    got = M.recall(queries, memories, 7, vectors)
    assert plain(got[0]) == plain(want[0])
    assert sorted(got[1].collect()) == sorted(want[1].collect())
    assert sent[0][1] > 200 and max(sent[1]) <= 3 * 22 + 22


def test_blocks_grow_with_the_tables(spark, monkeypatch):
    """many blocks would send each vector once for each block of queries."""
    for name, n in {"QUERY_BLOCK": 4, "VECTOR_BLOCK": 8, "EACH": 1}.items():
        monkeypatch.setattr(R, name, n)

    def counting(k, own, schema):
        def count(queries, vectors):
            import pyarrow as pa

            return pa.table([[0], vectors["paper_id"].to_pylist()[:1], [0], [float(len(vectors))]], names=["query_id", "paper_id", "chunk_index", "score"]) if len(queries) and len(vectors) else pa.table({"query_id": pa.array([], pa.int64()), "paper_id": pa.array([], pa.int64()), "chunk_index": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        return count

    monkeypatch.setattr(R, "_best_of_blocks", counting)
    rows = spark.range(128).select(F.col("id").alias("paper_id"), F.lit(0).cast("long").alias("chunk_index"), F.array(F.lit(1.0)).alias("vector"))
    found = R.vector_search(rows.where("paper_id < 64").withColumnRenamed("paper_id", "query_id"), rows, 1000)
    assert sum(r.score for r in found.collect()) == 2 * 128


@pytest.mark.parametrize("at_once", [(256, 4_096), (3, 8)])
def test_later_vectors_count_only_above_the_kth(spark, monkeypatch, at_once):
    """Copies tie in the order of their keys, however few vectors are looked at together."""
    monkeypatch.setattr(R, "AT_ONCE", at_once[0])
    monkeypatch.setattr(R, "ROWS_AT_ONCE", at_once[1])
    draw = random.Random(5)
    rows = [((k * 37) % 101, k % 2, [float(draw.randrange(-2, 3)) for _ in range(3)] if k % 11 else ([float("nan")] * 3 if k % 2 else None)) for k in range(101)]
    v = spark.createDataFrame(rows, "paper_id long, chunk_index long, vector array<float>")
    q = v.where("paper_id % 4 = 0").withColumn("query_id", F.col("paper_id"))
    pairs = q.select("query_id", R.normalised(F.col("vector")).alias("q")).crossJoin(v.select(*R.KEY, R.normalised(F.col("vector")).alias("v"))).select("query_id", *R.KEY, R.dot(F.col("q"), F.col("v")).alias("score"))
    plain = lambda df: sorted((r.query_id, r["rank"], r.paper_id, str(None if r.score is None else round(r.score, 6) + 0.0)) for r in df.collect())
    assert plain(R.vector_search(q, v, 6)) == plain(R.top_per_query(pairs, 6))


def test_neighbours_in_time_against_every_pair(spark):
    """neighbours are looked up, not paired; at one hot second many memories and seeds tie by id."""
    draw = random.Random(3)
    times = lambda: draw.choice([1000, 1000, 1001, draw.randrange(0, 3000), draw.randrange(-90_000, 90_000)])
    rows = [(i, draw.choice([0, 1, None]), None if i % 40 == 0 else times()) for i in range(600)]
    memories = spark.createDataFrame(rows, "id long, project_id long, timestamp long")
    seeds = []
    for q in range(40):
        of = [r for r in rows if r[1] == q % 2]
        seeds += [(q, n + 1, *r) for n, r in enumerate(draw.sample(of, draw.choice([1, 6, 12])))]
    want = set()
    for q in range(40):
        own = [s for s in seeds if s[0] == q]
        ids, best = {s[2] for s in own}, {}
        for s in own:
            if s[1] <= 3 and s[4] is not None:
                near = sorted((abs(t - s[4]), i, t) for i, p, t in rows if p == s[3] and t is not None and i not in ids and abs(t - s[4]) <= 700)
                for n, (_, i, t) in enumerate(near[:5]):
                    best[i] = min(best.get(i, (99, 99, 0)), (s[1], n + 1, t))
        places = [((0, s[1]), s[2], s[4], "seed") for s in own] + [(b[:2], i, b[2], "neighbour") for i, b in best.items()]
        kept = sorted(sorted(places)[:9], key=lambda x: (x[2] is not None, x[2] or 0, x[1]))
        want |= {(q, n + 1, *x[1:]) for n, x in enumerate(kept)}
    found = M.expand_temporal(spark.createDataFrame(seeds, "query_id long, rank int, id long, project_id long, timestamp long"), memories, 700, total=9)
    assert {tuple(r) for r in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    strings = lambda df: df.withColumn("id", F.concat(F.lit("m"), "id"))
    named = M.expand_temporal(strings(spark.createDataFrame(seeds, "query_id long, rank int, id long, project_id long, timestamp long")), strings(memories), 700)
    assert named.where("role = 'neighbour'").count() > 0
    none = spark.createDataFrame([], "query_id long, rank int, id long, project_id long, timestamp long")
    assert M.expand_temporal(none, memories).count() == M.expand_temporal(none, memories.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, 1, 5, 0, 50)], "query_id long, rank int, id long, project_id long, timestamp long")
    assert [r.role for r in M.expand_temporal(alone, memories.limit(0)).collect()] == ["seed"]


def test_the_job_recalls_once(spark, monkeypatch):
    """hits are kept for the counts, the seeds and what is around them, so that vectors aren't searched anew for each."""
    memories, vectors = _told(spark)
    memories = memories.withColumn("timestamp", F.col("id") * 60)
    queries = memories.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"), "vector_id", "project_id")
    out = M.reconstruct_job(queries, memories, 4, vectors)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1  # neighbours in time; the search is behind a checkpoint
    rows = {r.query_id: r for r in out.collect()}
    assert len(rows) == queries.count() and {r.seeds for r in rows.values()} == {4}


def test_digests_recall_once(spark):
    """what is left to run is the look-up of neighbours; the search is behind a checkpoint."""
    from scriptorium.plans import registry

    plan = registry.QUERIES["mem15_reconstruct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1

import json
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import registry as U
from scriptorium.operators import memory as M
from scriptorium.operators import retrieval as R
from scriptorium.sources import stores as S
from scriptorium.streaming import jobs as J


def test_split_text():
    assert J.split_text("a<thi", False) == ("", "a", "<thi", False)
    assert J.split_text("<think>x</think>y", False) == ("x", "y", "", False)
    assert J.split_text("x</th", True) == ("x", "", "</th", True)


def test_split_reasoning_batch(spark):
    text = "ab<think>why\nso</think>answer<think>more"
    rows = [(1, k, text[i : i + 7]) for k, i in enumerate(range(0, len(text), 7))]
    r = J.split_reasoning_batch(spark.createDataFrame(rows, "stream_id long, seq int, text string")).first()
    assert (r.reasoning, r.answer) == ("why\nsomore", "abanswer")


def test_assemble_answers_batch(spark):
    rows = [(1, 0, "references", "[1]"), (1, 2, "chunk", "b"), (1, 1, "chunk", "a"), (1, 3, "done", ""), (2, 0, "chunk", "x")]
    got = J.assemble_answers_batch(spark.createDataFrame(rows, "stream_id long, seq int, type string, data string")).collect()
    assert [(r.stream_id, r.references, r.answer) for r in got] == [(1, "[1]", "ab")]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


WORDS = "Some words of a section that are long enough to be a chunk of their own, one after another. "
LISTED = "References\n" + "\n".join(f"[{k}] A. Author, A title of a paper, 20{k:02d}." for k in range(9))


def parsed(n, *texts, **more):
    return {"paper_id": n, "project_id": 7, "markdown": "\n\n".join(texts), "pages": [], "metadata": {}} | more


def ingest(spark, path, name, *rows):
    (path / "in").mkdir(exist_ok=True)
    (path / "in" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    J.ingest_stream(spark, str(path / "in"), str(path / "store"), str(path / "check")).awaitTermination(300)


def test_ingest_stream(spark, tmp_path):
    """Papers, children and parents of a batch; bad rows fail alone; a paper that comes again, or fails, loses what it had."""
    paged = [{"page_number": 1, "text": WORDS * 3, "region_types": ["paragraph"]}, {"page_number": 2, "text": LISTED, "region_types": ["reference", "reference"]}]
    ingest(
        spark, tmp_path, "a.json", parsed(1, "# One title of a paper", WORDS * 4, "## Methods", WORDS * 9, "## References", LISTED), parsed(2, " "), "{no json", {"project_id": 3, "markdown": "x"},
        parsed(3, pages=paged, markdown=None), parsed(4, "# Another title of a paper", WORDS * 3),
    )
    store = str(tmp_path / "store")
    read = lambda name: S.read_versioned(spark, store, name)
    status = lambda: {r.paper_id: r.status for r in J.paper_status(spark, store).collect()}
    assert status() == {1: "completed", 2: "failed", 3: "completed", 4: "completed"}
    papers = {r.paper_id: r for r in read("papers").collect()}
    children = read("children").collect()
    assert {k: r.chunk_count for k, r in papers.items()} == {k: sum(c.paper_id == k for c in children) for k in papers} and papers[1].chunk_count > 2
    assert papers[3].skipped_pages == 1 and {c.page_number for c in children if c.paper_id == 3} == {1} and not any("A. Author" in c.text for c in children)
    assert sorted(c.chunk_index for c in children if c.paper_id == 1) == list(range(papers[1].chunk_count)) and {c.project_id for c in children} == {7}
    # every child that names a parent is among the parent's, and no parent is without children
    owned = {(p.parent_id, k) for p in read("parents").collect() for k in p.child_chunk_indices}
    assert owned == {(c.parent_id, c.chunk_index) for c in children if c.parent_id} and all(p.child_chunk_indices for p in read("parents").collect())
    assert len(spark.read.option("recursiveFileLookup", True).text(f"{store}/rejected").collect()) == 2
    ingest(spark, tmp_path, "b.json", parsed(1, "# One new title of a paper", "Short and new text of it."), parsed(4, ""), parsed(5, WORDS), parsed(5, WORDS))
    assert status() == {1: "completed", 2: "failed", 3: "completed", 4: "failed", 5: "completed"}
    after = read("children").collect()
    assert {c.paper_id for c in after} == {1, 3, 5} and sum(c.paper_id == 5 for c in after) == 1
    assert all("Methods" not in (c.section_path or "") for c in after)
    J.request_again(spark.createDataFrame([(3,)], "paper_id long"), store, "r1")
    assert status()[3] == "pending" and 3 not in {c.paper_id for c in read("children").collect()}


def test_half_written_batch_is_run_again(spark, tmp_path, monkeypatch):
    """A batch that dies between its tables and its heads: the old chunks stay readable, papers show as processing, and the rerun completes it."""
    ingest(spark, tmp_path, "a.json", parsed(1, WORDS))
    store, write = str(tmp_path / "store"), S.write_versioned
    before = S.read_versioned(spark, store, "children").collect()

    def dies(tables, ids, path):
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/version=2")
            if name == "parents":
                raise RuntimeError("lost")

    monkeypatch.setattr(J, "write_versioned", dies)
    with pytest.raises(Exception, match="lost"):
        ingest(spark, tmp_path, "b.json", parsed(1, "Other text. " + WORDS), parsed(2, WORDS))
    assert S.read_versioned(spark, store, "children").collect() == before
    assert {r.paper_id: r.status for r in J.paper_status(spark, store).collect()} == {1: "processing", 2: "processing"}
    monkeypatch.setattr(J, "write_versioned", write)
    J.ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination(300)
    rows = S.read_versioned(spark, store, "children").collect()
    assert sorted(r.paper_id for r in rows) == [1, 2] and any(r.text.startswith("Other text.") for r in rows)
    assert {r.paper_id: r.status for r in J.paper_status(spark, store).collect()} == {1: "completed", 2: "completed"}


def test_dedupe(spark, tmp_path):
    src = tmp_path / "req"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "request string, t string").select("request", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("request string, ts timestamp").parquet(str(src))
    q = J.dedupe_requests(stream).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deduped").count() == 2


def test_consolidation_from_state(rocks, tmp_path, monkeypatch):
    """Batches of 1 to 30 memories give the summaries of one batch, which are those of the table operators."""
    spark = rocks
    monkeypatch.setattr(J, "KEEP", 2)
    rows = [(str(k), 3 if k % 3 else 4, (k * 37) % 100, f"memory {k % 5} of the project") for k in range(90)] + [("x", 5, 1, "alone")]
    schema = "id string, project_id long, timestamp long, content string"
    got = []
    for name, cuts in (("many", [0, 1, 30, 60, 91]), ("one", [0, 91])):
        src, store = str(tmp_path / name), str(tmp_path / f"{name}-store")
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(src)
            J.consolidate_stream(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / f"{name}-check")).awaitTermination(300)
        got.append(sorted(map(tuple, J.read_summaries(spark, store).select("project_id", "original", "compressed", "removed", "summary").collect())))
    table = spark.createDataFrame(rows, schema)
    want = M.compress(table, ["project_id"]).join(M.summarize_group(table, "project_id"), "project_id").where("original >= 20")
    assert got[0] == got[1] == sorted(map(tuple, want.select("project_id", "original", "compressed", "removed", "summary").collect())) and len(got[0]) == 2


def run_until(df, out, check, done, seconds=60):
    """Runs a query with timers until done(query); those end only when they are stopped."""
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start(out)
    until = time.time() + seconds
    while time.time() < until and not done(q):
        time.sleep(0.3)
    q.stop()


def inputs(q):
    return sum(p.numInputRows for p in q.recentProgress)


def rows_of(spark, out):
    try:
        return spark.read.parquet(out).count()
    except Exception:  # nothing is written yet
        return 0


def left(spark, check):
    return spark.read.format("statestore").option("stateVarName", "state").load(check).count()


def test_splitter_leaves_no_state(rocks, tmp_path):
    """A stream that ends and one that falls silent in half a tag, over two batches."""
    spark, schema, idle = rocks, "stream_id long, seq long, text string, last boolean", 1
    src, out, check = (str(tmp_path / x) for x in ("s", "out", "c"))
    text = "ab<think>why</think>answer"
    ended = [(1, k, text[i : i + 4], i + 4 >= len(text)) for k, i in enumerate(range(0, len(text), 4))]
    for rows, n in ((ended + [(2, 0, "x<think>y</th", False)], 3), ([(3, 0, "late", True)], 4)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run_until(J.split_reasoning(spark.readStream.schema(schema).parquet(src), idle), out, check, lambda q: rows_of(spark, out) >= n)  # noqa: B023
    assert sorted((r.stream_id, r.reasoning, r.answer, r.done) for r in spark.read.parquet(out).collect()) == [(1, "why", "abanswer", True), (2, "</th", "", True), (2, "y", "x", False), (3, "", "late", True)]
    assert left(spark, check) == 0


def test_memory_stream(spark, tmp_path):
    spark.createDataFrame([("a question that matters", "user"), ("an answer", "assistant")], "content string, agent_source string").coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("content string, agent_source string").parquet(str(tmp_path / "m"))
    q = J.memory_stream(stream, 1000).writeStream.format("memory").queryName("memories").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("memories").orderBy("content").collect()
    assert [(r.content, r.agent_source, r.timestamp, r.access_count, r.memory_type) for r in got] == [("a question that matters", "user", 1000, 0, "dynamic"), ("an answer", "assistant", 1000, 0, "dynamic")]
    assert len({r.id for r in got}) == 2 and all(0.5 <= r.importance <= 1 for r in got)


def test_stateful_assembly(rocks, tmp_path):
    """Events of a stream come in two batches; one without an end is emitted when it has been silent, and no state is left."""
    spark, schema = rocks, "stream_id long, seq long, type string, data string"
    src, out, check = (str(tmp_path / x) for x in ("e", "out", "c"))
    first = [(1, 0, "references", "[1]"), (1, 1, "chunk", "a")]
    for rows, idle, n in ((first, 600_000, 0), ([(1, 3, "done", ""), (1, 2, "chunk", "b"), (2, 0, "chunk", "x")], 1, 2), ([(3, 0, "done", "")], 1, 3)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run_until(J.assemble_answers(stream, idle), out, check, lambda q: inputs(q) >= len(rows) and rows_of(spark, out) >= n)  # noqa: B023
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "[1]", "ab", True), (2, "", "x", False), (3, "", "", True)]
    assert left(spark, check) == 0


def test_registry(spark):
    U.register(spark, "twice", lambda s: s * 2, "long", "doubles", {"x": "long"}, "math")
    assert spark.sql("SELECT twice(21L)").first()[0] == 42
    assert [r.name for r in U.list_functions(spark, "math").collect()] == ["twice"]
    safe = U.safe_udf(lambda v: 10 // v, "long")
    got = [r.r for r in spark.createDataFrame([(0,), (5,)], "v long").select(safe("v").alias("r")).collect()]
    assert [(r.success, r.data) for r in got] == [(False, None), (True, 2)] and "ZeroDivisionError" in got[0].error


def test_table_functions_and_time_limits(spark):
    U.register_table(spark, "letters", lambda t, n: ((c, k) for k, c in enumerate(t[:n])), "letter string, nr int", "letters of a text", {"text": "string", "n": "int"}, "texts", 5)
    assert [tuple(r) for r in spark.sql("SELECT * FROM letters('abc', 2) ORDER BY nr").collect()] == [("a", 0), ("b", 1)]
    assert [tuple(r) for r in spark.sql("SELECT t, letter FROM VALUES ('xy'), ('z') v(t), LATERAL letters(t, 9) ORDER BY t, nr").collect()] == [("xy", "x"), ("xy", "y"), ("z", "z")]
    assert [(r.name, r.kind, r.timeout) for r in U.list_functions(spark, "texts").collect()] == [("letters", "table", 5.0)]

    def slow(v):
        end = time.time() + v
        while time.time() < end:
            pass
        return v

    df = spark.createDataFrame([(0.0,), (30.0,), (0.01,)], "v double").coalesce(1)
    got = {r.v: r.r for r in df.select("v", U.safe_udf(slow, "double", timeout=0.5)("v").alias("r")).collect()}
    assert got[0.0].success and got[0.01].success and not got[30.0].success and got[30.0].error.startswith("TimeoutError")
    got = {r.v: r.r for r in df.select("v", U.safe_udf(slow, "double", batch_timeout=0.5)("v").alias("r")).collect()}
    assert got[0.0].success and [got[v].error.split(":")[0] for v in (30.0, 0.01)] == ["TimeoutError"] * 2
    U.register(spark, "slow", lambda s: s.map(slow), "double", timeout=0.5)
    with pytest.raises(Exception, match="TimeoutError"):
        spark.sql("SELECT slow(30.0D)").collect()


def test_embed_and_rerank(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "id int, text string")
    v = {r.id: r.vector for r in U.embed(df, "text").collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and sum(v[3]) == 0
    assert [r.vector for r in U.embed(df, "text", lambda t: [[float(len(x))] for x in t]).orderBy("id").collect()] == [[3.0], [3.0], [0.0]]
    hits = spark.createDataFrame([(1, "q", 1, 10, 0, "short"), (1, "q", 2, 11, 0, "the longest")], "query_id long, query string, rank int, paper_id long, chunk_index long, text string")
    orders = U.rerank(hits, lambda q, texts: sorted(range(len(texts)), key=lambda i: -len(texts[i])))
    assert [r.paper_id for r in R.apply_order(hits, orders, 2).orderBy("rank").collect()] == [11, 10]

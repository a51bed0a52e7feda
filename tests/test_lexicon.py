import pytest
from pyspark.sql import functions as F

from scriptorium.functions.lineage import new_folder
from scriptorium.operators import lexicon as X
from scriptorium.operators import retrieval as R

# words and stems of the description of the algorithm
STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll is is x2 x2 the the""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    got = {r.term: r.stem for r in spark.createDataFrame([(a,) for a, _ in pairs], "term string").withColumn("stem", X.stem(F.col("term"))).collect()}
    assert {a: got[a] for a, b in pairs if got[a] != b} == {}


@pytest.fixture
def opened(spark):
    names = []

    def make(*batches):
        path = new_folder(spark)
        name = f"t_{path.rsplit('/', 1)[1]}"
        X.open_index(spark, name, path, 4)
        for rows, papers in batches:
            X.add_to_index(rows, name, papers, 4)
        names.append(name)
        return name, path

    yield make
    for n in names:
        for t in X.TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {n}_{t}")


def contents(spark, name):
    return [[sorted(map(str, t.drop("part").collect())) for t in X.read_index(spark, name, a)] for a in ("words", "english")]


def test_adding_equals_building_anew(spark, opened):
    """Added, replaced and emptied papers, a failed batch, and the same folder opened under another name."""
    chunks = lambda rows: spark.createDataFrame(rows, "paper_id long, chunk_index long, text string")
    old, new = chunks([(1, 0, "The cats were running"), (2, 0, "hello 知识图 world"), (3, 0, "gone soon")]), chunks([(1, 0, "A dog runs"), (1, 1, ""), (4, 0, "the hopeful cat; a cat")])
    emptied = chunks([(3, 0, ""), (1, 0, ""), (4, 0, "")])
    by_batches, path = opened((old, None), (new, emptied))
    whole, _ = opened((old.where("paper_id = 2").unionByName(new), None))
    assert contents(spark, by_batches) == contents(spark, whole)
    # a batch that failed after its postings
    X._append(spark.table(f"{whole}_words"), whole, "words", 4, "lost")
    assert contents(spark, by_batches) == contents(spark, whole)
    X.open_index(spark, f"{by_batches}_again", path, 4)
    assert contents(spark, f"{by_batches}_again") == contents(spark, whole)
    want = R.build_lexical_index(old.where("paper_id = 2").unionByName(new))
    assert contents(spark, whole)[0] == [sorted(map(str, t.collect())) for t in (want[0].select("term", *R.KEY, "tf", "dl"), want[1], want[2])]


def test_searches_of_a_stored_index(spark, opened, monkeypatch):
    """The same hits by broadcast and by buckets, where the postings aren't moved; stems find other forms."""
    rows = [(k, 0, f"word{k % 7} common text of running cats {k}") for k in range(60)]
    name, _ = opened((spark.createDataFrame(rows, "paper_id long, chunk_index long, text string"), None))
    q = spark.createDataFrame([(1, "word3 common"), (2, "nothing at all"), (3, "text 17")], "query_id long, query string")
    index = X.read_index(spark, name)
    few = sorted(map(tuple, R.bm25_search(q, index, 5).collect()))
    assert few and sorted(map(tuple, R.bm25_search(q, R.build_lexical_index(spark.createDataFrame(rows, "paper_id long, chunk_index long, text string")), 5).collect())) == few
    monkeypatch.setattr(R, "MOST_TERMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = R.bm25_search(q, index, 5)
        assert sorted(map(tuple, many.collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    forms = spark.createDataFrame([(1, "the cat runs")], "query_id long, query string")
    assert R.bm25_search(forms, X.read_index(spark, name), 5).count() == 0
    assert R.bm25_search(forms, X.read_index(spark, name, "english"), 5, asked=X.english_query(forms)).count() == 5


def test_neither_postings_nor_scores_are_moved(spark, opened):
    """A search of a stored index shuffles the best of each bucket alone; a chunk's terms are counted whatever their number."""
    rows = [(k, 0, "common " * (k % 5 + 1) + f"word{k % 7} {k}") for k in range(60)]
    name, _ = opened((spark.createDataFrame(rows, "paper_id long, chunk_index long, text string"), None))
    index = X.read_index(spark, name)
    assert {(r.paper_id, r.tf, r.dl) for r in index[0].where("term = 'common'").collect()} == {(k, k % 5 + 1, k % 5 + 3) for k in range(60)}
    q = spark.createDataFrame([(1, "word3 common"), (2, "common 17")], "query_id long, query string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.bm25_search(q, index, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "query_id" in line and "paper_id" in line.split("ENSURE")[0]] == []
    assert X.index_buckets(spark.createDataFrame([("x" * 100,)] * 3, "text string")) == X.BUCKETS


def test_hybrid_with_projects_and_papers(spark):
    """Filters work before the cut: hits are the best of what may answer."""
    rows = [(k, 0, f"alpha beta {k}", k % 3, [1.0, k / 10]) for k in range(30)]
    df = spark.createDataFrame(rows, "paper_id long, chunk_index long, text string, project_id long, vector array<double>")
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.0], 2), (2, "beta 7", [1.0, 3.0], 1), (3, "alpha", [1.0, 0.0], 9)], "query_id long, query string, vector array<double>, project_id long")
    index = R.build_lexical_index(df)
    got = R.hybrid_search(q, index, df, 4, same=["project_id"]).collect()
    assert {r.query_id: {x.paper_id % 3 for x in got if x.query_id == r.query_id} for r in got} == {1: {2}, 2: {1}} and len(got) == 8
    alone = R.hybrid_search(q.where("query_id = 1"), R.build_lexical_index(df.where("project_id = 2")), df.where("project_id = 2"), 4).collect()
    assert {(r.paper_id) for r in alone} == {r.paper_id for r in got if r.query_id == 1}
    papers = spark.createDataFrame([(1, 5), (1, 8), (1, 6), (2, 1)], "query_id long, paper_id long")
    assert sorted((r.query_id, r.paper_id) for r in R.hybrid_search(q, index, df, 4, ["project_id"], papers).collect()) == [(1, 5), (1, 8), (2, 1)]
    assert sorted({r.paper_id for r in R.hybrid_search(q, index, df, 4, papers=papers).collect() if r.query_id == 1}) == [5, 6, 8]


def test_postings_of_a_long_chunk(spark, opened):
    """terms are counted in time by a chunk's length, not by its length times its different terms."""
    import time

    text = " ".join(f"w{k % 60_000}" for k in range(90_000)) + " x x X é 中文中文"
    name, _ = opened()
    began = time.time()
    X.add_to_index(spark.createDataFrame([(1, 0, text), (2, 0, None), (2, 1, "b a b")], "paper_id long, chunk_index long, text string"), name, buckets=4, english=False)
    assert time.time() - began < 60
    postings, dfs, totals = X.read_index(spark, name)
    got = {(r.paper_id, r.chunk_index, r.term): (r.tf, r.dl) for r in postings.where("term IN ('w5', 'w40000', 'x', '中文', '文中', 'a', 'b', '')").collect()}
    assert got == {(1, 0, "w5"): (2, 90_006), (1, 0, "w40000"): (1, 90_006), (1, 0, "x"): (3, 90_006), (1, 0, "中文"): (2, 90_006), (1, 0, "文中"): (1, 90_006), (2, 1, "a"): (1, 3), (2, 1, "b"): (2, 3)}
    assert postings.count() == 60_000 + 3 + 2 and totals.first().n == 3

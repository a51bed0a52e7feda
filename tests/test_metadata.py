from pyspark.sql import functions as F

from scriptorium.operators import layout as L
from scriptorium.operators import metadata as M

PAPER = """Journal of Things vol. 3 pages 1
A Careful Study of Careful Studies: Methods
Ann Smith, Bo Jones and Cy Young
Abstract: This abstract says quite a lot about careful studies and why they matter to everyone who reads them closely. Keywords: care, study; methods

1 Introduction
Text."""


def test_extract_metadata(spark):
    r = M.extract_metadata(spark.createDataFrame([(PAPER,)], "text string")).first()
    assert r.title == "A Careful Study of Careful Studies: Methods"
    assert r.authors == ["Ann Smith", "Bo Jones", "Cy Young"]
    assert r.abstract.startswith("This abstract says") and r.abstract.endswith("closely.")
    assert r.keywords == ["care", "methods", "study"]
    none = M.extract_metadata(spark.createDataFrame([("",)], "text string")).first()
    assert (none.title, none.authors, none.abstract, none.keywords) == (None, [], None, [])


def test_reliable_title(spark):
    titles = ["A Careful Study of Studies", "short", "lower case title of a paper", "Citation: something else here", "Despite their awareness of it", None]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select(L.reliable_title(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [True, False, False, False, False, False]


def test_process_papers(spark):
    md = "# A Careful Study of Careful Studies\n\n## Abstract\n" + "words of the abstract " * 6 + "\n\n## Body\n" + "A sentence of the body. " * 40 + "\n\n## References\n[1] a\n[2] b\n[3] c\n"
    rows = [(1, md, None, {"date": "2020-01-02"}), (2, "  ", None, None)]
    parsed = spark.createDataFrame(rows, "paper_id long, markdown string, pages array<struct<page_number:int,text:string,markdown:string>>, metadata map<string,string>")
    papers, children, parents = M.process_papers(parsed)
    a, b = papers.orderBy("paper_id").collect()
    assert (a.title, a.status, str(a.published)) == ("A Careful Study of Careful Studies", "completed", "2020-01-02") and a.chunk_count >= 3
    assert (b.status, b.chunk_count, b.issues) == ("failed", 0, ["sanity_empty_output"])
    kept = children.collect()
    assert sorted(r.child_seq for r in kept) == list(range(len(kept))) and all("[1] a" not in r.text for r in kept)
    assert {r.parent_id for r in kept} == {r.parent_id for r in parents.collect()}


def test_merge_metadata_by_field(spark):
    """Each field by its own reliability; a side without a column, and a document without layout, leave the other's."""
    long = "An abstract that says enough about what was done here to be taken for one."
    rules = spark.createDataFrame(
        [(1, "A Good and Reliable Title", ["Ann Smith", "x1"], long, [], "a.pdf"), (2, "bad", ["doi 10", "page 3"], "short", ["Own"], "b.pdf"), (3, None, None, None, None, "c.tar.pdf"), (4, "bad", ["x1"], "short", [], "d.pdf")],
        "doc_id int, title string, authors array<string>, abstract string, sections array<string>, file_name string",
    )
    layout = spark.createDataFrame(
        [(1, "Another Title of the Layout", ["Bo Jones"], long + " More.", ["1:1"]), (2, "The Title in the Layout", ["Bo Jones"], long, ["2:1"]), (3, "bad", [], "also short", None)],
        "doc_id int, title string, authors array<string>, abstract string, sections array<string>",
    )
    got = {r.doc_id: tuple(r)[1:] for r in M.merge_metadata(rules, layout).collect()}
    assert got[1] == ("A Good and Reliable Title", ["Ann Smith", "x1"], long, ["1:1"])
    assert got[2] == ("The Title in the Layout", ["Bo Jones"], long, ["Own"])
    assert got[3] == ("c.tar", None, None, None)
    assert got[4] == ("d", ["x1"], "short", [])
    bare = {r.doc_id: r for r in M.merge_metadata(rules.select("doc_id", "title"), layout).collect()}
    assert bare[1].authors == ["Bo Jones"] and bare[2].abstract == long and bare[3].title is None and bare[3].sections is None
    assert M.merge_metadata(rules.limit(0), layout).count() == 0


def test_layout_metadata_splits_names(spark):
    rows = [(1, 1, 1, "author", "Ann Smith, Bo and Cy Young;X"), (1, 1, 2, "title", "  "), (1, 2, 1, "section_header", "Intro")]
    r = L.layout_metadata(spark.createDataFrame(rows, "doc_id int, page int, order int, type string, text string")).first()
    assert (r.title, r.authors, r.abstract, r.sections) == (None, ["Ann Smith", "Bo", "Cy Young"], None, ["Intro:2"])

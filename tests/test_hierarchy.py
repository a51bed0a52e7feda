"""Parents of chunks, told where a section is cut, and texts that only seem to list references."""

import compare
import duckdb
from pyspark.sql import functions as F

from scriptorium.functions.text import is_reference_like
from scriptorium.operators import hierarchy as H
from scriptorium.plans import registry

TEXTS = [
    "",
    "short",
    "# A\n" + "word " * 700 + "\n\n" + "other " * 30,
    "# A\n\n\n\n" + "x" * 4100 + "\n\n\ny",
    "\n\n\n" + "\n\n".join(f"Paragraph {i} " + "t" * (37 * i % 900) for i in range(30)),
    "\n\n" + "same. " * 300 + "\n\n" + "same. " * 300,
]


def test_parents_are_told_where_sections_are_cut(spark):
    rows = [(i, k, "p", "a", 1, 2, True, f"{t}{k}") for i in range(3) for k, t in enumerate(TEXTS)]
    s = spark.createDataFrame(rows, "paper_id long, nr int, path string, anchor string, page_start int, page_end int, is_leaf boolean, text string")
    met = H.assign_parents(H.child_chunks(s), H.parent_segments(s, 2000))
    told = H.child_chunks(s, most=2000)
    found = [sorted(df.select("paper_id", "nr", "child_seq", "text", "parent_id").collect()) for df in (met, told)]
    assert found[0] == found[1] and len({r.parent_id for r in found[0]}) > 3 * len(TEXTS)
    plan = registry.QUERIES["txt13_child_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_marks_without_a_word_are_no_headings(spark, tmp_path):
    """Every fifth line becomes a heading, blank ones too; held against the SQL."""
    texts = ["a\n\n\n\n\n\n\n\nx", "a\nb\nc\nd\ne\n \nf\ng\nh\ni\n\t\nj", "\nfoo\n# bar", "a\nb\n#  \nc\n## \n\n# d\n###\ne", "a\r\nb\r\n# \r\n## c\r", "\x0c\nx\n# y", "a\n# \x0b\nb"]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("txt09_section_tree", "txt10_map_section_pages"):
        assert compare.difference(spark, con, str(tmp_path), registry.QUERIES[name], registry.ORACLES[name]) == ""


def test_segments_of_a_section(spark):
    assert H._packed("a\n\nb", 2000) == ["a\n\nb"]
    assert H._packed("aaaa\n\n\nbbbb\n\ncccc", 10) == ["aaaa\n\nbbbb", "cccc"]
    assert H._packed("\n\naaaa\n\n" + "b" * 12 + "\n\n \n\n", 5) == ["aaaa", "bbbbb", "bbbbb", "bb"]


def test_traces_lose_no_list_of_references(spark):
    """Against the rule without its first look: every form of an entry after every blank that is trimmed."""
    blanks = ["", " ", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\x0b"]
    entries = ["[1] a", "[123]\tb", "[1234] c", "1. Abc", "22.\x0bBcd", "1. abc", "x et al.b", "x ET AL.b", "x et al. b", "doi: 10.1234/x", "DOI:10.12345/y", "doi 10.1234/x"]
    texts = [end.join([b + e] * 3 + ["plain"] * 2) for b in blanks for e in entries for end in ("\n", "\r\n", "\r")]
    like = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(is_reference_like(F.col("t")).alias("x")).collect()]
    true = {"[1] a", "[123]\tb", "1. Abc", "22.\x0bBcd", "x et al.b", "x ET AL.b", "doi: 10.1234/x", "DOI:10.12345/y"}
    assert like == [e in true for _ in blanks for e in entries for _ in range(3)]

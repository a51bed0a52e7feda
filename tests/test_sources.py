import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import stores as S
from scriptorium.sources import works as R


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_openalex(spark, tmp_path):
    path = lines(
        tmp_path / "o.json",
        {"id": "W1", "title": "T", "abstract_inverted_index": {"deep": [1, 3], "We": [0], "learn": [2]}, "publication_year": 2020, "cited_by_count": 5, "doi": "https://doi.org/10.1/a",
         "authorships": [{"author": {"id": "A", "display_name": "Ann"}, "institutions": [{"display_name": "U"}]}], "concepts": [{"display_name": "C", "level": 0, "score": 0.5}], "open_access": {"is_oa": True}},
        {"id": "W2", "authorships": None},
    )
    a, b = R.read_openalex(spark, path).orderBy("external_id").collect()
    assert (a.abstract, a.doi, a.authors[0].institution, a.concepts[0].name, a.is_open_access) == ("We deep learn deep", "10.1/a", "U", "C", True)
    assert (b.abstract, b.citation_count, b.authors, b.concepts, b.is_open_access) == (None, 0, [], [], False)


def test_s2_and_crossref(spark, tmp_path):
    a = R.read_s2(spark, lines(tmp_path / "s.json", {"paperId": "p", "title": "T", "externalIds": {"DOI": "10.1/x"}, "tldr": {"text": "short"}, "authors": [{"name": "Bo", "authorId": "1"}]})).first()
    assert (a.doi, a.tldr, a.citation_count, a.reference_count, a.authors[0].name) == ("10.1/x", "short", 0, 0, "Bo")
    c = R.read_crossref(spark, lines(tmp_path / "c.json", {"DOI": "10.2/y", "title": ["A", "B"], "author": [{"given": "C", "family": "D"}, {}], "published-online": {"date-parts": [[2019, 2]]}, "container-title": ["J"]})).first()
    assert (c.title, [x.name for x in c.authors], c.year, c.venue, c.citation_count) == ("A", ["C D"], 2019, "J", 0)


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><id>http://arxiv.org/abs/1234.5</id><title>A\n  title</title><summary> s </summary><author><name>X</name></author><author><name>Y</name></author>'
        '<category term="cs.CL"/><link href="h"/><link title="pdf" href="p"/><published>2021-02-03T00:00:00Z</published><updated>2021-03-03T00:00:00Z</updated></entry></feed>'
    )
    a = R.read_atom(spark, str(tmp_path / "a.xml")).first()
    assert (a.external_id, a.title, [x.name for x in a.authors], a.categories, a.pdf_url, a.published, a.year) == ("1234.5", "A title", ["X", "Y"], ["cs.CL"], "p", "2021-02-03", 2021)


def test_bibtex(spark, tmp_path):
    (tmp_path / "b.bib").write_text('@article{key1,\n  Title = {A {Big} title},\n  author = "Ann and Bo",\n  year = 2020,\n  year = 2021\n}\n\n@book{k2,\n title={Z}\n}\n')
    a, b = R.read_bibtex(spark, str(tmp_path / "b.bib")).orderBy("entry_type").collect()
    assert (a.entry_type, a.title, a.author, a.year) == ("article", "A {Big} title", "Ann and Bo", "2021")
    assert (b.key, b.title, b.doi) == ("k2", "Z", None)


def test_bibtex_layouts(spark, tmp_path):
    """Entries that end at the end of a line, two of them in a line, deep braces, joined and abbreviated values, quotes in braces, lost ends."""
    (tmp_path / "b.bib").write_text(
        "% a remark\n@string{jn = \"Journal of {Things}\"}\n@comment{ignored, title = {x}}\n@preamble{\"\\\\foo\"}\n"
        "@article{k1, title = {One {two {three} 3}}, year = {2020}}\n@book{k2, title = \"A {\"}quoted{\"} word\", year=2021} @misc{k3,title={C},mail = {a@b.c}}\n"
        "@article(k4,\n  title = \"First \" # {and} # \" last\",\n  journal = jn # \" Letters\", month = feb, note = {a, b = c},\n)\n"
        "@article{k5, title = {never ends}\n@inproceedings{k6,\n  title = {Sets \\{1\\} of 5\\% = all},\n  title = {The\n   last},\n}\r\n@Article{k7,TITLE={x}}"
    )
    got = {r.key: r for r in R.read_bibtex(spark, str(tmp_path / "b.bib")).collect()}
    assert sorted(got) == ["k1", "k2", "k3", "k4", "k6", "k7"]
    assert (got["k1"].title, got["k1"].year) == ("One {two {three} 3}", "2020") and (got["k2"].title, got["k2"].year, got["k2"].entry_type) == ('A {"}quoted{"} word', "2021", "book")
    assert got["k3"].fields == {"title": "C", "mail": "a@b.c"}
    assert got["k4"].fields == {"title": "First and last", "journal": "Journal of {Things} Letters", "month": "February", "note": "a, b = c"}
    assert got["k6"].fields == {"title": "The last"} and (got["k7"].title, got["k7"].entry_type) == ("x", "article")


def test_pages_and_tables(spark):
    items = spark.createDataFrame(
        [(1, 0, 0, "title", "T", 2, None), (1, 1, 0, "text", "x", None, None), (1, 2, 2, "list", "i", None, None), (1, 3, -1, "table", "t", None, "<b>"), (1, 4, 0, "footer", "f", None, None)],
        "doc_id int, ord int, page int, type string, text string, level int, body string",
    )
    counts = spark.createDataFrame([(1, 3)], "doc_id int, pages int")
    pages = {r.page: r.markdown for r in R.content_to_pages(items, counts).collect()}
    assert pages == {0: "## T\n\nx\n\n<b>", 1: "", 2: "- i"}
    tables = spark.createDataFrame([(1, [["a", "b", "a"], ["1", "2", "3"], ["x"]])], "table_id int, cells array<array<string>>")
    t = R.tables_to_records(tables).first()
    assert (t.records, t.rows, t.columns) == ([{"b": "2", "a": "3"}], 1, 3)


def test_bench(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"version": "1", "paper_index": {"p1": "Name"}, "items": [{"id": "q", "query": "x", "relevant_papers": ["p1", "p9"], "relevant_keywords": ["k"]}]}, indent=1))
    assert R.read_bench(spark, str(tmp_path / "r.json"), "retrieval").first().papers == ["Name", "p9"]


def test_read_parsed(spark, tmp_path):
    path = lines(tmp_path / "p.json", {"paper_id": 1, "markdown": "# T", "pages": [{"page_number": 1, "text": "T", "markdown": "# T"}]}, {"paper_id": 2, "markdown": None})
    a, b = R.read_parsed(spark, path).orderBy("paper_id").collect()
    assert (a.pages[0].page_number, a.pages[0].text, b.pages, b.markdown) == (1, "T", [], None)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_stores(spark, tmp_path):
    """Old, replaced, emptied and added papers, without a file rewritten; compaction changes nothing but files."""
    chunks = lambda rows: spark.createDataFrame(rows, "project_id long, paper_id long, chunk_index long, text string")
    path = str(tmp_path / "chunks")
    texts = lambda: sorted(r.text for r in S.read_chunks(spark, path).collect())
    S.write_chunks(chunks([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "c"), (2, 3, 0, "d")]), path)
    before = files(tmp_path)
    S.write_chunks(chunks([(1, 1, 0, "z")]), path)
    S.write_chunks(chunks([(1, 4, 0, "new")]), path, chunks([(1, 4, 0, ""), (2, 3, 0, "")]))  # paper 3 yields nothing any more
    assert texts() == ["c", "new", "z"] and S.read_chunks(spark, path, paper_id=2).count() == 1 and S.read_chunks(spark, path, project_id=2).count() == 0
    assert {p: t for p, t in files(tmp_path).items() if p in before} == before
    S.vacuum(spark, path, S.compact(spark, path))
    assert texts() == ["c", "new", "z"] and len(S.committed(spark, path)) == 1 and not any(p in before for p in files(tmp_path))
    S.write_chunks(chunks([(2, 3, 0, "again")]), path)
    assert texts() == ["again", "c", "new", "z"]
    parents = lambda rows: spark.createDataFrame(rows, "paper_id long, parent_id string, text string")
    path = str(tmp_path / "parents")
    S.write_parents(parents([(1, "1_p0", "a"), (1, "1_p1", "b"), (2, "2_p0", "c")]), path)
    S.write_parents(parents([(1, "1_p0", "z")]), path)
    ids = spark.createDataFrame([("1_p0",), ("1_p1",), ("2_p0",), ("9",)], "parent_id string")
    found = S.parents_by_id(S.read_parents(spark, path), ids)
    assert sorted(map(tuple, found.select("parent_id", "text").collect())) == [("1_p0", "z"), ("2_p0", "c")]


def test_failed_batch_leaves_the_store(spark, tmp_path):
    """A batch that dies before its heads are complete is never seen; the next one takes its place. Interrupted vacuums bring nothing back."""
    rows = lambda x: spark.createDataFrame(x, "paper_id long, text string")
    path = str(tmp_path / "s")
    read = lambda: sorted(map(tuple, S.read_versioned(spark, path, "t").collect()))
    with pytest.raises(FileNotFoundError):
        read()
    S.write_versioned({"t": rows([(1, "a"), (2, "b")])}, rows([(1, ""), (2, "")]).select("paper_id"), path)
    broken = rows([(1, "x"), (2, "y")])
    broken.write.parquet(f"{path}/t/version=2")  # the job died here
    broken.select("paper_id").write.parquet(f"{path}/heads/version=2")
    (tmp_path / "s/heads/version=2/_SUCCESS").unlink()  # or before the heads were complete
    assert read() == [(1, "a"), (2, "b")] and S.committed(spark, path) == [1]
    assert S.write_versioned({"t": rows([(2, "c")])}, rows([(2, "")]).select("paper_id"), path) == 2
    assert read() == [(1, "a"), (2, "c")]
    S.write_versioned({}, rows([(1, "")]).select("paper_id"), path)  # emptied
    last = S.compact(spark, path)
    assert read() == [(2, "c")]
    for v in (1, 2):  # a vacuum that stopped after the rows
        for f in (tmp_path / f"s/t/version={v}").iterdir():
            f.unlink()
        (tmp_path / f"s/t/version={v}").rmdir()
    assert read() == [(2, "c")]
    S.vacuum(spark, path, last)
    assert read() == [(2, "c")]


def test_many_replaced_ids_meet_in_a_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    df = spark.range(300).selectExpr("id AS paper_id", "id * 2 AS v")
    S.write_versioned({"t": df}, df.select("paper_id"), path)
    S.write_versioned({"t": df.where("paper_id % 3 = 0").withColumn("v", -F.col("v"))}, df.where("paper_id % 2 = 0").select("paper_id"), path)
    want = {k: (-2 * k if k % 3 == 0 else 2 * k) for k in range(300) if k % 3 == 0 or k % 2}
    for most in (10**6, 5):
        monkeypatch.setattr(S, "BROADCAST_IDS", most)
        got = S.read_versioned(spark, path, "t").collect()
        assert sorted({r.paper_id for r in got} - {k for k in range(300) if k % 3 == 0}) == [k for k in want if k % 3]
        assert all(r.v == want[r.paper_id] for r in got if r.paper_id % 3) and all(r.v == -2 * r.paper_id for r in got if r.paper_id % 6 == 0)


def test_upserts_and_reports(spark, tmp_path):
    chunks = lambda rows: spark.createDataFrame(rows, "project_id long, paper_id long, chunk_index long, text string")
    base = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, at int, v string")
    assert {r.k: r.v for r in S.upsert_latest(base, new, "k", "at").collect()} == {1: "c", 2: "b", 3: "e"}
    rows = S.to_vector_rows(chunks([(None, 1, 3, "a"), (None, 1, 5, " "), (7, 1, 9, "b")])).orderBy("chunk_index").collect()
    assert [(r.id, r.project_id) for r in rows] == [("1_0", 0), ("1_1", 7)]
    S.write_report(spark.range(1).select(F.struct(F.col("id")).alias("bench")), str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).first().value == '{"bench":{"id":0}}'


def test_bibtex_large(spark, tmp_path):
    """an entry takes time by its length, and meets the abbreviations that it uses, not all of its file."""
    body = "a, b = (c) # " * 60_000
    many = "".join(f"@string{{y{i} = {{{2000 + i}}} # z{i}}}\n@misc{{m{i}, year = Y{i} # feb, note = z{i}}}\n" for i in range(300))
    (tmp_path / "b.bib").write_text(f"@misc{{long, abstract = {{{body}}}}}\n{many}")
    (tmp_path / "c.bib").write_text("@misc{other, year = y7 # jan}\n")
    found = R.read_bibtex(spark, str(tmp_path))
    assert "map_concat" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.key: r for r in found.collect()}
    assert len(got) == 302 and got["long"].abstract == body.strip()
    assert got["m12"].fields == {"year": "2012z12February", "note": "z12"} and got["other"].year == "y7January"

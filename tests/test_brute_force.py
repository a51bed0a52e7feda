"""Queries that SQL can't express, held against plain Python over the smallest folder."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from scriptorium.functions import text as X
from scriptorium.operators import chunking as K
from scriptorium.operators import hierarchy as H
from scriptorium.operators import metadata as M
from scriptorium.operators import trends as T
from scriptorium.operators import works as W
from scriptorium.plans import bindings as B
from scriptorium.plans.registry import QUERIES
from scriptorium.plans.text_queries import marked

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text, r.source) for r in B.read(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def markdown(spark):
    return {r.paper_id: r.markdown for r in marked(spark, SF).collect()}


# cutting


def sentences(text, most=5, chars=512):
    parts = [p.strip(BLANKS) for p in re.findall(r"[^。！？.!?]*[。！？.!?]|[^。！？.!?]+\Z", text, re.S)]
    out, now, n, size = [], "", 0, 0
    for x in filter(None, parts):
        if not n:
            now, n, size = x, 1, len(x) + 1
        elif n >= most or size + len(x) > chars:
            out.append(now)
            now, n, size = x, 1, len(x)
        else:
            now, n, size = now + " " + x, n + 1, size + len(x) + 1
    return out + [now] * (n > 0)


def cleaned(text):
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = re.sub(r"[^\S\n]+", " ", re.sub(r"\n{3,}", "\n\n", text))
    return re.sub(r" ?\n ?", "\n", text).strip(" \n")


def semantic(text, size=1024, overlap=128):
    """(chunk, start, end) of the cleaned text."""
    text = cleaned(text)
    pieces = [text]
    for k, separator in enumerate(K.LADDER):
        pieces = [q for p in pieces for q in (p.split(separator) if k == 0 or len(p) > size else [p]) if q.strip(BLANKS)]
    cut = []
    for p in pieces:
        cut += [p[i : i + size] for i in range(0, max(len(p) - overlap - 1, 0) + 1, size - overlap)] if len(p) > size else [p]
    out, now = [], None
    for x in cut:
        if now is not None and (len(now) < size // 2 or len(now) + len(x) + 1 <= size):
            now += " " + x
        else:
            if now is not None:
                out.append(now.strip(BLANKS))
            now = x
    if now is not None and now.strip(BLANKS):
        out.append(now.strip(BLANKS))
    at, done = 0, []
    for c in out:
        start = max(text.find(c[:50], at), at)
        done.append((c, start, start + len(c)))
        at = max(start + len(c) - overlap, 0)
    return done


def test_sentence_chunks(spark, texts):
    want = [(d, i, md5(c)) for d, (t, _) in texts.items() for i, c in enumerate(sentences(t))]
    assert rows(QUERIES["txt04_sentence_chunks"](spark, SF), "paper_id", "chunk_index", "text_md5") == sorted(want, key=repr)


def test_semantic_chunks(spark, texts):
    want = [(d, i, a, b, md5(c)) for d, (t, _) in texts.items() for i, (c, a, b) in enumerate(semantic(t))]
    assert rows(QUERIES["txt02_semantic_chunks"](spark, SF), "paper_id", "chunk_index", "start", "end", "text_md5") == sorted(want, key=repr)


def formulas(t):
    return len(re.findall(r"(?s)\$\$.+?\$\$", t)), len(re.findall(r"(?<!\$)\$(?!\$)(?!\s).+?(?<!\s)\$(?!\$)", t))


def test_markdown_metadata(spark, markdown):
    want = []
    for d, t in markdown.items():
        title = re.search(r"(?m)^#\s+(.+)$", t)
        title = title[1].strip(BLANKS) if title else ""
        heads = [x for _, x in re.findall(r"(?m)^(#{1,3})\s+(.+)$", t) if x.strip(BLANKS)]
        formula = bool(re.search(r"(?s)\$\$.+?\$\$", t) or re.search(r"(?<!\$)\$(?!\$)(?!\s).+?(?<!\s)(?<!\$)\$(?!\$)", t))
        want.append((d, title or None, len(heads), bool(re.search(r"\|.+\|.+\|", t)), formula, bool(re.search(r"!\[.*?\]\(.*?\)", t))))
    assert rows(QUERIES["txt07_markdown_metadata"](spark, SF), "paper_id", "title", "sections", "has_tables", "has_formulas", "has_figures") == sorted(want, key=repr)


def test_structure_score(spark, markdown):
    want = []
    for d, t in markdown.items():
        kind = ("simple", "formula_heavy", "table_heavy", "dual_column", "scan")[d % 5]
        heads, tables = len(re.findall(r"(?m)^#{1,3}\s+.+$", t)), len(re.findall(r"(?m)^\|(?:\s*:?-{3,}:?\s*\|)+$", t))
        blocks, inline = formulas(t)
        odd = len(regex.sub(r"[\x00-\x7F\p{L}\p{N}\p{P}\p{S}\p{M}\p{Z}]", "", t)) / max(len(t), 1)
        per_page = len(t) / 2
        bonus = {
            "simple": 15, "formula_heavy": 20 if blocks >= 3 else 10 if blocks + inline else 0, "table_heavy": 20 if tables else 0,
            "dual_column": 20 if heads >= 3 and per_page >= 500 else 10 if heads >= 2 else 0, "scan": 20 if per_page >= 200 else 10 if per_page >= 50 else 0,
        }[kind]
        score = 20 + (15 if heads >= 2 else 8 if heads else 0) + (15 if odd <= 0.05 else 8 if odd <= 0.15 else 0) + (15 if per_page >= 300 else 8 if per_page >= 100 else 0) + bonus
        want.append((d, kind, float(min(score, 100)) if t.strip(BLANKS) else 0.0, heads, tables, blocks + inline))
    assert rows(QUERIES["txt33_structure_score"](spark, SF), "paper_id", "category", "score", "headings", "tables", "formulas") == sorted(want, key=repr)


# sections, parents and children


def reference_like(t, head=400):
    trim = BLANKS + "\x1c\x1d\x1e\x1f\x85\xa0  　"
    lines = [x for x in (y.strip(trim) for y in re.split(r"\r\n|[\n\r]", t)) if x]
    hits = sum(any(re.search(p, x) for p in X.REFERENCE_ENTRIES) for x in lines)
    return bool(re.search(X.REFERENCE_HEADING, t[:head])) or (hits >= 3 and hits >= 0.2 * len(lines))


def packed(t, most=2000):
    done, now = [], ""
    for p in re.split(r"\n{2,}", t):
        if now and len(now) + len(p) + 2 > most:
            done.append(now.strip(BLANKS))
            now = p
        else:
            now = p if not now else now + "\n\n" + p
    if now.strip(BLANKS):
        done.append(now.strip(BLANKS))
    return [q for s in done for q in ([s[i : i + most] for i in range(0, len(s), most)] if len(s) > most else [s]) if q.strip(BLANKS)]


def segments(sections):
    """(paper, nr) to [(seg, id, text, start, end)]."""
    out = {}
    for s in sections:
        if re.search(X.REFERENCE_HEADING, s.text[:400]) or reference_like(s.text):
            continue
        parts, at, found = [s.text] if len(s.text) <= 2000 else packed(s.text), 0, []
        for k, p in enumerate(parts):
            start = max(s.text.find(p, at), at)
            found.append((k, f"{s.paper_id}_p{s.nr}" + (f"_{k}" if len(parts) > 1 else ""), p, start, start + len(p)))
            at = start + len(p)
        out[s.paper_id, s.nr] = found
    return out


def children(sections, segs, pages):
    """paper to [(text, parent, anchor, page)] in order."""
    out = defaultdict(list)
    for s in sorted(sections, key=lambda s: (s.paper_id, s.nr)):
        body = s.text.strip(BLANKS)
        if reference_like(s.text) or not body or not (s.is_leaf or len(body) >= 20):
            continue
        for c, a, b in semantic(s.text, 400, 50):
            middle, own = (a + b) / 2, segs.get((s.paper_id, s.nr), [])
            inside = [x for x in own if x[3] <= middle <= x[4]]
            share = min(max(middle / max(len(s.text), 1), 0.0), 1.0)
            page = 1 + min(pages - 1, math.floor(share * pages)) if pages > 1 and s.text else 1
            out[s.paper_id].append((c, (inside or own[-1:])[0][1] if own else None, s.anchor, page))
    return out


@pytest.fixture(scope="module")
def sections(spark):
    """As test_queries.py holds against SQL."""
    return H.section_tree(H.split_sections(marked(spark, SF))).collect()


def test_parent_segments(spark, sections):
    want = [(p, n, k, i, a, b, md5(t)) for (p, n), found in segments(sections).items() for k, i, t, a, b in found]
    assert rows(QUERIES["txt12_parent_segments"](spark, SF), "paper_id", "nr", "seg", "parent_id", "seg_start", "seg_end", "text_md5") == sorted(want, key=repr)
    assert any(k for _, _, k, *_ in want)  # some sections are cut


def test_child_chunks(spark, sections):
    want = [(p, k, parent, page, md5(c)) for p, cs in children(sections, segments(sections), 3).items() for k, (c, parent, _, page) in enumerate(cs) if parent]
    assert rows(QUERIES["txt13_child_chunks"](spark, SF), "paper_id", "child_seq", "parent_id", "page_number", "text_md5") == sorted(want, key=repr)


@pytest.fixture(scope="module")
def chunked(sections, markdown):
    """paper to its children [(seq, text, parent, anchor)], flat ones where its sections yield none."""
    out = {p: [(k, c, parent, anchor) for k, (c, parent, anchor, _) in enumerate(cs) if parent] for p, cs in children(sections, segments(sections), 1).items()}
    return {p: out.get(p) or [(k, c, None, None) for k, (c, *_) in enumerate(semantic(t, 400, 50))] for p, t in markdown.items()}


def test_hierarchical_chunks(spark, chunked):
    want = [(p, k, parent, anchor, 1, md5(c)) for p, cs in chunked.items() for k, c, parent, anchor in cs]
    assert rows(QUERIES["txt16_hierarchical_chunks"](spark, SF), "paper_id", "child_seq", "parent_id", "section_anchor", "page_number", "text_md5") == sorted(want, key=repr)


def test_prune_reference_chunks(spark, chunked):
    want = defaultdict(list)
    for p, cs in chunked.items():
        for k, (_, _, parent, _) in enumerate(x for x in cs if not reference_like(x[1])):
            if parent:
                want[parent, p].append(k)
    got = rows(QUERIES["txt18_prune_reference_chunks"](spark, SF), "parent_id", "paper_id", "children")
    assert got == sorted(((i, p, ",".join(map(str, ks))) for (i, p), ks in want.items()), key=repr)


# metadata


def held(text, parts):
    return sum(p in text for p in parts)


def squeezed(text):
    return re.sub(f"[{BLANKS}]+", " ", text).strip(" ")


def likely(t):
    low, words = t.lower(), t.split(" ")
    return (
        held(low, M.NOTICE_WORDS) < 2 and 12 <= len(t) <= 200 and len(re.findall("[0-9]", t)) / max(len(t), 1) <= 0.2 and len(words) <= 28 and not (t == low and len(t) > 80)
        and (len(words) > 2 or bool(re.search("[一-鿿]", t))) and not held(low.replace(" ", ""), M.TITLE_NOISE) and not (t.endswith(".") and len(words) > 6) and t.count(";") < 2
    )


def title_of(text):
    head = text[:5000]
    first, said = re.match(r"\s*([^\n]{12,220})\n", head), re.search(r"(?im)^title[:\s]+([^\n]{10,220})$", head)
    lines = [squeezed(x) for x in [first[1] if first else "", said[1] if said else "", *head.split("\n")[:40]]]

    def score(t):
        n = len(t.split(" "))
        return min(len(t), 160) / 40 + 2.0 * (4 <= n <= 24) + 0.6 * bool(re.search("[:-]", t)) + 0.4 * bool(re.search("[A-Z][a-z]+", t)) - 1.5 * held(t.lower(), M.NOTICE_WORDS)

    fit = [t for t in lines if likely(t)]
    return max(fit, key=score) if fit else None  # the first of equals


def authors_of(text):
    head = re.sub(r"(?is)(?:\babstract\b|摘\s*要).*", "", text[:1500])

    def valid(name):
        parts = name.split(" ")
        upper = any(regex.match(r"\p{Lu}", p) for p in parts)
        return 2 <= len(name) <= 60 and not held(name.lower(), M.AUTHOR_NOISE) and not re.search("[0-9]", name) and name.count(",") <= 1 and len(parts) <= 6 and (not re.search("[A-Za-z]", name) or upper)

    parts = lambda line: [p for p in map(squeezed, re.split(r"[,;，；]|\sand\s", line)) if valid(p)]
    named = [p for line in re.findall(r"(?i)(?:Authors?|By)[:\s]+([^\n]+)", head) for p in parts(line)]
    if not named:
        lines = [x for x in head.split("\n")[:25] if squeezed(x) and not re.search("abstract|citation|doi|keywords|introduction", x.lower())]
        named = next((p for p in map(parts, lines) if 2 <= len(p) <= 8), [])
    return list(dict.fromkeys(named))[:10]


def abstract_of(text):
    for form in M.ABSTRACT_FORMS:
        found = re.search(form, text[:5000])
        body = squeezed(found[1]) if found else ""
        cut = min([len(body)] + [k + 1 + 80 for k in (body.lower()[81:].find(e) for e in M.ABSTRACT_ENDS) if k >= 0])
        body = body[:cut].strip(" ")
        letters = len(regex.findall(r"\p{L}", body))
        starved = not re.search("[一-鿿]", body) and letters > 200 and body.count(" ") < max(10, math.floor(letters * 0.02))
        if len(body) >= 60 and not starved:
            return body[:2000]
    return None


def keywords_of(text):
    found = [re.search(form, text[:5000]) for form in M.KEYWORD_FORMS]
    parts = [p for f in found for p in re.split("[,;，；、]", f[1] if f else "")]
    return sorted({p.strip(" ") for p in parts if 2 <= len(p.strip(" ")) <= 49})[:20]


def test_extract_metadata(spark, texts):
    want = [(d, title_of(t), ";".join(authors_of(t)), abstract_of(t), ";".join(keywords_of(t))) for d, (t, _) in texts.items()]
    assert rows(QUERIES["txt26_extract_metadata"](spark, SF), "paper_id", "title", "authors", "abstract", "keywords") == sorted(want, key=repr)


def test_process_papers(spark, texts):
    """Counts of chunks against the chunks themselves; dates from the metadata; every text is completed."""
    from scriptorium.plans import metadata_queries as Q

    papers, kept, owners = M.process_papers(Q._parsed(spark, SF))
    n = Counter(r.paper_id for r in kept.select("paper_id").collect())
    got = QUERIES["txt36_process_papers"](spark, SF).collect()
    assert {r.paper_id for r in got} == set(texts)
    for r in got:
        assert r.chunk_count == n[r.paper_id] and r.skipped_chunks >= 0 and (r.status == "completed") == bool(texts[r.paper_id][0].strip(BLANKS))
        assert str(r.published) == f"{2000 + r.paper_id % 20}-01-02"
        assert r.title and (r.issues == "" or r.issues in ("sanity_text_short", "sanity_garble", "sanity_garble,sanity_text_short", "sanity_empty_output"))


# entities


def entities(text):
    out = []
    for x in (y for p in T.ENTITY_FORMS for y in re.findall(p.replace("(?U)", "").replace(r"\x{4e00}", "一").replace(r"\x{9fff}", "鿿"), text)):
        e = re.sub(f"[{BLANKS}]+", " ", x).strip(" ")
        plain, latin = e.lower().replace(" ", ""), re.search("[A-Za-z]", e)
        proper = len(e.split(" ")) <= 8 and (re.search(r"\b[A-Z]{2,}\b", e) or regex.search(r"(?:^| )\p{Lu}", e))
        if 2 <= len(e) <= 80 and e not in T.NO_ENTITIES and plain not in T.NOISE_ENTITIES and not re.search(T.NOISE_PARTS, plain) and not re.search(r"^[0-9\W_]+$", e) and (not latin or proper):
            out.append(e)
    return out


def top_entities(groups, k=30):
    """group to [(entity, count)], the most frequent first, ties in the order of UTF-8."""
    counts = {g: Counter(e for t in ts for e in entities(t)) for g, ts in groups.items()}
    return {g: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:k] for g, c in counts.items()}


def top_edges(groups, tops, k=30):
    out = {}
    for g, ts in groups.items():
        names, counts = sorted((e for e, _ in tops[g]), key=str.encode), Counter()
        for s in (s for t in ts for s in re.split(r"[.!?。！？\n]+", t)):
            present = [e for e in names if e in s] if s.strip(" ") else []
            counts.update((a, b) for i, a in enumerate(present) for b in present[i + 1 :])
        out[g] = sorted(counts.items(), key=lambda x: (-x[1], x[0][0].encode(), x[0][1].encode()))[: max(3 * k, 20)]
    return out


@pytest.fixture(scope="module")
def projects(texts):
    out = defaultdict(list)
    for t, source in texts.values():
        out[int(re.search("[0-9]+", source)[0]) % 10].append(t)
    return out


def test_entities_and_edges(spark, projects):
    tops = top_entities(projects)
    want = [(g, k + 1, e, n) for g, es in tops.items() for k, (e, n) in enumerate(es)]
    assert rows(QUERIES["trd12_extract_entities"](spark, SF), "project_id", "rank", "entity", "count") == sorted(want, key=repr)
    want = [(g, a, b, n) for g, es in top_edges(projects, tops).items() for (a, b), n in es]
    assert rows(QUERIES["trd13_cooccurrence_edges"](spark, SF), "project_id", "source", "target", "weight") == sorted(want, key=repr)


def test_project_graph(spark, projects):
    from scriptorium.plans import trend_queries as Q

    groups = {r.project_id: [r.text] for r in T.project_text(Q._statuses(spark, SF), Q._project_chunks(spark, SF)).collect()}
    tops = top_entities(groups)
    edges = top_edges(groups, tops)
    want = [(g, len(tops.get(g, [])), len(edges.get(g, [])), None if g in groups else "no text") for g in projects]
    assert rows(QUERIES["trd17_project_graph"](spark, SF), "project_id", "nodes", "edges", "message") == sorted(want, key=repr)


# works


@pytest.fixture(scope="module")
def kept_works(spark):
    """Works in turn, without those whose doi or title a kept one has."""
    seen, out = set(), []
    for w in sorted(B.works(spark, SF).collect(), key=lambda w: w.work_id):
        title = (w.title or "").strip(" ").lower()
        keys = {k for k in (("d", w.doi) if w.doi else None, ("t", title) if title else None) if k}
        if not keys & seen:
            seen |= keys
            out.append(w)
    return out


def test_dedupe_works(spark, kept_works):
    assert rows(QUERIES["ext02_dedupe_works"](spark, SF), "work_id") == sorted(((w.work_id,) for w in kept_works), key=repr)


def test_federated_search(spark, kept_works):
    words = lambda t: {x for x in re.findall("[a-z0-9]{2,}|[一-鿿]{2,}", (t or "").lower())} - set(W.QUERY_STOP_WORDS)
    have = [(w, words(w.title), words(w.abstract), words(f"{w.title} {w.abstract}"), f"{w.title} {w.abstract}".lower()) for w in kept_works]
    want = []
    for q in B.benchmark_queries(spark, SF).collect():
        text = q.query.strip(" ")
        low = text.lower()
        more = ["retrieval augmented generation large language model"] * bool(re.search(r"\brag\b", low)) + ["autonomous agents planning tool use"] * ("agentic" in low and "rag" in low) + ["survey review"] * ("综述" in text or "survey" in low)
        asked = words(" ".join([text, *more]))
        found = []
        for w, in_title, in_abstract, in_both, both in have:
            if not asked & in_both or ((any(a in low for a in W.AI_TERMS) or asked & set(W.AI_TERMS)) and held(both, W.NOISE_TERMS) >= 2):
                continue
            score = 0.55 * len(asked & in_title) / len(asked) + 0.28 * len(asked & in_abstract) / len(asked) + 0.08 * ("retrieval augmented generation" in both) + 0.08 * ("agentic rag" in both or "agentic retrieval augmented generation" in both)
            score = min(score + min(math.log1p(w.citation_count) / 20, 0.15) + 0.05 * (w.year >= 2021) + 0.03 * (w.abstract != ""), 1.0)
            found.append((-round(score, 6), -w.citation_count, -w.year, w.work_id, score))
        good = [f for f in found if f[-1] >= 0.06]
        ranked = sorted(good) if good else sorted(found, key=lambda f: f[1:4])
        want += [(q.query_id, k + 1, f[3], f[-1]) for k, f in enumerate(ranked[:10])]
    got = sorted(rows(QUERIES["ext13_federated_search"](spark, SF), "query_id", "rank", "work_id", "relevance"))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, sorted(want)))


def test_semantic_chunks_of_a_long_text(spark):
    """Time follows the length of a text, not its length times its chunks; blank, null and odd texts keep their rows."""
    import time

    text = " ".join(f"w{i:07d}" for i in range(700_000))
    begun = time.monotonic()
    got = K.semantic_chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n\x0b"), (4, "字" * 1025)], "paper_id long, text string"), 1024, 128).collect()
    assert time.monotonic() - begun < 45
    one = [r for r in got if r.paper_id == 1]
    assert all(text[r.start : r.end] == r.text for r in one) and len(one) == -(-700_000 // 113) and one[-1].end == len(text)
    assert [(r.paper_id, r.chunk_index, r.start, r.end) for r in got if r.paper_id > 1] == [(4, 0, 0, 1024), (4, 1, 896, 1025)]


def test_children_are_cut_once(spark):
    """What children and flat chunks are made of is cut once: afterwards only papers without children are left to cut."""
    docs = spark.createDataFrame([(1, "# A\nsome words\n# B\nmore words"), (2, "References\nnone")], "paper_id long, markdown string")
    children = H.hierarchical_chunks(docs)[0]
    assert children._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.paper_id, r.child_seq, r.parent_id is None) for r in children.collect()) == [(1, 0, False), (1, 1, False), (2, 0, True)]

"""Aligned tokens against a plain reading of the contract."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as PT
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import alignment as L

A, B = PT.path("byte_bpe_50k.json"), PT.path("piece_bpe_32k.model")
ODD = ["", " ", " lead", "trail ", "two  spaces", "a\nb c", "tab\tx", "a▁b", "<|endoftext|> and <s> x", "漢字 かな é", "a b", "x\x00y z", "isn't it", "🙂 🙂 🙂", "a\r\n\r\nb", "<0x41> <unk>", "é ﬁ"]


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), byte_table()


def groups_of(text, tools):
    """[(A ids, B ids)], [linked pairs], or nothing"""
    t, sp, byte = tools
    if not text:
        return [], []
    data = (" " + text).encode()
    a = [(k, bytes(byte[c] for c in t.id_to_token(k))) for k in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(text)]
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return [], []
    # the token of each byte, by its place; two tokens that share a byte are linked
    of = [[k for k, (_, x) in enumerate(tokens) for _ in x] for tokens in (a, b)]
    links = [(a[i][0], b[j][0]) for i, j in dict.fromkeys(zip(*of))]
    groups, now = [], (set(), set())
    for k, (i, j) in enumerate(zip(*of)):
        now[0].add(i), now[1].add(j)
        if k + 1 == len(data) or (of[0][k + 1] != i and of[1][k + 1] != j):  # both end here
            groups.append(([a[x][0] for x in sorted(now[0])], [b[x][0] for x in sorted(now[1])]))
            now = (set(), set())
    return groups, links


def expected(rows, tools):
    known = {k: groups_of(t, tools) for k, t in enumerate(rows)}
    held = Counter(p for _, links in known.values() for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for k, (groups, links) in known.items():
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_documents(spark, docs, tools):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10**6 + k, x) for k, x in enumerate([*ODD, None, "one", "one"])] + [(None, "one word"), (3, "one word")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, n_a string, `a.b` int").repartition(5)
    want = Counter((k, *x) for (k, _), x in zip(rows, expected([t for _, t in rows], tools)))
    assert Counter((r.doc_id, *[r[c] for c in NAMES]) for r in L.alignment_report(df, A, B).collect()) == want


def test_small_blocks_and_split_pairs(spark, docs, monkeypatch):
    """The same rows with many blocks, and with the rows of a pair dealt over several keys."""
    one = Counter(map(tuple, L.alignment_report(docs, A, B).collect()))
    monkeypatch.setattr(L, "PAIR_ROWS", 2)
    assert Counter(map(tuple, L.alignment_report(docs.repartition(9), A, B).collect())) == one


def test_no_rows(spark, docs):
    assert L.alignment_report(docs.limit(0), A, B).collect() == []
    assert [r.n_a for r in L.alignment_report(docs.limit(2).selectExpr("doc_id", "cast(null as string) text"), A, B).collect()] == [0, 0]


def test_very_long_text(spark):
    text = "word " * 120_000 + "end " + "x" * 50_000
    (r,) = L.alignment_report(spark.createDataFrame([("k", text)], "doc_id string, text string"), A, B).collect()
    assert r.doc_id == "k" and r.n_a > 120_000 and r.n_groups > 120_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢'.1 \n\t\x00▁ <s>", max_size=25), min_size=1, max_size=5))
def test_words_have_the_alignment_of_texts(tools, texts):
    found = L.aligner(A, B).block(pa.array(texts))
    want = expected(texts, tools)
    assert [tuple(int(found[c][k]) for c in NAMES[:4]) + (found["groups_sha256"][k],) for k in range(len(texts))] == [w[:4] + w[6:] for w in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_coalesced_intervals(a, b):
    total = max(sum(a), sum(b))
    a, b = ([*x, total - sum(x)] if sum(x) < total else x for x in (a, b))
    ga, gb, la, lb = L.coalesced(np.cumsum(a), np.cumsum(b))
    ea, eb = np.cumsum(a), np.cumsum(b)
    both = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert ga.tolist() == np.searchsorted(both, ea).tolist() and gb.tolist() == np.searchsorted(both, eb).tolist()
    assert list(zip(la.tolist(), lb.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]]

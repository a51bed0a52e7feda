"""Suffix dedup and near-dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import near_dup as N
from scriptorium.llm import suffix_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, length):
    """Of each (key, bytes): covered bytes, runs and what is left."""
    seen = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1]))
        out.append((key, len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, z in zip(b, cover) if not z)).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_suffix_dedup(docs, texts, edges, empty):
    assert answer(S.suffix_dedup_report(docs)) == removed([(k, t.encode()) for k, t in texts.items()], 400)
    from edge_rows import EDGES

    rows = [(d, (t or "").encode()) for d, t, *_ in EDGES]
    assert answer(S.suffix_dedup_report(edges)) == removed(rows, 400)
    assert answer(S.suffix_dedup_report(edges, 30, 20, 8)) == removed(rows, 30)
    assert S.suffix_dedup_report(empty).count() == 0


def test_suffix_dedup_hot_anchors(spark, monkeypatch):
    """Anchors with many kinds of runs take the other way, with the same result."""
    monkeypatch.setattr(S, "HOT_RUNS", 1)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcde"), 4))
    common = " ".join(word() for _ in range(20))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 9)))) + " " + common + " " + word()) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(S.suffix_dedup_report(df, 40, 24, 10)) == removed([(k, t.encode()) for k, t in rows], 40)


def test_stretches_of_hot_anchors_are_named_once():
    """A row a stretch, whose name of LENGTH bytes is null where it has fewer."""
    rng = np.random.default_rng(6)
    blobs = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (450, 300, 240)]
    batch = pa.RecordBatch.from_pydict({"anchor": [1, 1, 1], "run": [1, 2, 3], "place": ["a", "b", "c"], "span": [144, 30, 9], "bytes": blobs})
    out = pa.Table.from_batches(S._named_stretches(400, 240)([batch])).to_pydict()
    assert Counter(out["place"]) == {"a": 145, "b": 31, "c": 1}
    assert [k for k, x in enumerate(out["full1"]) if x is not None] == list(range(51))
    assert len(set(zip(out["near1"], out["near2"]))) == 177


def test_later_copies(spark):
    """Of two copies the first keeps its bytes, and n_later of the second is all."""
    text = "x".join(str(i) for i in range(300))
    rows = {r.doc_id: r.n_later for r in S.suffix_dedup_report(spark.createDataFrame([(2, text), (1, text), (3, "y" + text[:600])], "doc_id long, text string")).collect()}
    assert rows == {1: 0, 2: len(text), 3: 600}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(1, 6), st.integers(0, 9))
def test_factors_against_a_naive_suffix_array(blobs, short, more):
    """Longest previous factors and longest matches, capped at length, against all suffixes held against each other."""
    length = short + more
    blobs = [b for b in blobs if len(b) >= short]
    if not blobs:
        return
    data, which, at, where, left = S._stretches(blobs, [len(b) for b in blobs], short)
    order, common = S.suffix_order(data, where, left, length, short)
    suffixes = [blobs[w][a : a + length] for w, a in zip(which, at)]
    shares = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    inside = [suffixes[i] for i in order]
    assert all(shares(a, b) == c for a, b, c in zip(inside, inside[1:], common[1:]))
    got = dict(zip(order.tolist(), zip(*S.longest_previous_factors(order, common))))
    for i, x in enumerate(suffixes):
        earlier = max((shares(x, y) for y in suffixes[:i]), default=0)
        longest = max((shares(x, y) for j, y in enumerate(suffixes) if j != i), default=0)
        lpf, most = got.get(i, (0, 0))
        assert (lpf if lpf >= short else 0) == (earlier if earlier >= short else 0) and (most if most >= short else 0) == (longest if longest >= short else 0)


def test_passages(spark):
    """A passage of more than 50 words is found in both its texts though it has under 400 bytes; what stands alone isn't."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 7)))) for _ in range(n))
    passage = prose(60)
    assert 240 < len(passage) < 400
    rows = [(1, prose(40) + " " + passage + " " + prose(30)), (2, prose(7) + " " + passage), (3, prose(200)), (4, prose(50) + " " + " ".join(passage.split()[:46]))]
    got = {r.doc_id: r for r in S.suffix_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0] * 4
    assert [got[k].repeats for k in (1, 2, 3, 4)] == [True, True, False, False] and got[1].passage_words in (59, 60)
    assert got[1].longest_previous == 0 and got[2].longest_previous >= len(passage)


def sets_of(texts):
    out = {}
    for key, t in texts:
        w, n = WORD.findall(t or ""), Counter()
        shingles = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        # the second time that a shingle occurs it is another element, so that sizes are sums of weights
        out[key] = frozenset((s, n.update([s]) or n[s]) for s in shingles)
    return out


def classes(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and both:
                parent[find(a)] = find(b)
    out = defaultdict(set)
    for k in keys:
        out[find(k)].add(k)
    return {frozenset(v) for v in out.values()}


def test_near_duplicates(docs, texts, empty):
    got = defaultdict(set)
    for r in N.near_dup_report(docs).collect():
        got[r.class_id].add(r.doc_id)
        assert r.class_size >= 1
    assert {frozenset(v) for v in got.values()} == classes(sets_of(texts.items()))
    assert N.near_dup_report(empty).count() == 0


def test_near_duplicates_around_a_centre(spark):
    """Copies with few and with many changed words: some are only similar to each other."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for place in rng.choice(15, int(rng.integers(0, 5)), replace=False):
            words[int(place) * 10] = f"x{int(rng.integers(0, 3))}"
        rows.append((k, " ".join(words)))
    got = defaultdict(set)
    for r in N.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == classes(sets_of(rows))


def test_near_duplicates_around_a_centre_without_id(spark):
    """Copies that are only similar to one without doc_id, which holds their class together."""
    base = [f"w{i}" for i in range(150)]
    rows = [(None, " ".join(base))]
    for k in range(6):
        words = list(base)
        for place in (20 * k + 5, 20 * k + 15):
            words[place] = f"x{k}"
        rows.append((k, " ".join(words)))
    sets = sets_of(rows)
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(share(None, k) >= 0.8 and share(k, j) < 0.8 for k in range(6) for j in range(k))
    got = {(r.doc_id, r.class_id, r.class_size) for r in N.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, 0, 7) for k in (None, *range(6))}


def test_near_duplicate_edges(edges):
    out = N.near_dedup(edges)
    assert out.columns == edges.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids.count(4) == 1 and 5 not in ids and 2 not in ids  # null, empty and blank texts are one class
    assert N.near_dup_report(edges).count() == edges.count()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        n = 300
        k = round(n * 2 * share / (1 + share))
        common = rng.integers(0, 2**63, k).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, n - k).astype(np.uint64)]) for _ in range(2))
        s = N.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 3000)
        assert abs((s[0] == s[1]).mean() - k / (2 * n - k)) < 0.04


def test_signatures_of_unequal_weights():
    """The share of equal coordinates against the weighted Jaccard similarity, for weights in and above the strips."""
    rng = np.random.default_rng(2)
    elements = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    for scale in (1.0, 6.0, 70.0):
        a, b = (rng.random(200) * scale + 0.05 for _ in range(2))
        s = N.signatures(np.concatenate([elements, elements]), np.array([0, 200, 400]), 4000, np.concatenate([a, b]))
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035
    one = N.signatures(elements, np.array([0, 200]), 500, np.full(200, 3.0))
    assert np.isfinite(one).all() and len(np.unique(one)) > 450


def test_repeated_shingles_count(spark):
    """Two texts of the same shingles, which one of them has far more often, are no near copies."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, " ".join([base] * 3)), (3, " ".join([base] * 3) + " w0")]
    got = {r.doc_id: r.class_id for r in N.near_dup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_shingles_of_odd_texts():
    elements, weights, begins = N.weighted_shingles(pa.array(["", None, " a ", "a b c d e", "a b c d e f", "a b c d e a b c d e"]))
    assert np.diff(begins).tolist() == [0, 0, 1, 1, 2, 5] and sum(weights[begins[5] : begins[6]]) == 6
    assert elements[begins[3]] in elements[begins[4] : begins[5]]

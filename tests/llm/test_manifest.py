"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from scriptorium.llm import merkle as M
from scriptorium.llm.common import stored

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES])


def tree(level):
    """(top, siblings of each leaf as (left, right) steps)"""
    steps, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            other = level[p ^ 1] if p ^ 1 < len(level) else ""
            steps[k].append((other, "") if p & 1 else ("", other))
            at[k] = p >> 1
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], steps


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        parts.append((own, *tree([leaf(r) for r in own])))
    root, above = tree([p[1] for p in parts])
    out = []
    for (own, subroot, steps), more in zip(parts, above):
        for r, s in zip(own, steps):
            proof = s + more
            tampered = dict(r)
            if r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                tampered["n_chars"] += 1
            now = leaf(tampered)
            for left, right in proof:
                now = h(left, now, right)
            out.append((str(r["doc_id"]), leaf(r), subroot, root, h(*[x for step in proof for x in step]), now, now == root))
    return sorted(out)


def found(docs):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in M.manifest_report(docs).collect())


def test_manifest_of_documents(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    got = found(docs)
    assert got == expected(rows) and any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("bits,digits", [(1, 2), (2, 1), (1, 3), (5, 2)])
def test_tiers_of_blocks(spark, bits, digits):
    """Trees of all sizes up to several tiers of blocks, with proofs that fold to the root."""
    sizes = [1, 2, 3, 4, 5, 8, 9, 15, 16, 17, 33]
    rows = [(f"l{n:02d}", k, h(f"{n}.{k}"), k) for n in sizes for k in range(n)]
    leaves = stored(spark.createDataFrame(rows, "lang string, at long, leaf string, payload long"))
    out = M.manifest(leaves, "lang", ["at"], bits, digits).collect()
    tops, steps = {}, {}
    for n in sizes:
        tops[n], s = tree([h(f"{n}.{k}") for k in range(n)])
        steps |= {(tops[n], k): x for k, x in enumerate(s)}
    root, above = tree([tops[n] for n in sizes])
    more = dict(zip([tops[n] for n in sizes], above))
    assert len(out) == len(rows) and {r.root for r in out} == {root}
    for r in out:
        assert [(s.left or "", s.right or "") for s in r.proof] == steps[r.subroot, r.payload] + more[r.subroot]


def test_odd_rows(spark, edges, empty):
    odd = edges.selectExpr("*", "case doc_id when 1 then null when 2 then 9223372036854775807 else 5 end as n_chars")
    odd = odd.unionByName(odd.where("doc_id = 4"))  # four equal rows
    rows = [r.asDict() for r in odd.collect()]
    assert found(odd) == expected(rows)
    assert found(odd.where("doc_id = 1"))[0][1] == found(odd.where("doc_id = 1"))[0][3]  # a lone leaf is the root
    assert M.manifest_report(odd.limit(0)).collect() == []


def test_a_changed_row_changes_the_root(spark, docs):
    one = {r.root for r in M.manifest_report(docs).collect()}
    other = docs.selectExpr("doc_id", "source", "lang", "n_chars", "case doc_id when 7 then concat(text, ' ') else text end as text")
    assert len(one) == 1 and one != {r.root for r in M.manifest_report(other).collect()}


def test_ranks_of_a_hot_group_and_ties(spark):
    rows = [("a" if k % 10 else "b", k // 50, k) for k in range(3000)]
    df = stored(spark.createDataFrame(rows, "g string, at long, k long").repartition(7))
    out = M.ordered_ranks(df, "g", ["at"]).collect()
    for g in "ab":
        own = sorted((r.rank, r["at"]) for r in out if r.g == g)
        assert [r for r, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
        assert {r.n for r in out if r.g == g} == {len(own)}

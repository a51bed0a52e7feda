"""Token files, media, packing and toxicity."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import matroska as M
from scriptorium.llm import packing as P
from scriptorium.llm import token_codec as C
from scriptorium.llm import toxicity as T
from scriptorium.llm.tokens import Encoder

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def encoded(path, rows, end):
    found = Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [(k, np.array(e.ids + [end], "<u4")) for (k, _), e in zip(rows, found)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢'.1 \n\t\x00 ", max_size=30), min_size=1, max_size=5))
def test_pieces_have_the_ids_of_texts(path, texts):
    ids, begins = Encoder(path).encode(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [e.ids for e in want]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=300), st.integers(1, 70), st.sampled_from([1, 700, 2**24]))
def test_blocks_round_trip(ids, block, factor):
    ids = np.array(ids, np.uint32) * np.uint32(factor)
    assert C.decode_blocks(C.encode_blocks(ids, block)).tolist() == ids.tolist()


def test_damaged_blocks_are_refused():
    data = bytearray(C.encode_blocks(np.arange(500, dtype=np.uint32) % 7, 100))
    for at in (0, 9, 40, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(C.Damaged):
            C.decode_blocks(bytes(bad))
    with pytest.raises(C.Damaged):
        C.decode_blocks(bytes(data[:-3]))


def test_predictable_ids_shrink():
    ids = np.tile(np.arange(40, dtype=np.uint32) * 1000, 100)
    assert len(C.encode_blocks(ids)) < 0.3 * 2 * len(ids)


@pytest.mark.parametrize("table,column", [("documents", "text"), ("pages", "html")])
def test_fewer_bits_than_order_0(table, column):
    """The coded ids take fewer bits than their plain order-0 entropy, models and checksums included."""
    import duckdb

    rows = duckdb.connect().execute(f"SELECT {column} FROM '/root/testdata/sf0.01/{table}.parquet' LIMIT 500").fetchall()
    ids = np.concatenate([x for _, x in encoded(WORDS, [(0, r[0]) for r in rows], 2)])
    data = C.encode_blocks(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits, entropy = 8 * len(data) / len(ids), -(share * np.log2(share)).sum()
    print(f"{table}: {len(ids)} ids, {bits:.2f} bits an id, order-0 entropy {entropy:.2f}")
    assert bits < entropy and (C.decode_blocks(data) == ids).all()


def test_blocks_without_pairs_and_of_one_id():
    for ids in ([5], [2**32 - 1, 0], list(range(3000)), [7] * 5000):
        ids = np.array(ids, np.uint32)
        assert (C.decode_blocks(C.encode_blocks(ids, 700)) == ids).all()


def test_token_files(docs, texts, edges, empty):
    rows, at, want = sorted(texts.items()), 0, {}
    for k, ids in encoded(WORDS, rows, 2):
        want[k] = (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in C.token_file_report(docs, WORDS).collect()} == want
    from edge_rows import EDGES

    got = sorted((tuple(r) for r in C.token_file_report(edges, WORDS).select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((d for d, *_ in EDGES), key=lambda d: (d is None, d))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    assert C.token_file_report(empty, WORDS).count() == 0


def test_media_report(docs, texts, edges, empty):
    for rows, text_of in ((M.media_report(docs).collect(), texts.get), (M.media_report(edges).collect(), dict((d, t) for d, t, *_ in __import__("edge_rows").EDGES).get)):
        for r in rows:
            b = (text_of(r.doc_id) or "").encode()
            p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert "cues=" in r.feature and r.media_bytes > r.payload_bytes
    assert M.media_report(empty).count() == 0


def element(kind, body):
    return M._element(kind, body)


def file_of(blocks, group=b""):
    track = M._unsigned(M.TRACK_NUMBER, 1) + M._unsigned(M.TRACK_TYPE, 2) + element(M.CODEC, b"A_X") + M._unsigned(M.DEFAULT_DURATION, 1_000_000)
    cluster = M._unsigned(M.TIMESTAMP, 5) + b"".join(element(M.SIMPLE_BLOCK, b) for b in blocks) + group
    return element(M.EBML, b"") + element(M.SEGMENT, element(M.TRACKS, element(M.TRACK, track)) + element(M.CLUSTER, cluster))


def test_lacing_of_every_kind(spark):
    frames = [b"a" * 300, b"b" * 10, b"c" * 20]
    body = b"".join(frames)
    xiph = b"\x81" + struct.pack(">hB", 2, 0x82) + bytes([2, 255, 45, 10]) + body
    # sizes 300, then 10 - 300 as a signed number of two bytes around 2^13 - 1
    ebml = b"\x81" + struct.pack(">hB", 3, 0x86) + bytes([2]) + struct.pack(">H", 0x4000 | 300) + struct.pack(">H", 0x4000 | (10 - 300 + 8191)) + body
    fixed = b"\x81" + struct.pack(">hB", 4, 0x04) + bytes([2]) + b"xxyyzz"
    plain = element(M.BLOCK_GROUP, element(M.BLOCK, b"\x81" + struct.pack(">hB", -1, 0) + b"q") + element(M.REFERENCE, b"\x01"))
    data = file_of([xiph, ebml, fixed], plain)
    got = M.parse(data)["packets"]
    assert [data[p[2] : p[2] + p[3]] for p in got] == [*frames, *frames, b"xx", b"yy", b"zz", b"q"]
    assert [p[5] for p in got] == ["xiph"] * 3 + ["ebml"] * 3 + ["fixed"] * 3 + ["none"]
    assert [p[1] // 1_000_000 for p in got] == [7, 8, 9, 8, 9, 10, 9, 10, 11, 4]
    assert [p[4] for p in got] == [True] * 6 + [False] * 4
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-2])), (3, bytearray(b"no")), (4, None)], "name int, media binary")
    rows = M.packets(files, "name").collect()
    assert Counter((r.name, r.error is None) for r in rows) == {(1, True): 10, (2, False): 1, (3, False): 1, (4, False): 1}


def test_unknown_sizes():
    body = M._unsigned(M.TIMESTAMP, 1) + element(M.SIMPLE_BLOCK, b"\x81\x00\x00\x80zz")
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    assert len(M.parse(data)["packets"]) == 2


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_closest_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= room}
    chosen = P.closest(counts, room)
    assert sum(k * n for k, n in chosen) == max(sums) and all(n <= counts[k] for k, n in chosen)


def test_packing(docs, texts, edges, empty):
    from edge_rows import EDGES

    for df, rows in ((docs, sorted(texts.items())), (edges, [(d, t) for d, t, *_ in EDGES])):
        ids = defaultdict(list)
        for k, x in encoded(BYTES, rows, 1):
            ids[k].append(x)
        out = P.pack_documents(df, BYTES).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in out:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
            assert any(zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        assert {k: sum(r.length for r in v) for k, v in pieces.items()} == {k: sum(map(len, v)) for k, v in ids.items()}
        for v in sequences.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= P.WINDOW
        total = sum(len(x) for v in ids.values() for x in v)
        assert len(sequences) <= total / P.WINDOW + 2
    assert P.pack_documents(empty, BYTES).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right, toxic = sum(r.predicted == r.toxic for r in rows), [r for r in rows if r.toxic]
    recall = sum(r.predicted for r in toxic) / len(toxic)
    print(f"held out: {len(rows)} rows, accuracy {right / len(rows):.3f}, recall {recall:.3f}")
    assert right >= 0.95 * len(rows) and recall >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and abs(r.ll_toxic - r.ll_ordinary - r.ratio) < 1e-9 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_kneser_ney_against_brute_force(spark):
    """Counts, steps, what speaks and pairs, each against plain Python over the same texts."""
    rng = np.random.default_rng(6)
    usual = ["alpha", "beta", "gammas", "deltas", "shuttle", "upper", "shut", "up", "alphabet", "betas"]
    rows = []
    for k in range(400):
        words = list(rng.choice(usual, 12))
        if k % 4 == 0:  # a stem with odd endings, and a pair of usual words
            words[3] = "grubwort" + "abcdefgh"[k % 8]
            words[6:8] = ["shut", "up"]
        rows.append((k, " ".join(words), int(k % 4 == 0) if k < 320 else None))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marked = spark.createDataFrame([(k, x) for k, _, x in rows if x is not None], "doc_id long, toxic long")
    words, pairs = T.counts(docs, marked)
    n, t, every, pn, pt = ([Counter(), Counter()], [Counter(), Counter()], set(), [Counter(), Counter()], [Counter(), Counter()])
    for _, text, toxic in rows:
        w = text.split()
        every.update(set(w))
        if toxic is not None:
            n[toxic].update(w), t[toxic].update(set(w)), pn[toxic].update(zip(w, w[1:])), pt[toxic].update(set(zip(w, w[1:])))
    assert {r.word: (r.n0, r.n1, r.t0, r.t1) for r in words.collect()} == {w: (n[0][w], n[1][w], t[0][w], t[1][w]) for w in every}
    known_pairs = {p for p in pt[1] if pt[1][p] >= T.LEAST}
    assert {(r["first"], r.second): (r.n0, r.n1, r.t0, r.t1) for r in pairs.collect()} == {p: (pn[0][p], pn[1][p], pt[0][p], pt[1][p]) for p in known_pairs}

    way = lambda w: [w[:k] for k in T.STEPS if k < len(w)] + [w + " "]
    total, types = defaultdict(lambda: np.zeros(2)), set()
    counts = [Counter(), Counter(), Counter()]  # of (beginning, what follows) in either class and in both
    for w in every:
        for up, key in zip(["", *way(w)], way(w)):
            total[key] += (t[0][w], t[1][w])
            types.add((up, key[len(up) :]))
            for c, k in enumerate((n[0][w], n[1][w], n[0][w] + n[1][w])):
                counts[c][up, key[len(up) :]] += k
    total[""] = sum(np.array([t[0][w], t[1][w]]) for w in every)

    # the textbook's formula: max(c(h x) - D, 0) / c(h) + D * N1+(h .) / c(h) * N1+(. x) / N1+(. .)
    before, among = Counter((len(up), x) for up, x in types), Counter(len(up) for up, _ in types)

    def kneser_ney(count, up, x):
        lower = before[len(up), x] / among[len(up)]
        seen = [k for (u, _), k in count.items() if u == up and k > 0]
        return max(count[up, x] - 0.75, 0) / sum(seen) + 0.75 * len(seen) / sum(seen) * lower if seen else lower

    for c in range(3):
        for up in {up for up, _ in types}:
            assert np.isclose(sum(kneser_ney(counts[c], up, x) for size, x in before if size == len(up)), 1)

    def gain(ones, zeros, of1, of0):
        q, m = of1 / (of1 + of0), ones + zeros
        return sum(k * np.log(k / (m * x)) for k, x in ((ones, q), (zeros, 1 - q)) if k and x)

    want = {}
    for up, x in types:
        key = up + x
        if counts[2][up, x] >= T.LEAST:
            both = all(sum(k for (u, _), k in counts[c].items() if u == up) for c in (0, 1))
            want[key] = (*(kneser_ney(counts[c], up, x) for c in range(3)), gain(total[key][1], total[key][0], total[up][1], total[up][0]) if both else 0.0)
    known = C.stored(T.steps(words))
    got = {r.key: (r.p0, r.p1, r.shared, r.gain) for r in known.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)

    def fold(keys):
        lp0 = lp1 = rest = 0.0
        for k in keys:
            if k in want:
                p0, p1, share, g = want[k]
                if g >= (T.GAIN_BELOW if lp0 != lp1 else T.GAIN):
                    lp0, lp1 = lp0 + np.log(p0), lp1 + np.log(p1)
                else:
                    rest += np.log(share)
        return lp0, lp1, rest

    speaks = {r.key: (r.lp0, r.lp1) for r in T.speaking(known).collect()}
    model = T.Model(T.speaking(known).toPandas(), T.speaking_pairs(pairs, known).toPandas())
    assert "gru" in speaks and not any(k.startswith("alph") for k in speaks)
    for w in every:
        assert np.allclose(T.word_logs(pa.array([w]), model)[0], fold(way(w))[:2])
    found = {(r["first"], r.second): (r.lp0, r.lp1) for r in T.speaking_pairs(pairs, known).collect()}
    assert ("shut", "up") in found
    for (v, w), logs in found.items():
        taken = lambda c, x: max(pn[c][x] - 0.75, 0) / max(n[c][x[0]], 1)
        left = [max(1 - sum(taken(c, x) for x in known_pairs if x[0] == v), 1e-6) for c in (0, 1)]
        lp = fold(way(w))
        assert np.allclose(logs, [np.log(taken(c, (v, w)) * np.exp(-lp[2]) + left[c] * np.exp(lp[c])) for c in (0, 1)])
    # the pair says more than its words alone
    together, apart = (T.worst_windows(pa.array([x]), model)[0] for x in ("they shut up now", "up they shut now"))
    assert together[1] - together[0] > apart[1] - apart[0] + 0.01


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(6, 1), (7, 0), (8, 0), (99, 1), (None, 1), (10, None)], "doc_id long, toxic int")
    rows = T.toxicity_report(edges, labels).collect()
    assert len(rows) == edges.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert T.toxicity_report(empty, labels).count() == 0
    none = T.toxicity_report(edges, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none < 0.5

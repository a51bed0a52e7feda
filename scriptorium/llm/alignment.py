"""Alignment of the tokens of two tokenizers by coalescing their byte intervals.

A and B cut the same bytes in two ways. All tokens of both are sorted by start;
where a start reaches the running maximum of the ends before it, a group begins.
Inside a group, tokens whose intervals overlap are linked. Pairs of ids are
counted over the documents that link them, first inside a block of documents,
then over all blocks; counts come back to a block as one row for each of its
pairs, never to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import stored, text_slices

#: White space next to white space or at an end, NUL, and B's mark of a space: such texts are encoded whole, others word by word.
_ODD = r"^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]\z|[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\x00|\x{2581}"
#: Distinct words, of how many characters at most, of which a worker keeps the alignment.
_CACHED, _SHORT = 200_000, 64
#: Bytes of text of a block, and rows of one pair of ids in a join at most.
BLOCK, PAIR_ROWS = 2_000_000, 200_000


class Aligned(NamedTuple):
    """Of one word: A's and B's tokens, groups, their ids as text, and the linked pairs of ids as a * 2^32 + b."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    links: bytes
    whole: bool  # both give the word's bytes


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A tokens of the links, B tokens of the links).

    Both kinds of tokens follow one another without gaps from 0 on; they are given by their ends.
    """
    starts = [np.concatenate(([0], e[:-1])) if len(e) else e for e in (a_ends, b_ends)]
    start, end = np.concatenate(starts), np.concatenate((a_ends, b_ends))
    side = np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((side, start))
    upto = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = start[order][1:] >= upto[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = np.searchsorted(b_ends, starts[0], "right")  # the first B token that ends after the A token's start
    n = np.searchsorted(starts[1], a_ends, "left") - first
    a = np.repeat(np.arange(len(a_ends)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[: len(a_ends)], group[len(a_ends) :], a, b


def _joined(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one row after another, and where each row's begin (one entry more than rows)."""
    upto = np.cumsum([0, *map(len, rows)])
    return np.fromiter(chain.from_iterable(rows), np.int64, upto[-1]), upto


def _bounds(upto: np.ndarray) -> tuple[list[int], list[int]]:
    return upto[:-1].tolist(), upto[1:].tolist()


class Aligner:
    """Alignments of words (or whole texts) of a worker."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        a_bytes = {k: bytes(byte[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        self.bytes = [[a_bytes.get(k, b"") for k in range(max(a_bytes) + 1)], [self._piece(k) for k in range(self.b.get_piece_size())]]
        self.widths = [np.array([len(x) for x in own]) for own in self.bytes]
        # each id as text with what may follow it: by end, side and id
        self.size = max(map(len, self.bytes))
        self.shown = [f"{k}{end}" for end in ",|;" for k in range(self.size)]
        self.known: dict[str, Aligned] = {}

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def _fresh(self, words: list[str]) -> list[Aligned]:
        coded = [[x.ids for x in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], self.b.encode(words, num_threads=1)]
        data = [(" " + w).encode() if w else b"" for w in words]
        ids, upto = zip(*(_joined(x) for x in coded))
        whole = b"".join(data)
        begins = np.cumsum([0, *map(len, data)])
        same = begins[1:] > begins[:-1]
        for k in (0, 1):
            given = b"".join(map(self.bytes[k].__getitem__, ids[k].tolist()))
            at = np.concatenate(([0], np.cumsum(self.widths[k][ids[k]])))[upto[k]]
            if given != whole or (at != begins).any():
                same &= [given[i:j] == x for i, j, x in zip(at.tolist(), at[1:].tolist(), data)]
        out = [Aligned(0, 0, 0, b"", b"", False)] * len(words)
        use = np.flatnonzero(same)
        if not len(use):
            return out
        if len(use) < len(words):
            ids, upto = zip(*(_joined([x[k] for k in use]) for x in coded))
        group_a, group_b, a, b = coalesced(*(np.cumsum(self.widths[k][ids[k]]) for k in (0, 1)))
        links = ((ids[0][a] << 32) | ids[1][b]).astype("<i8").tobytes()
        # a word's groups and links are consecutive, as both of its rows of tokens end at its last byte
        g_upto = np.append(group_a[upto[0][:-1]], group_a[-1] + 1)
        l_upto = np.searchsorted(a, upto[0]) * 8
        group, side = np.concatenate((group_a, group_b)), np.repeat([0, 1], [len(group_a), len(group_b)])
        order = np.lexsort((side, group))  # stable: inside of them tokens stay in order
        group, side = np.append(group[order], -1), np.append(side[order], 0)
        end = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        texts = list(map(self.shown.__getitem__, (end * self.size + np.concatenate(ids)[order]).tolist()))
        counts = [np.diff(u).tolist() for u in (*upto, g_upto)]
        for k, n_a, n_b, n_groups, t0, t1, l0, l1 in zip(use.tolist(), *counts, *_bounds(upto[0] + upto[1]), *_bounds(l_upto)):
            out[k] = Aligned(n_a, n_b, n_groups, "".join(texts[t0:t1])[:-1].encode(), links[l0:l1], True)
        return out

    def words(self, words: list[str]) -> list[Aligned]:
        out = list(map(self.known.get, words))
        fresh = [k for k, x in enumerate(out) if x is None]
        for low in range(0, len(fresh), 20_000):
            some = fresh[low : low + 20_000]
            for k, found in zip(some, self._fresh([words[k] for k in some])):
                out[k] = found
                if len(self.known) < _CACHED and len(words[k]) <= _SHORT:
                    self.known[words[k]] = found
        return out

    def block(self, texts: pa.Array) -> dict:
        """What is known of each text, the block's pairs of ids, and each text's pairs among them (`at`, `times` from `upto` on)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        if odd.any():
            rows = [[t] if o else p for t, o, p in zip(texts.to_pylist(), odd, parts.to_pylist())]
            parts = pa.array(rows, pa.list_(pa.string()))
        coded = parts.flatten().dictionary_encode()
        found, codes = self.words(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64)
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        n, kinds = len(texts), max(1, len(found))
        text = np.repeat(np.arange(n), np.diff(bounds))
        whole = np.bincount(text, ~np.array([x.whole for x in found], bool)[codes], n) == 0 if len(codes) else np.zeros(n, bool)
        own = whole[text]  # of texts that both give back
        sums = lambda name: np.bincount(text[own], np.array([getattr(x, name) for x in found], np.int64)[codes[own]], n).astype(np.int64)
        shown = [hashlib.sha256(b";".join([found[c].groups for c in codes[a:b]])).hexdigest() if w else "" for a, b, w in zip(bounds, bounds[1:], whole)]
        # the distinct words of each text, then their links, then the distinct pairs of each text
        seen, often = np.unique(text[own] * kinds + codes[own], return_counts=True)
        n_links = np.array([len(x.links) // 8 for x in found], np.int64)
        pairs, which = np.unique(np.frombuffer(b"".join([x.links for x in found]), "<i8"), return_inverse=True)
        begins, word = np.cumsum(n_links) - n_links, seen % kinds
        each = n_links[word]
        link = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[word], each)
        held, back = np.unique(np.repeat(seen // kinds, each) * max(1, len(pairs)) + which[link], return_inverse=True)
        times = np.bincount(back, np.repeat(often, each), len(held)).astype(np.int32)
        at, upto = held % max(1, len(pairs)), np.searchsorted(held, np.arange(n + 1) * max(1, len(pairs)))
        holders = np.bincount(at, minlength=len(pairs))
        if len(pairs) and not holders.all():  # pairs of texts that count for nothing
            at, pairs, holders = (np.cumsum(holders > 0) - 1)[at], pairs[holders > 0], holders[holders > 0]
        links = np.add.reduceat(np.append(times, 0), np.minimum(upto[:-1], len(times))) * (np.diff(upto) > 0) if n else np.zeros(0, np.int64)
        counts = {"n_a": sums("n_a"), "n_b": sums("n_b"), "n_groups": sums("n_groups"), "n_links": links}
        return counts | {"groups_sha256": shown, "pairs": pairs, "holders": holders, "upto": upto, "at": at.astype(np.int32), "times": times}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


LONGS, INTS = ArrayType(LongType()), ArrayType(IntegerType())
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each block of documents: their ids and counts, the pairs of ids that they link, and each one's pairs."""
    kind = docs.schema["doc_id"].dataType
    fields = [("block", LongType()), ("doc_id", ArrayType(kind)), *[(c, LONGS) for c in COUNTS], ("groups_sha256", ArrayType(StringType())), ("pairs", LONGS), ("holders", LONGS), ("upto", LONGS), ("at", INTS), ("times", INTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, align = TaskContext.get().partitionId() << 33, aligner(a_path, b_path).block
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK):
                found = align(part.column("text"))
                types = {"groups_sha256": pa.string(), "at": pa.int32(), "times": pa.int32()}
                lists = {c: pa.array(v, types.get(c, pa.int64())) for c, v in found.items()} | {"doc_id": part.column("doc_id")}
                as_row = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[as_row(lists[c]) for c, _ in fields[1:]]], names=[c for c, _ in fields])
                block += 1

    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField(*f) for f in fields]))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that link it), best (whether no pair of its A id has a higher count) and n_blocks.

    An A id has as many pairs as B has ids at most, so that the window over them is bounded.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("count"), F.count("*").alias("n_blocks"))
    highest = F.max("count").over(W.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == highest)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document; see the contract of op13."""
    blocks = stored(blocks_of(docs, a_path, b_path), "zstd")
    counts = stored(pair_counts(blocks))
    # a pair has one row for each block that holds it; beyond PAIR_ROWS of them its rows are dealt over several keys
    parts = -(-(counts.agg(F.max("n_blocks")).first()[0] or 1) // PAIR_ROWS)
    counts = counts.select("pair", "count", "best", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    each = blocks.select("block", F.posexplode("pairs").alias("pos", "pair"), F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    met = each.join(counts, ["pair", "part"]).groupBy("block").agg(F.collect_list(F.struct("pos", "count", "best")).alias("met"))
    met = met.select("block", "met.pos", "met.count", "met.best")
    both = blocks.drop("pairs", "holders").join(met, "block", "left")
    kind = docs.schema["doc_id"].dataType
    fields = [StructField("doc_id", kind), *[StructField(c, LongType()) for c in [*COUNTS, "n_best", "count_sum"]], StructField("groups_sha256", StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                upto, at, times = (own(c).to_numpy().astype(np.int64) for c in ("upto", "at", "times"))
                sums = []
                for c in ("best", "count"):
                    of = np.zeros(len(at) and int(at.max()) + 1, np.int64)
                    if len(at):
                        of[own("pos").to_numpy()] = own(c).cast(pa.int64()).to_numpy()
                    run_ = np.concatenate(([0], np.cumsum(of[at] * times)))
                    sums.append(pa.array(run_[upto[1:]] - run_[upto[:-1]]))
                yield pa.RecordBatch.from_arrays([own("doc_id"), *[own(c) for c in COUNTS], *sums, own("groups_sha256")], names=[f.name for f in fields])

    return both.mapInArrow(run, StructType(fields))


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts and the digest of the groups of each document's aligned tokens.

    Null and empty texts, and those that one of the tokenizers doesn't give back byte by byte, have no tokens, link
    nothing and count for no pair: zeros and an empty digest. Equal texts have equal rows and count as documents of
    their own, as do rows that share a doc_id (null ones too). Ties for the highest count all count as best. Other
    columns are not read; no rows give no rows. B is taken to leave all characters but the space as they are, or else
    its texts count as not given back.
    """
    return aligned(docs, a_path, b_path)

"""Suffix-array dedup: repeated substrings, from longest-previous-factor arrays.

A suffix that agrees with another on SHORT bytes meets it by content. In each
stretch of SHORT bytes the GRAM-byte string of least hash is its anchor
(winnowing), so equal stretches have equal anchors at the same place, and an
anchor stands for a run of stretches. Whatever agrees on more bytes agrees on its
first SHORT ones, so an anchor's runs hold all of each other's matches:

1. anchors that occur once are put aside by a count;
2. runs are told apart by a hash of all bytes that LENGTH-byte matches of their
   stretches reach; those of one kind are decided once, and one of them is cut out
   of its text;
3. the stretches of an anchor's kinds are sorted by their bytes: that is the part
   of the suffix array in which they lie. Common prefixes of neighbours, and the
   previous and next smaller positions in that order, give each stretch's longest
   previous factor, and its longest match on either side, up to LENGTH bytes.

The largest of these orders is bounded (HOT_RUNS kinds); where an anchor has more
kinds, its stretches are dealt by hashes of their first SHORT and LENGTH bytes and
counted, which tells the same two lengths apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, join_sized, stored, text_of, text_slices

LENGTH, SHORT, GRAM = 400, 240, 96
#: A passage is a repeated stretch of more words than this.
PASSAGE_WORDS = 50
#: Anchors with more kinds of runs are counted by hashes instead of being sorted in one task.
HOT_RUNS = 2_000
#: Texts that make more than a HOT_SHARE-th of all rows have their rows dealt over HOT_PARTS parts.
HOT_SHARE, HOT_PARTS = 1_000, 64
#: A text is named by two hashes of 96 bits in all: among n texts two share a name by chance n * n / 2^97 times.
TEXT = ["tid", "tid2"]
#: The names of a stretch's first SHORT and LENGTH bytes; of fewer than LENGTH there are no latter ones.
NEAR, FULL = ["near1", "near2"], ["full1", "full2"]
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = _scrambled(np.arange(1, 257, dtype=np.uint64) * _B2)


class Prefix:
    """Hashes of any substrings of a byte array, modulo 2^64 with an odd base."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        self.back = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * power[:n], dtype=np.uint64)))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _scrambled((self.sums[high] - self.sums[low]) * self.back[low])


def least_of_next(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    out, have = x, 1
    while have < width:
        add = min(have, width - have)
        out = np.minimum(out[:-add], out[add:])
        have += add
    return out


def anchored(data: np.ndarray, begins: np.ndarray, length: int = LENGTH, short: int = SHORT, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all texts in data: text, low (the first stretch, from the text's begin), span (to the last), and hashes.

    begins: where the texts begin, one entry more than texts. run names the bytes
    from the first stretch to `length` bytes after the last one's begin, or the text's end.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("text", "low", "span", "anchor", "run")}
    if len(data) < short:
        return empty
    prefix = Prefix(data, _B1)
    grams = np.arange(len(data) - gram + 1)
    hashes = prefix.of(grams, grams + gram)
    # least hash, the leftmost of equals: the place takes the low bits
    low_bits = np.uint64((1 << len(data).bit_length()) - 1)
    place = (least_of_next((hashes & ~low_bits) | grams.astype(np.uint64), short - gram + 1) & low_bits).astype(np.int64)
    text = np.searchsorted(begins, np.arange(len(place)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(place)) + short <= begins[text + 1])
    if not len(inside):
        return empty
    place, text = place[inside], text[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(inside)) - 1
    low, high, at, text = inside[first], inside[last], place[first], text[first]
    end = np.minimum(high + length, begins[text + 1])
    whole = memoryview(data)
    run = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(low.tolist(), end.tolist())), np.uint64, len(low))
    run = _scrambled(run + (at - low).astype(np.uint64) * _B2 + (high - low).astype(np.uint64))
    return {"text": text, "low": low - begins[text], "span": high - low, "anchor": _scrambled(hashes[at]).view(np.int64), "run": run.view(np.int64)}


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    return np.frombuffer(b"".join(parts), np.uint8), begins


def _anchors(length: int, short: int, gram: int):
    """(tid, tid2, text) to the anchors of each text that the task hasn't just seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                names = list(zip(part.column("tid").to_pylist(), part.column("tid2").to_pylist()))
                fresh = [k for k, x in enumerate(names) if x not in seen and not seen.add(x)]
                if len(seen) > 200_000:  # copies that come later are combined after the shuffle
                    seen.clear()
                part = part.take(pa.array(fresh, pa.int64()))
                found = anchored(*_joined(part.column("text").cast(pa.binary()).to_pylist()), length, short, gram)
                which = pa.array(found["text"])
                columns = [*(part.column(c).take(which) for c in TEXT), *(pa.array(found[k].astype(np.int32)) for k in ("low", "span")), pa.array(found["anchor"]), pa.array(found["run"])]
                yield pa.RecordBatch.from_arrays(columns, names=[*TEXT, "low", "span", "anchor", "run"])

    return run


def _stretches(blobs: list[bytes], spans: list[int], short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces and, of each of their stretches: which piece, where in it, where in the bytes, and how many bytes follow."""
    data, begins = _joined(blobs)
    n = np.minimum(np.array(spans), np.diff(begins) - short) + 1
    which = np.repeat(np.arange(len(blobs)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return data, which, at, begins[which] + at, begins[which + 1] - begins[which] - at


def _words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, in the order of the bytes; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(out)]
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of 64-bit numbers are zero."""
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out += x < np.uint64(1 << 8 * k)
    return out


def suffix_order(data: np.ndarray, places: np.ndarray, left: np.ndarray, length: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at places by their first `length` bytes, and the bytes that each has in common with the one before it.

    left: how many bytes each suffix has. Suffixes whose first `short` bytes no
    other has stand in no order and are left out.
    """
    names = Prefix(data, _B1).of(places, places + short)
    by_name = np.argsort(names, kind="stable")
    same = names[by_name[1:]] == names[by_name[:-1]]
    shared = np.zeros(len(places), bool)
    shared[1:] |= same
    shared[:-1] |= same
    by_name = by_name[shared]
    if not len(by_name):
        return by_name, by_name
    words = _words64(data)
    left = np.minimum(left, length)

    def word(k: int, of: np.ndarray) -> np.ndarray:
        """The k-th eight bytes of suffixes, without what lies behind their end."""
        have = np.clip(left[of] - 8 * k, 0, 8)
        mask = np.where(have > 0, ~np.uint64(0) << (np.uint64(64) - np.maximum(have, 1).astype(np.uint64) * np.uint64(8)), np.uint64(0))
        return words[np.minimum(places[of] + 8 * k, len(data))] & mask

    first = np.ones(len(by_name), bool)
    first[1:] = names[by_name[1:]] != names[by_name[:-1]]
    group = np.cumsum(first) - 1
    heads = by_name[first]  # one of each name is enough to put the names in order
    rank = np.empty(len(heads), np.int64)
    rank[np.lexsort([word(k, heads) for k in reversed(range(-(-short // 8)))])] = np.arange(len(heads))
    behind = [word(k, by_name) for k in reversed(range(short // 8, -(-length // 8)))]
    order = by_name[np.lexsort([*behind, rank[group]])]
    # common prefixes, compared byte by byte from the start: equal hashes of unequal bytes end here
    common, still = np.zeros(len(order), np.int64), np.ones(len(order) - 1, bool)
    for k in range(-(-length // 8)):
        x = word(k, order[1:]) ^ word(k, order[:-1])
        common[1:] += np.where(still, _leading(x), 0)
        still &= x == 0
    common[1:] = np.minimum(common[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    return order, common


def _smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The bytes that each suffix in the order shares with the nearest one before it of a smaller position; 0 without one.

    Between a suffix and the candidate for its previous smaller position all
    positions are larger; where the candidate's is larger too, its own candidate
    follows, so that steps grow like powers of two.
    """
    n = len(position)
    to = np.arange(-1, n - 1)
    least = common.copy()
    open_ = np.flatnonzero((to >= 0) & (position[to] > position) & (least > 0))
    while len(open_):
        via = to[open_]
        least[open_] = np.minimum(least[open_], least[via])
        to[open_] = to[via]
        open_ = open_[(to[open_] >= 0) & (position[to[open_]] > position[open_]) & (least[open_] > 0)]
    return np.where(to >= 0, least, 0)


def longest_previous_factors(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in suffix order: the longest previous factor, and the longest match at any other position.

    position: where each stands in the collection; common: the bytes that it shares
    with the one before it in the order. The longest earlier match of a suffix is
    that with its previous or its next smaller position; the longest of all is that
    with a neighbour.
    """
    after = np.append(common[1:], 0)
    following = _smaller(position[::-1], after[::-1])[::-1]
    return np.maximum(_smaller(position, common), following), np.maximum(common, after)


def _ranges(flags: np.ndarray, which: np.ndarray, at: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs (first, last) of flagged stretches; which and at are in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    hit = np.flatnonzero(flags)
    if len(hit):
        new = np.ones(len(hit), bool)
        new[1:] = (which[hit][1:] != which[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        for w, a, b in zip(which[hit[first]].tolist(), at[hit[first]].tolist(), at[hit[last]].tolist()):
            out[w].append((a, b))
    return out


_RANGES = "array<struct<first:int,last:int>>"
_range_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
#: Of a run or text: stretches whose first SHORT bytes also start elsewhere, whose first LENGTH bytes do, and those of the latter with an earlier match.
VERDICTS = ["near", "alike", "later"]


def _as_ranges(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x] for x in rows], _range_type)


def factors(pieces: list[tuple[str, int, bytes]], length: int, short: int) -> tuple[list, np.ndarray]:
    """Of pieces (place, span, bytes) the ranges near, alike and later, and the longest previous factor."""
    places, spans, blobs = zip(*pieces)
    data, which, at, where, left = _stretches(list(blobs), list(spans), short)
    rank = {p: i for i, p in enumerate(sorted(places))}
    position = np.array([rank[p] for p in places])[which] * (max(spans) + 1) + at
    order, common = suffix_order(data, where, left, length, short)
    earlier, longest = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    earlier[order], longest[order] = longest_previous_factors(position[order], common)
    most = np.zeros(len(pieces), np.int64)
    np.maximum.at(most, which, np.where(earlier >= short, earlier, 0))
    return [_ranges(x, which, at, len(pieces)) for x in (longest >= short, longest >= length, earlier >= length)], most


def _sorted_runs(length: int, short: int):
    """(anchor, run, place, span, bytes), sorted by anchor, to (anchor, run, near, alike, later, lpf); cut between anchors."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        ranges, most = factors([r[2:] for r in rows], length, short)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *map(_as_ranges, ranges), pa.array(most.astype(np.int32))], names=["anchor", "run", *VERDICTS, "lpf"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "run", "place", "span", "bytes"))):
                if held and size > 250_000 and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return run


def _named_stretches(length: int, short: int):
    """(anchor, run, place, span, bytes) to a row a stretch: hashes of its first `short` and, where it has as many, `length` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                data, which, at, where, left = _stretches(part.column("bytes").to_pylist(), part.column("span").to_pylist(), short)
                one, two = Prefix(data, _B1), Prefix(data, _B2)
                cut = left < length
                end = where + np.where(cut, short, length)
                names = [pa.array(h.of(where, where + short).view(np.int64)) for h in (one, two)]
                names += [pa.array(h.of(where, end).view(np.int64), mask=cut) for h in (one, two)]
                columns = [part.column(c).take(pa.array(which)) for c in ("anchor", "run", "place")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), *names], names=["anchor", "run", "place", "at", *NEAR, *FULL])

    return run


def repeated_ranges(docs: DataFrame, firsts: DataFrame, length: int = LENGTH, short: int = SHORT, gram: int = GRAM) -> DataFrame:
    """(tid, tid2, near, alike, later, lpf) of each distinct text of (tid, tid2, text) with a stretch that another text or place has.

    firsts: (tid, tid2, first_doc), which puts texts in order: positions count by
    (first_doc, tid, tid2, place). Ranges (first, last) are of stretches; lpf is the longest
    previous factor, up to `length`, 0 below `short`. Nothing is lost: each stretch has
    exactly one anchor, and equal stretches have equal ones.
    """
    schema = "tid long, tid2 int, low int, span int, anchor long, run long"
    found = stored(docs.mapInArrow(_anchors(length, short, gram), schema), "zstd")
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    # copies of a text met in several tasks are one
    runs = stored(join_sized(found, often, ["anchor"], "left_semi").distinct().join(firsts.select(*TEXT, "first_doc"), TEXT))
    forget(found, often)
    kinds = runs.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("first_doc", *TEXT, "low")).alias("place"), F.first("span").alias("span"))
    kinds = stored(kinds)
    per = kinds.groupBy("anchor").agg(F.sum("n").alias("__n"), F.count("*").alias("__kinds")).where("__n > 1")
    kinds = stored(kinds.join(per, "anchor"))
    # cut one run of each kind out of its text
    wanted = kinds.where("__kinds > 1").select(F.col("place.tid").alias("tid"), F.col("place.tid2").alias("tid2"), "anchor", "run", "__kinds", "place", "span")
    asked = stored(wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("anchor", "run", "__kinds", "place", "span")).alias("all")))  # no more than a text has anchors
    texts = join_sized(docs, asked.select("tid"), ["tid"], "left_semi").dropDuplicates(TEXT)
    one = texts.select(*TEXT, F.encode("text", "utf-8").alias("b")).join(asked, TEXT).select("b", F.explode("all").alias("x"))
    pieces = stored(one.select("x.*", F.substring("b", F.col("x.place.low") + 1, F.col("x.span") + length).alias("bytes")))
    place = F.format_string("%020d/%020d/%011d/%011d", "place.first_doc", "place.tid", "place.tid2", "place.low").alias("place")
    usual = pieces.where(F.col("__kinds") <= HOT_RUNS).select("anchor", "run", place, "span", "bytes")
    sorted_ = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_runs(length, short), f"anchor long, run long, {', '.join(f'{v} {_RANGES}' for v in VERDICTS)}, lpf int")
    # an anchor with many kinds of runs: stretches are dealt by their names, counts combined before the shuffle
    names = ", ".join(f"{c} long" for c in (*NEAR, *FULL))
    hot = stored(pieces.where(F.col("__kinds") > HOT_RUNS).select("anchor", "run", place, "span", "bytes").mapInArrow(_named_stretches(length, short), f"anchor long, run long, place string, at int, {names}"))
    found_at = F.struct("place", "at")
    least = lambda name, c: hot.where(F.col(name[0]).isNotNull()).groupBy(*name).agg(F.count("*").alias("n"), F.min(found_at).alias(c)).where("n > 1").drop("n")
    # equal in LENGTH bytes, equal in SHORT ones; stretches without the former are dealt by the latter and meet none
    alike = F.col("full1").isNotNull()
    for k, c in enumerate(FULL):
        alike = alike & (F.coalesce(c, NEAR[k]) == F.col(f"least_full.{c}"))
    hit = hot.join(least(NEAR, "least"), NEAR).join(least(FULL, "at_least").select(F.struct(*FULL, "at_least").alias("least_full")), alike, "left")
    single = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.col("at")))), lambda x: F.struct(x.alias("first"), x.alias("last"))).cast(_RANGES)
    full = F.col("least_full").isNotNull()
    later = full & (found_at != F.col("least_full.at_least"))
    hit = hit.groupBy("anchor", "run").agg(
        single(F.lit(True)).alias("near"), single(full).alias("alike"), single(later).alias("later"), F.coalesce(F.max(F.when(later, length).when(found_at != F.col("least"), short)), F.lit(0)).alias("lpf")
    )
    partial = sorted_.unionByName(hit)
    # verdicts by kind of run; the first place of a kind that occurs twice only has what earlier other kinds give it
    verdict = stored(kinds.join(partial, ["anchor", "run"], "left").select("anchor", "run", (F.col("n") > 1).alias("whole"), "place", *VERDICTS, "lpf").where("whole or size(near) > 0"))
    each = runs.join(verdict, ["anchor", "run"])
    bytes_left = F.col("n_bytes") - F.col("low")
    none = F.array().cast(_RANGES)
    all_ = F.array(F.struct(F.col("low").alias("first"), (F.col("low") + F.col("span")).alias("last"))).cast(_RANGES)
    # of a whole run's stretches those alike that have so many bytes
    long_ = F.when(bytes_left >= length, F.array(F.struct(F.col("low").alias("first"), (F.col("low") + F.least(F.col("span"), bytes_left - length)).alias("last"))).cast(_RANGES)).otherwise(none)
    moved = lambda c: F.coalesce(F.transform(c, lambda x: F.struct((x["first"] + F.col("low")).alias("first"), (x["last"] + F.col("low")).alias("last"))), none).cast(_RANGES)
    is_first = (F.col("place.tid") == F.col("tid")) & (F.col("place.tid2") == F.col("tid2")) & (F.col("place.low") == F.col("low"))
    copy = F.col("whole") & ~is_first
    each = each.join(firsts.select(*TEXT, "n_bytes"), TEXT).select(
        *TEXT, F.when(F.col("whole"), all_).otherwise(moved("near")).alias("near"), F.when(F.col("whole"), long_).otherwise(moved("alike")).alias("alike"),
        F.when(copy, long_).otherwise(moved("later")).alias("later"), F.when(copy, F.least(F.lit(length), bytes_left)).otherwise(F.coalesce("lpf", F.lit(0))).cast("int").alias("lpf"),
    )
    return each.groupBy(*TEXT).agg(*(F.flatten(F.collect_list(v)).alias(v) for v in VERDICTS), F.max("lpf").alias("lpf"))


def _covered(ranges, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the stretches cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["first"], x["last"] + length) for x in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_WORDS = re.compile(WORD.encode())


def _whole_words(text: bytes, a: int, b: int) -> int:
    """How many words of the text lie wholly inside."""
    n = sum(1 for _ in _WORDS.finditer(text, a, b))
    cut = lambda k: 0 < k < len(text) and _WORDS.match(text, k - 1, k) is not None and _WORDS.match(text, k, k + 1) is not None
    return max(0, n - cut(a) - cut(b))


_REPORT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_later": pa.int64(), "n_passages": pa.int64(), "passage_words": pa.int64(), "longest_previous": pa.int64(), "repeats": pa.bool_()}


def _report(length: int, short: int):
    def row(text: bytes, copies: int | None, first: bool, near, alike, later, lpf: int | None) -> tuple:
        n = len(text)
        if copies and copies > 1:  # all of a text that other rows have too is repeated
            near = [{"first": 0, "last": n - short}] if n >= short else []
            alike = [{"first": 0, "last": n - length}] if n >= length else []
            if not first:
                later, lpf = alike, min(n, length) if n >= short else 0
        gone = _covered(alike, length)
        at, kept = 0, hashlib.sha256()
        for a, b in gone:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        words = [w for w in (_whole_words(text, a, b) for a, b in _covered(near, short)) if w > PASSAGE_WORDS]
        return n, sum(b - a for a, b in gone), len(gone), kept.hexdigest(), sum(b - a for a, b in _covered(later, length)), len(words), sum(words), lpf or 0, bool(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = [row(*x) for x in zip(part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in ("copies", "is_first", *VERDICTS, "lpf")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*out), _REPORT.values()))], names=["doc_id", *_REPORT])

    return run


def suffix_dedup_report(docs: DataFrame, length: int = LENGTH, short: int = SHORT, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, by the contract of op4; and what the factors tell besides.

    n_later: the bytes that removal of later copies alone would take (longest
    previous factor of `length` or more; of equal texts the first is that of the least
    doc_id, null last, and all others are later). n_passages and passage_words: maximal
    stretches whose parts of `short` bytes all start elsewhere too and that hold more
    than PASSAGE_WORDS whole words, and their words; repeats: whether there are any.
    longest_previous: the longest previous factor, up to `length`, 0 below `short`.
    Null texts are empty; texts shorter than `short` lose nothing and repeat nothing.
    Rows that share a doc_id are rows of their own; other columns are not read.
    """
    name = {"tid": F.xxhash64("text"), "tid2": F.hash("text")}
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).withColumns(name)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62))
    firsts = rows.groupBy(*TEXT).agg(F.min(order).alias("first_doc"), F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("n_bytes"))
    firsts = stored(firsts)
    ranges = stored(repeated_ranges(rows.select(*TEXT, "text"), firsts, length, short, gram))
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    found = firsts.join(ranges, TEXT, "left").where("copies > 1 or size(near) > 0")
    # copies of one text are dealt over parts, each of which is sent the verdict
    many = firsts.where(F.col("copies") * HOT_SHARE > total + HOT_SHARE * HOT_PARTS).select("tid").distinct().withColumn("__hot", F.lit(True))  # HOT_SHARE rows at most
    parts = lambda c: F.coalesce(F.when(F.col("__hot"), c), F.lit(0))
    sent = found.join(F.broadcast(many), "tid", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts(F.lit(HOT_PARTS - 1))))).drop("__hot")
    dealt = rows.join(F.broadcast(many), "tid", "left").withColumn("__part", parts(F.pmod(F.xxhash64(order), F.lit(HOT_PARTS)).cast("int")))
    is_first: Column = F.coalesce(order == F.col("first_doc"), F.lit(False))
    joined = dealt.join(sent, [*TEXT, "__part"], "left").select("doc_id", "text", "copies", is_first.alias("is_first"), *VERDICTS, "lpf")
    kind = dict(docs.dtypes)["doc_id"]
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return joined.mapInArrow(_report(length, short), f"doc_id {kind}, " + ", ".join(f"{c} {names[t]}" for c, t in _REPORT.items()))

"""Packing by minimum bin slack.

Documents are cut into whole windows and a remainder. Only the number of pieces
of each length, at most as many counts as a window has tokens, reaches the
driver. There a subset-sum over bitsets picks, for the longest length left, the
multiset of other lengths that comes closest to the window; backtracking gives
its counts, and the pattern is used as often as they allow. Pieces are then
dealt to the patterns' slots by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked_within, stored, text_slices
from .tokens import encoder, with_end

WINDOW, END = 2048, 1


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece of each document.

    A null or empty text is one piece that holds the end id alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, begins = with_end(*encode(part.column("text")), end)
                rows, data = [], ids.astype("<u4")
                for k, (a, b) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                    rows += [(k, s - a, min(window, b - s), zlib.crc32(data[s : min(s + window, b)]), b - a) for s in range(a, b, window)]
                which, *rest = map(pa.array, zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(which), *rest], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of the lengths (as often as counted) whose sum comes closest to room from below.

    Bit s of a set tells whether a sum s can be reached. Counts are taken in
    binary parts; the sets before each part allow the way back.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not sums >> room & 1:
            n = min(part, left)
            steps.append((length, n, sums))
            sums |= sums << length * n & mask
            left, part = left - n, part * 2
        if sums >> room & 1:
            break
    at, taken = sums.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return sorted(taken.items(), reverse=True)


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """(lengths with their numbers, how many sequences are filled so), using up all counts."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = dict(closest({k: v for k, v in left.items() if v > 0}, window - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((sorted(chosen.items(), reverse=True), times))
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most window tokens, without gaps.

    pieces is a stored table with a column length between 1 and window; rows with
    equal columns may change places. No pieces give no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for lengths, times in patterns(counts, window):
        offset = 0
        for length, n in lengths:
            slots.append((length, used[length], used[length] + n * times, base, n, offset))
            used[length] += n * times
            offset += n * length
        base += times
    tie = [F.col(x) for x in pieces.columns if x != "length"]
    ranked = ranked_within(pieces, ["length"], tie)
    # one row a length, with the patterns that use it in order of rank; a rank's pattern is the last that begins at or before it
    by_length: dict[int, list[tuple]] = {}
    for length, low, _, *rest in sorted(slots):
        by_length.setdefault(length, []).append((low, *rest))
    table = pieces.sparkSession.createDataFrame(list(by_length.items()), "length long, uses array<struct<low:long,base:long,n:long,first:long>>")
    met = ranked.join(F.broadcast(table), "length")  # `window` rows at most
    use = F.element_at(F.filter("uses", lambda u: u["low"] <= F.col("rank")), -1)
    df = met.withColumn("__u", use).select(*ranked.columns, "__u.*")
    at = F.col("rank") - F.col("low")
    sequence = F.col("base") + F.floor(at / F.col("n")).cast("long")
    offset = F.col("first") + (at % F.col("n")) * F.col("length")
    return df.select(*pieces.columns, sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents with their places in the sequences; see the contract of op9.

    A null or empty text is one piece that holds the end id alone; a long one has as
    many whole windows as fit and a remainder. Pieces of equal length are dealt by a
    hash of their other columns, so reruns agree but for equal rows, whose pieces may
    change places. Rows that share a doc_id (null ones too) are documents of their
    own. Columns other than doc_id and text are not read. No rows give no pieces.
    """
    return pack(stored(cut(docs, tokenizer, window)), window)

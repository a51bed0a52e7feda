"""Token-ID output: ids in checksummed blocks, coded by a context-mixing range coder.

A segment (some two million ids) begins with its static models: how often each id
occurs (order 0), and for pairs of ids that pay for their place how often the second
follows the first (order 1). Its blocks follow. In a block an id is first held
against the one that followed the last two when they were last seen there (order 2);
whether that hits is a binary decision, whose probability mixes in the logistic
domain what the table's hits so far, order 1 and order 0 say of the guess, with
weights that are learned from each outcome. An id that isn't guessed is coded under
order 1, by an escape under order 0. Every decision drives a range coder with 16-bit
output, and all arithmetic is on integers.

Blocks start from the same state and carry a checksum, so each can be decoded alone
with its segment's models. Many blocks are coded side by side, one array element
each, which is what makes numpy worth its while.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_sized, shared_dir, stored, text_of, text_slices
from .tokens import encoder, with_end

#: Ids in a block, and blocks in a segment (whole documents, so a long one makes it larger).
BLOCK, BLOCKS = 1024, 2048
#: Slots of a block's table of order-2 predictions.
SLOTS = 1024
#: Bits of the totals of order 0, order 1 and of binary decisions.
BITS0, BITS1, BITS2 = 20, 16, 12
#: A pair is modelled if it saves more bits than this; its place takes about as many.
PAIR_BITS = 26.0
MAGIC = b"CMR2"
_FULL, _LEAST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)


class Damaged(ValueError):
    """A block or segment whose bytes don't agree with its checksum or header."""


class RangeCoder:
    """Encoders or decoders side by side, one a lane: 48-bit interval, 16 bits out at a time."""

    def __init__(self, lanes: int, room: int = 0, words: list[np.ndarray] | None = None):
        self.range = np.full(lanes, _FULL, np.uint64)
        self.low = np.zeros(lanes, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        if words is None:
            self.words = np.zeros((lanes, room), np.uint16)
        else:
            self.words = np.zeros((lanes, max(map(len, words)) + 4), np.uint16)
            for k, x in enumerate(words):
                self.words[k, : len(x)] = x
            for _ in range(3):
                self.low = self.low << np.uint64(16) | self.words[np.arange(lanes), self.at]
                self.at += 1

    def put(self, lane: np.ndarray, low: np.ndarray, size: np.ndarray, bits: int) -> None:
        unit = self.range[lane] >> np.uint64(bits)
        at = self.low[lane] + unit * low.astype(np.uint64)
        span = unit * size.astype(np.uint64)
        over = np.flatnonzero(at > _FULL)
        if len(over):  # a carry runs back over what is already out
            k, back = lane[over], self.at[lane[over]] - 1
            while len(k):
                self.words[k, back] += np.uint16(1)
                more = self.words[k, back] == 0
                k, back = k[more], back[more] - 1
            at &= _FULL
        short = np.flatnonzero(span < _LEAST)
        while len(short):
            k = lane[short]
            self.words[k, self.at[k]] = (at[short] >> np.uint64(32)).astype(np.uint16)
            self.at[k] += 1
            at[short] = at[short] << np.uint64(16) & _FULL
            span[short] <<= np.uint64(16)
            short = short[span[short] < _LEAST]
        self.low[lane], self.range[lane] = at, span

    def end(self) -> list[np.ndarray]:
        lanes = np.arange(len(self.at))
        for shift in (32, 16, 0):
            self.words[lanes, self.at] = (self.low >> np.uint64(shift)).astype(np.uint16)
            self.at += 1
        return [self.words[k, :n] for k, n in enumerate(self.at.tolist())]

    def peek(self, lane: np.ndarray, bits: int) -> np.ndarray:
        self.unit = self.range[lane] >> np.uint64(bits)
        return np.minimum(self.low[lane] // self.unit, np.uint64((1 << bits) - 1)).astype(np.int64)

    def take(self, lane: np.ndarray, low: np.ndarray, size: np.ndarray) -> None:
        """After peek for the same lanes: what was decided."""
        code = self.low[lane] - self.unit * low.astype(np.uint64)
        span = self.unit * size.astype(np.uint64)
        short = np.flatnonzero(span < _LEAST)
        while len(short):
            k = lane[short]
            code[short] = code[short] << np.uint64(16) | self.words[k, np.minimum(self.at[k], self.words.shape[1] - 1)]
            self.at[k] += 1
            span[short] <<= np.uint64(16)
            short = short[span[short] < _LEAST]
        self.low[lane], self.range[lane] = code, span


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as eighths of their binary logarithm, in a byte."""
    return np.round(8 * np.log2(np.maximum(counts, 1))).clip(0, 255).astype(np.uint8)


#: What a level stands for, by integer roots, so that all machines agree: 2 ** (level / 8) in 256ths.
_COUNTS = np.array([math.isqrt(math.isqrt(math.isqrt(1 << (level + 64)))) for level in range(256)], np.int64)


def _bytes_apart(x: np.ndarray) -> bytes:
    """Eight-byte numbers, all their first bytes first: what is the same in all of them then compresses away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _bytes_together(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


class Models:
    """The static models of a segment, from what its header holds.

    alphabet: its ids; level0: of each how often it occurs; keys: modelled pairs as
    first * K + second (places in the alphabet), in order; level1: how often each
    occurs; rest: for each first of a pair, how often something else follows.
    """

    def __init__(self, alphabet: np.ndarray, level0: np.ndarray, keys: np.ndarray, level1: np.ndarray, rest: np.ndarray):
        self.parts = alphabet, level0, keys, level1, rest
        self.alphabet, self.keys, self.k = alphabet, keys, len(alphabet)
        weight = _COUNTS[level0]
        self.size0 = 1 + weight * ((1 << BITS0) - self.k) // weight.sum()
        self.size0[np.argmax(weight)] += (1 << BITS0) - self.size0.sum()
        self.low0 = np.cumsum(self.size0) - self.size0
        # each first has its seconds, then the escape
        first = keys // self.k
        firsts, starts = np.unique(first, return_index=True)
        self.nth = np.full(self.k + 1, -1)
        self.nth[firsts] = np.arange(len(firsts))
        ends = np.append(starts[1:], len(keys))
        self.place = np.arange(len(keys)) + np.searchsorted(firsts, first)
        self.escape = ends + np.arange(len(firsts))
        weight = np.zeros(len(keys) + len(firsts), np.int64)
        weight[self.place], weight[self.escape] = _COUNTS[level1], _COUNTS[rest]
        self.second = np.full(len(weight), -1)
        self.second[self.place] = keys % self.k
        if len(firsts):
            begins = starts + np.arange(len(firsts))
            many = ends - starts + 1
            self.size1 = 1 + weight * np.repeat((1 << BITS1) - many, many) // np.repeat(np.add.reduceat(weight, begins), many)
            self.size1[self.escape] += (1 << BITS1) - np.add.reduceat(self.size1, begins)
            whole = np.cumsum(self.size1) - self.size1  # of all firsts one after another
            self.low1 = whole
        else:
            self.size1 = self.low1 = np.zeros(0, np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> tuple[Models, np.ndarray]:
        """The models of ids that will be cut into blocks, and each id's place in the alphabet."""
        alphabet, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
        k = len(alphabet)
        inside = np.arange(1, len(ids)) % block != 0
        pairs, often = np.unique(symbols[:-1][inside] * np.int64(k) + symbols[1:][inside], return_counts=True)
        first = pairs // k
        of_first = np.bincount(first, often, k) if len(pairs) else np.zeros(k)
        saved = often * np.log2(np.maximum(often * len(ids) / (of_first[first] * counts[pairs % k]), 1e-9))
        pays = saved > PAIR_BITS
        keys, often = pairs[pays], often[pays]
        firsts = np.unique(keys // k)
        rest = of_first[firsts] - (np.bincount(keys // k, often, k)[firsts] if len(keys) else 0)
        return cls(alphabet.astype(np.int64), _levels(counts), keys, _levels(often), _levels(rest)), symbols

    def to_bytes(self) -> bytes:
        alphabet, level0, keys, level1, rest = self.parts
        body = _bytes_apart(np.diff(alphabet, prepend=0)) + level0.tobytes() + _bytes_apart(np.diff(keys, prepend=0)) + level1.tobytes() + rest.tobytes()
        return struct.pack("<III", len(alphabet), len(keys), len(rest)) + zlib.compress(body, 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Models:
        k, n, m = struct.unpack_from("<III", data)
        body = zlib.decompress(data[12:])
        cuts = np.cumsum([8 * k, k, 8 * n, n, m])
        if cuts[-1] != len(body):
            raise Damaged("models of another size")
        alphabet, level0, keys, level1, rest = np.split(np.frombuffer(body, np.uint8), cuts[:-1])
        return cls(np.cumsum(_bytes_together(alphabet.tobytes())), level0, np.cumsum(_bytes_together(keys.tobytes())), level1, rest)

    def pair(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where symbol stands among what follows before: its own entry, else the escape; -1 if before has none."""
        nth = self.nth[before]
        if not len(self.keys):
            return np.full(len(nth), -1)
        key = before * np.int64(self.k) + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(nth < 0, -1, np.where(self.keys[at] == key, self.place[at], self.escape[nth]))


def _logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (of 4096) at 256ths of the logistic domain from -8 to 8, and the least of these that reach a probability."""
    squash = np.array([int(Decimal(4096) / (1 + (Decimal(-x) / 256).exp())) for x in range(-2048, 2048)], np.int64).clip(1, 4095)
    return squash, np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048


_SQUASH, _STRETCH = _logistic_tables()
#: Where the weights of the three predictions start, of 65536, and how fast they move.
_WEIGHTS, _RATE = (30000, 24000, 4000), 10
#: What a guess's hits so far make of its chance at first (of 65536), by its trust.
_CHANCES = np.array([8000, 20000, 36000, 44000, 50000, 54000, 57000, 60000])


class Guesses:
    """Order 2 in a block: the symbol that last followed two others, how often it was right, and the mixing of predictions."""

    def __init__(self, lanes: int):
        self.symbol = np.full((lanes, SLOTS), -1, np.int32)
        self.trust = np.zeros((lanes, SLOTS), np.int8)
        self.chance = np.tile(_CHANCES, (lanes, 1))
        self.weights = np.tile(np.array(_WEIGHTS, np.int64), (lanes, 1))

    def learn(self, lane: np.ndarray, slot: np.ndarray, guess: np.ndarray, trust: np.ndarray, real: np.ndarray) -> None:
        right = guess == real
        weak = ~right & (trust <= 1)
        self.symbol[lane, slot] = np.where(weak, real, guess)
        self.trust[lane, slot] = np.where(right, np.minimum(trust + 1, 7), np.where(weak, 1, trust >> 1))

    def code(self, coder: RangeCoder, models: Models, lane: np.ndarray, before: np.ndarray, guess: np.ndarray, trust: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Whether the guess is right, by the mixed probability; the weights and chances learn the outcome."""
        entry = models.pair(before, guess)
        size1 = np.where(entry >= 0, models.size1[entry], 0) if len(models.size1) else np.zeros(len(entry), np.int64)
        p0 = (models.size0[guess] >> BITS0 - 12).clip(1, 4095)
        p1 = np.where((entry >= 0) & (models.second[entry] == guess if len(models.second) else False), (size1 >> BITS1 - 12).clip(1, 4095), p0)
        held = self.chance[lane, trust]
        said = np.stack([_STRETCH[held >> 4], _STRETCH[p1], _STRETCH[p0]], axis=1)
        weights = self.weights[lane]
        mixed = (weights * said).sum(axis=1) >> 16
        chance = _SQUASH[mixed.clip(-2048, 2047) + 2048]
        if bit is None:
            bit = coder.peek(lane, BITS2) < chance
            coder.take(lane, np.where(bit, 0, chance), np.where(bit, chance, 4096 - chance))
        else:
            coder.put(lane, np.where(bit, 0, chance), np.where(bit, chance, 4096 - chance), BITS2)
        error = ((bit.astype(np.int64) << 12) - chance) * _RATE
        self.weights[lane] = weights + (said * error[:, None] + 0x8000 >> 16)
        self.chance[lane, trust] = held + ((np.where(bit, 65535, 0) - held) >> 4)
        return bit


def _run(coder: RangeCoder, models: Models, lengths: list[int], given: np.ndarray | None) -> np.ndarray:
    """Codes (given: symbols by lane and step) or decodes lanes side by side; lengths don't grow from lane to lane."""
    lanes = len(lengths)
    out = np.zeros((lanes, lengths[0]), np.int64) if given is None else given
    guesses = Guesses(lanes)
    last = np.full(lanes, models.k)  # nothing stands before a block
    before = last.copy()
    sizes = np.array(lengths)
    if given is None:  # which symbol a number below the total of order 0 falls on
        which0 = np.repeat(np.arange(models.k, dtype=np.int32), models.size0)
    for step in range(lengths[0]):
        m = int(np.searchsorted(-sizes, -step, side="left"))
        lane = np.arange(m)
        slot = ((last[:m] * 40503 + before[:m] * 30011) >> 3) % SLOTS
        guess, trust = guesses.symbol[lane, slot].astype(np.int64), guesses.trust[lane, slot].astype(np.int64)
        real = None if given is None else given[:m, step]
        value = np.full(m, -1) if given is None else real
        left = lane
        tried = np.flatnonzero(guess >= 0)
        if len(tried):
            hit = guesses.code(coder, models, tried, last[tried], guess[tried], trust[tried], None if real is None else real[tried] == guess[tried])
            if given is None:
                value[tried[hit]] = guess[tried[hit]]
            open_ = np.ones(m, bool)
            open_[tried[hit]] = False
            left = np.flatnonzero(open_)
        some = left[models.nth[last[left]] >= 0]
        escaped = np.ones(m, bool)
        if len(some):
            nth = models.nth[last[some]]
            start = nth << BITS1
            if given is None:
                entry = np.searchsorted(models.low1, start + coder.peek(some, BITS1), side="right") - 1
                coder.take(some, models.low1[entry] - start, models.size1[entry])
                value[some] = models.second[entry]
            else:
                entry = models.pair(last[some], real[some])
                coder.put(some, models.low1[entry] - start, models.size1[entry], BITS1)
            escaped[some] = models.second[entry] < 0
        left = left[escaped[left]]
        if len(left):
            if given is None:
                symbol = which0[coder.peek(left, BITS0)]
                coder.take(left, models.low0[symbol], models.size0[symbol])
                value[left] = symbol
            else:
                coder.put(left, models.low0[real[left]], models.size0[real[left]], BITS0)
        guesses.learn(lane, slot, guess, trust, value)
        if given is None:
            out[:m, step] = value
        before[:m], last[:m] = last[:m], value
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The ids as a segment: magic, sizes and checksum of the models, the models, and the blocks.

    A block is its number of ids, its number of words, a checksum of ids and words, and the words.
    """
    if not len(ids):
        return b""
    models, symbols = Models.of(ids, block)
    cuts = range(0, len(ids), block)
    lengths = [min(block, len(ids) - k) for k in cuts]
    given = np.zeros((len(lengths), lengths[0]), np.int64)
    given.ravel()[: len(symbols)] = symbols
    coder = RangeCoder(len(lengths), room=4 * lengths[0] + 8)
    _run(coder, models, lengths, given)
    out = [models.to_bytes()]
    out.insert(0, struct.pack("<4sII", MAGIC, len(out[0]), zlib.crc32(out[0])))
    for k, n, w in zip(cuts, lengths, coder.end()):
        w = w.astype("<u2").tobytes()
        out.append(struct.pack("<III", n, len(w) // 2, zlib.crc32(w, zlib.crc32(ids[k : k + n].astype("<u4")))) + w)
    return b"".join(out)


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of all blocks; Damaged if the models or a block's ids don't have their checksum."""
    if not data:
        return np.zeros(0, np.uint32)
    try:
        magic, size, check = struct.unpack_from("<4sII", data)
    except struct.error:
        raise Damaged("the header is cut off") from None
    at = 12 + size
    if magic != MAGIC or at > len(data) or zlib.crc32(data[12:at]) != check:
        raise Damaged("no models")
    models = Models.from_bytes(data[12:at])
    heads, words = [], []
    while at < len(data):
        try:
            n, size, check = struct.unpack_from("<III", data, at)
        except struct.error:
            raise Damaged("a block's header is cut off") from None
        at += 12
        if size < 3 or at + 2 * size > len(data) or not n or (heads and n > heads[-1][0]):
            raise Damaged(f"no block at byte {at - 12}")
        heads.append((n, check))
        words.append(np.frombuffer(data, "<u2", size, at))
        at += 2 * size
    if not heads or heads[0][0] > 1 << 24:
        raise Damaged("no blocks")
    symbols = _run(RangeCoder(len(heads), words=words), models, [h[0] for h in heads], None)
    parts = [models.alphabet[symbols[k, : h[0]]].astype("<u4") for k, h in enumerate(heads)]
    for x, w, h in zip(parts, words, heads):
        if zlib.crc32(w, zlib.crc32(x)) != h[1]:
            raise Damaged("a block doesn't have its checksum")
    return np.concatenate(parts)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 2, segment: int = BLOCK * BLOCKS) -> None:
    """Token files in ascending doc_id order (null last): segments (part, nr, doc_ids, lengths, n_ids, data) as Parquet rows."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        part, nr = None, 0

        def done() -> pa.RecordBatch:
            nonlocal held, doc_ids, lengths, nr
            ids = np.concatenate(held)
            row = [[part], [nr], [doc_ids], [lengths], [len(ids)], [encode_blocks(ids)]]
            held, doc_ids, lengths, nr = [], [], [], nr + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=names)

        names = ["part", "nr", "doc_ids", "lengths", "n_ids", "data"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            for piece in text_slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                ids, begins = with_end(*encode(piece.column("text")), end)
                # cut after the document that fills a segment
                keys, sizes = piece.column("doc_id").to_pylist(), np.diff(begins).tolist()
                have, first = sum(lengths), 0
                for k, size in enumerate(sizes):
                    have += size
                    if have >= segment:
                        held.append(ids[begins[first] : begins[k + 1]])
                        doc_ids, lengths = doc_ids + keys[first : k + 1], lengths + sizes[first : k + 1]
                        yield done()
                        have, first = 0, k + 1
                if first < len(sizes):
                    held.append(ids[begins[first] :])
                    doc_ids, lengths = doc_ids + keys[first:], lengths + sizes[first:]
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    rows.mapInArrow(segments, "part int, nr int, doc_ids array<long>, lengths array<long>, n_ids long, data binary").write.parquet(path)


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document, decoded from the segments of write_token_files."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row a file, then one row a segment of a file
    parts = parts.select("part", before(W.orderBy("part")).alias("__part"))
    inside = segments.select("part", "nr", F.col("n_ids").alias("__n")).select("part", "nr", before(W.partitionBy("part").orderBy("nr")).alias("__inside"))
    starts = stored(inside.join(parts, "part").select("part", "nr", (F.col("__part") + F.col("__inside")).alias("base")))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, base, data in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "base", "data"))):
                ids = decode_blocks(data)
                if len(ids) != sum(lengths):
                    raise Damaged("a segment's documents don't use up its ids")
                begins = np.concatenate(([0], np.cumsum(lengths)))
                for a in range(0, len(doc_ids), 1000):
                    cut = begins[a : a + 1001]
                    lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(ids[cut[0] : cut[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 1000], pa.int64()), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), lists], names=["doc_id", "start", "n_tokens", "ids"])

    return join_sized(segments, starts, ["part", "nr"]).select("doc_ids", "lengths", "base", "data").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids array<int>")


def token_file_report(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from its files.

    A null or empty text has the end id alone. Rows that share a doc_id stand next
    to each other in the order of a hash of their texts.
    """
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, tokenizer, path, end)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data, cuts = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            checks = [zlib.crc32(data[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    read = read_token_files(docs.sparkSession.read.parquet(path))
    return read.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""MinHash near-dedup with DartMinHash signatures.

A document is its shingles of five words, each with its number of occurrences for
a weight, and two documents are as similar as their weighted Jaccard similarity:
the sum of the lesser weights by that of the greater ones. A shingle throws darts:
points of a Poisson process over weight and rank, with a coordinate each, all
derived from its hash; those above its weight don't count. A coordinate of the
signature is the dart of least rank there. Darts are thrown region by region of
(weight, rank), so a document of any length throws about COORDINATES *
ln(COORDINATES) of them instead of COORDINATES per shingle.

Equal documents are one node. Nodes that agree in one of the bands are candidates.
Each is compared, by the exact similarity, with the most central member of its
bucket, not with all. Two members of which one isn't similar to the centre can
only be similar if they differ from the centre in the same shingles; so what is
left is joined on such differences, and every pair in a bucket is settled
without being formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, join_sized, named, stored, text_slices

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares one of 40 bands of 7 with probability 1 - 8e-5.
BANDS, ROWS = 40, 7
COORDINATES = BANDS * ROWS
#: Classes of more than such a part of all rows (so there are no more classes than that) are joined by broadcast.
LARGE_SHARE = 1_000
#: Hot sides of the verifying join are dealt over so many parts.
SALTS = 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and where each text's words begin (one entry more than texts)."""
    words = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+")
    offsets, flat = words.offsets.to_numpy(), words.flatten()
    coded = flat.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    real = ~empty[codes]
    upto = np.concatenate(([0], np.cumsum(real)))
    return hashes[codes][real], upto[offsets]


def weighted_shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, how often each occurs, and where each text's begin.

    A text with fewer words than a shingle has one shingle of all of them; one
    without words has none.
    """
    hashes, begins = word_hashes(texts)
    counts = np.diff(begins)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(begins[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(doc), np.uint64)
    for k in range(words):
        inside = first + k < begins[1:][doc]
        out = np.where(inside, mixed(out * np.uint64(31) + hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] + np.uint64(k + 1)) if len(hashes) else out, out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    at = np.flatnonzero(fresh)
    weights = np.diff(np.append(at, len(out)))
    return out[at], weights, np.searchsorted(doc[at], np.arange(len(counts) + 1))


def copies_apart(elements: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sets as plain ones: an element of weight w is w elements, so that counting them gives weighted similarities."""
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    out = np.repeat(elements, weights)
    again = nth > 0
    out[again] = mixed(out[again] + _M1 * nth[again].astype(np.uint64))
    return out, np.concatenate(([0], np.cumsum(weights)))[begins]


def _poisson_steps(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number, for drawing one from a uniform number."""
    term, total, out = np.exp(-mean), 0.0, []
    for k in range(int(4 * mean) + 30):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return np.array(out)


def _regions():
    """(begin, end) of the regions of rank: half as far again each, and none of more than 16 expected darts."""
    begin, end = 0.0, 0.125
    while True:
        parts = int(np.ceil((end - begin) / 16))
        for k in range(parts):
            yield begin + (end - begin) * k / parts, begin + (end - begin) * (k + 1) / parts
        begin, end = end, end * 1.5


#: Weights are cut into strips at these edges, then at every further multiple of the last one.
_EDGES = np.array([0, 1, 2, 4, 8, 16], np.float64)


def _strips(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each weight the strips below it: which weight, the strip's number, where it begins and its width."""
    top = _EDGES[-1]
    inner = np.searchsorted(_EDGES, np.minimum(weights, top), side="left")
    n = inner + np.ceil(np.maximum(weights - top, 0) / top).astype(np.int64)
    which = np.repeat(np.arange(len(weights)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    last = len(_EDGES) - 1
    begin = np.where(nth < last, _EDGES[np.minimum(nth, last)], top * (nth - last + 1))
    width = np.where(nth < last, np.diff(_EDGES)[np.minimum(nth, last - 1)], top)
    return which, nth, begin, width


def signatures(elements: np.ndarray, begins: np.ndarray, coordinates: int = COORDINATES, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: for each weighted set the least rank of a dart in each coordinate; inf all through for the empty set.

    Two sets agree in a coordinate with the probability of their weighted Jaccard
    similarity. Weights are positive numbers, 1 if none are given. An element throws
    a Poisson number of darts into each region (a strip of weight by an interval of
    rank), one for each unit of area on average; those above its weight miss. A set
    goes on until all coordinates are filled; what later intervals hold ranks higher,
    so nothing is lost by stopping.
    """
    n = len(begins) - 1
    best = np.full((n, coordinates), np.inf)
    flat = best.ravel()
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    total = np.concatenate(([0.0], np.cumsum(weights)))[begins]
    total = np.diff(total)
    which, nth, bottom, width = _strips(weights)
    throwing, weight = mixed(elements[which] + _M1 * nth.astype(np.uint64)), weights[which]
    cuts = np.searchsorted(which, begins)
    sizes = np.diff(cuts)
    plain = bool((width == 1).all())
    wanted = coordinates * (np.log(coordinates) + 1.0)
    active = np.flatnonzero(sizes)
    for r, (low, high) in enumerate(_regions()):
        if not len(active):
            return best
        count = sizes[active]
        doc = np.repeat(active, count)
        at = np.repeat(cuts[active] - (np.cumsum(count) - count), count) + np.arange(len(doc))
        seed = mixed(throwing[at] ^ np.uint64(int(_M2) * (r + 1) & (1 << 64) - 1))
        chance = (seed >> np.uint64(11)) * 2.0**-53
        if plain:
            number = np.searchsorted(_poisson_steps(high - low), chance, side="right")
        else:
            number = np.zeros(len(at), np.int64)
            for w in np.unique(width[at]):
                some = width[at] == w
                number[some] = np.searchsorted(_poisson_steps((high - low) * w), chance[some], side="right")
        thrown = np.repeat(np.arange(len(at)), number)
        dart = mixed(seed[thrown] + _M1 * (np.arange(len(thrown)) - np.repeat(np.cumsum(number) - number, number) + 1).astype(np.uint64))
        if not (plain and (weight == 1).all()):
            of = at[thrown]
            hit = bottom[of] + width[of] * ((mixed(dart ^ _M2) >> np.uint64(11)) * 2.0**-53) < weight[of]
            thrown, dart = thrown[hit], dart[hit]
        coordinate = ((dart >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)
        rank = low + (high - low) * ((mixed(dart) >> np.uint64(11)) * 2.0**-53)
        np.minimum.at(flat, doc[thrown] * coordinates + coordinate.astype(np.int64), rank)
        enough = active[high * total[active] >= wanted]
        filled = enough[~np.isinf(best[enough]).any(axis=1)]
        active = np.setdiff1d(active, filled, assume_unique=True)


def band_hashes(ranks: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = ranks.shape
    bits = ranks.view(np.uint64).reshape(n, k // rows, rows)
    out = np.zeros((n, k // rows), np.uint64)
    for j in range(rows):
        out = mixed(out * np.uint64(31) + bits[:, :, j])
    return mixed(out + np.arange(k // rows, dtype=np.uint64)).view(np.int64)


def _nodes(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one. Among n sets two meet by chance n * n / 2^65 times."""
    out = np.zeros(len(begins) - 1, np.uint64)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = mixed(np.add.reduceat(mixed(elements), begins[some]) + np.diff(begins)[some].astype(np.uint64))
    return out.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, text) to (row, key, node, buckets)."""
    for batch in batches:
        for part in text_slices(batch, "text", 500_000):
            elements, weights, begins = weighted_shingles(part.column("text"))
            hashes = band_hashes(signatures(elements, begins, weights=weights))
            used = np.where(np.diff(begins) > 0, BANDS, 0)
            nodes = _nodes(*copies_apart(elements, weights, begins))
            buckets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(used))), pa.int32()), pa.array(hashes[used > 0].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), pa.array(nodes), buckets], names=["row", "key", "node", "buckets"])
        pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (node, shingles)."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            elements, begins = copies_apart(*weighted_shingles(part.column("text")))
            sets = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(elements, begins)), sets], names=["node", "shingles"])


def _components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the edges (a, b), by hooking and jumping.

    In each round every node takes the least label among its own, its neighbours'
    and its label's; a star needs two rounds, a chain about the logarithm of its
    length. Messages are combined before they are shuffled.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = before = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # a label hears of what its members hear of, and then tells it to all that bear it
        hooked = labels.join(near, "node")
        told = hooked.groupBy("label").agg(F.min("near").alias("least"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        best = told.join(own, "label", "left").select("label", F.least("least", F.coalesce("up", "label"), "label").alias("to"))
        fresh = stored(labels.join(best, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved")))
        forget(before)
        before, labels = fresh, fresh.drop("moved")
        if fresh.where("moved").limit(1).count() == 0:
            forget(both)
            return labels


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (node, pivot) with the sizes n and m of their sets and differs, the shingles that only one has.

    A central member takes part in a pair with each of its bucket: its set is
    sent once to each of the SALTS parts, and the pairs are dealt over them.
    """
    left = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sets.withColumnRenamed("shingles", "x"), "node")
    centres = pairs.select(F.col("pivot").alias("node")).distinct().join(sets, "node")
    right = centres.select(F.col("node").alias("pivot"), F.col("shingles").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    differs = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    return left.join(right, ["pivot", "salt"]).select("node", "pivot", F.size("x").alias("n"), F.size("y").alias("m"), differs.alias("differs"))


def _similar(both: Column, differ: Column, similarity: float) -> Column:
    """Whether sets of `both` elements in all that differ in `differ` of them have the Jaccard similarity."""
    return both - differ >= similarity * (both + differ) - 1e-9


def _across(compared: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs (a, b) among the nodes compared with one pivot, of which one at least isn't similar to it.

    With q = (1 - s) / (1 + s), x and y are similar if their differences from the
    pivot, X and Y, share at least (|X| + |Y| - q (|x| + |y|)) / 2 shingles. As x
    isn't similar to the pivot p, e = |X| - q (|x| + |p|) is positive, and as
    |y| <= |p| + |Y|, they share more than (1 - q) / 2 of Y, and e / (1 + q). So, with
    shingles in one order, rarest first, they share one of the first that such a
    number leaves: only those are joined, and only where their places leave room
    for as many. Shingles that one difference alone holds don't count. Similarity
    then follows from the differences.
    """
    q = (1 - similarity) / (1 + similarity)
    excess = F.size("differs") - q * (F.col("n") + F.col("m"))
    # a set with its far members only: where all are similar to the pivot nothing is left to do
    rows = compared.withColumns({"far": ~_similar(F.col("n") + F.col("m"), F.size("differs"), similarity), "excess": excess})
    wanted = rows.where("far").select("pivot").distinct()
    rows = stored(rows.join(wanted, "pivot", "left_semi"))
    each = rows.select("pivot", "node", "far", "excess", "n", F.size("differs").alias("d"), F.explode("differs").alias("shingle"))
    common = each.groupBy("pivot", "shingle").agg(F.count("*").alias("often"))
    own = W.partitionBy("pivot", "node")  # no more rows than a text has shingles
    placed = each.join(common, ["pivot", "shingle"]).where("often > 1")
    placed = placed.withColumns({"place": F.row_number().over(own.orderBy("often", "shingle")), "all": F.count("*").over(own)})
    least = lambda share: F.greatest(F.ceil(share - 1e-6), F.lit(1))
    index = placed.where(F.col("place") <= F.col("all") - least((1 - q) / 2 * F.col("d")) + 1)
    probe = placed.where(F.col("far") & (F.col("place") <= F.col("all") - least(F.col("excess") / (1 + q)) + 1))
    index = index.select("pivot", "shingle", F.col("node").alias("b"), F.col("far").alias("far_b"), *(F.col(c).alias(f"{c}_b") for c in ("place", "all", "d", "n")))
    probe = probe.select("pivot", "shingle", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("place", "all", "d", "n")))
    # at most so many shingles can be shared before and after this one
    most = F.least("place_a", "place_b") + F.least(F.col("all_a") - F.col("place_a"), F.col("all_b") - F.col("place_b"))
    enough = most >= (F.col("d_a") + F.col("d_b") - q * (F.col("n_a") + F.col("n_b"))) / 2 - 1e-6
    once = (F.col("a") != F.col("b")) & (~F.col("far_b") | (F.col("a") < F.col("b")))
    met = probe.join(index, ["pivot", "shingle"]).where(once & enough).select("pivot", "a", "b").distinct()
    side = lambda x: rows.select("pivot", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("differs").alias(f"d_{x}"))
    known = met.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
    differ = F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
    return known.where(_similar(F.col("n_a") + F.col("n_b"), differ, similarity)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, node, label) of each (row, text): equal labels are one class of near duplicates.

    row is any key of the caller. Null texts count as empty; texts without words
    are equal to each other and similar to nothing else. Repeated rows repeat, and
    columns besides row and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    # rows may be null, and of several texts; the key finds a node's text again
    marked = docs.select("row", F.xxhash64("row", text).alias("key"), text.alias("text"))
    kind = dict(docs.dtypes)["row"]
    prints = stored(marked.mapInArrow(_bands, f"row {kind}, key long, node long, buckets array<long>"))
    # rows of a node have equal buckets, so any stands for all
    nodes = stored(prints.groupBy("node").agg(F.min("key").alias("key"), F.first("buckets").alias("buckets")))
    each = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    together = stored(each.join(sizes, "bucket"))
    popular = together.groupBy("node").agg(F.sum("n").alias("weight"))
    members = together.drop("n").join(popular, "node")
    # the most central member of each bucket: that which shares buckets with most
    pivots = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("pivot"))
    members = stored(members.select("bucket", "node").join(pivots, "bucket"))
    chosen = stored(members.select("node").distinct().join(nodes.select("node", "key"), "node").select("key").distinct())
    forget(together, nodes)
    sets = stored(join_sized(marked.select("key", "text"), chosen, ["key"], "left_semi").select("text").mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]))
    forget(chosen)
    # first each node meets the centre that it shares most buckets with
    shared = members.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", "pivot")).getField("pivot").alias("pivot"))
    alike = lambda df: df.where(_similar(F.col("n") + F.col("m"), F.size("differs"), similarity)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = stored(alike(_compared(best, sets)))
    labels = _components(links)
    # then, in buckets that still lie in several components, all other members too
    tagged = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = tagged.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    open_ = members.join(spread, "bucket", "left_semi").where("node != pivot").select("node", "pivot").distinct()
    compared = stored(_compared(open_, sets))
    all_links = stored(links.unionByName(alike(compared)).unionByName(_across(compared, similarity)))
    forget(links, sets, members, compared)
    labels = _components(all_links)
    forget(all_links)
    return prints.join(labels, "node", "left").select("row", "node", F.coalesce("label", "node").alias("label"))


def near_dup_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size of every row of docs.

    Rows with a null doc_id keep it and take part like any other.
    """
    rows = stored(near_duplicates(docs.select(F.col("doc_id").alias("row"), "text")))
    classes = stored(rows.groupBy("label").agg(F.min("row").alias("class_id"), F.count("*").alias("class_size")))
    # the few classes that hold many rows are sent to all of them instead of being joined in one task each
    large = F.broadcast(classes.where(F.col("class_size") > F.lit(rows.count() / LARGE_SHARE)))
    met = rows.join(large, "label").unionByName(rows.join(large.select("label"), "label", "left_anti").join(classes, "label"))
    return met.select(F.col("row").alias("doc_id"), "class_id", "class_size")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each class of near duplicates: that with the least doc_id (null last).

    Rows that share a doc_id are told apart by a hash of their text; of equal
    rows one stays; an empty table stays empty, and other columns may have any name. Texts are only shuffled where the kept keys are too many to be
    broadcast, and those of equal rows.
    """
    key = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    marked = stored(docs.select("doc_id", key.alias("row")))
    rows = stored(near_duplicates(docs.select(key.alias("row"), "text")).select("row", "label").distinct())
    first = rows.join(marked.distinct(), "row").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).getField("row").alias("__row"))
    chosen = stored(first.select("__row"))
    again = stored(marked.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1").select("__row"))
    names = docs.columns
    kept = join_sized(docs.select(F.struct(*named(names)).alias("__doc"), key.alias("__row")), chosen, ["__row"], "left_semi")
    if again.limit(1).count():
        equal = join_sized(kept, again, ["__row"], "left_semi").withColumn("__n", F.row_number().over(W.partitionBy("__row").orderBy("__row"))).where("__n = 1").drop("__n")
        kept = join_sized(kept, again, ["__row"], "left_anti").unionByName(equal)
    return kept.select(*(F.col("__doc").getField(x).alias(x) for x in names))

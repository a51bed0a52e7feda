"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary texts.

A model gives a word its probability after the word before it. Pairs of words that
are frequent in toxic texts have discounted counts of their own; the mass that this
leaves goes to the word alone, which is spelled out: it has the probability of its
first letters times that of each further step down the tree of prefixes. A step is a
beginning and what follows it; its counts are discounted too, and what the discount
sets free goes by Kneser-Ney's continuation counts: after how many different
beginnings of that length the whole corpus has what follows, labelled or not. These
counts the classes share. A pair or step speaks only if the numbers of texts of either
class make it likely enough that the classes differ in it more than in what it
continues; all others have the probability of a third model, of both classes' counts
together, in both models. So an expression too rare to tell the classes apart says
what its known beginning says, and factors that both models share cancel and are left
out.

A text is scored by the difference of the two log-likelihoods of its most toxic
windows, divided by the words in these, as a few words of abuse would vanish in the
mean of a long text. A
logistic curve, fitted on training rows that the models haven't seen, turns that into
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, text_slices

#: Kneser-Ney discount; the least number of occurrences of a prefix (both classes) and of toxic texts with a pair that make it known; and
#: the gain in log-likelihood (over the classes' shares being those of what it continues) from which it speaks: 12.5 makes one of 100,000
#: by chance. Below what speaks already, less will do.
DISCOUNT, LEAST, GAIN, GAIN_BELOW = 0.75, 4, 12.5, 5.0
#: Prefixes of so many letters are steps of the tree, then the whole word.
STEPS = range(3, 9)
#: Words of a window, and how many of a text's windows are scored.
WINDOW, WORST = 16, 4
#: At most so many labelled rows are learned from, those of the least hash; one of HELD_BACK of them serves the calibration instead.
TRAIN_ROWS, HELD_BACK = 100_000, 8
#: Tasks that count known pairs in the learned rows. There are no more of these in a larger corpus, and each task has a row for each pair it meets.
LEARNERS = 16
FOLDS = 5
_TRIM = ".,;:!?\"'()[]{}#*$%&|<>-_=+~`"
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words without punctuation at their ends, the code of each word, and where each text's begin."""
    words = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+")
    coded = words.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=_TRIM)
    real = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    keep = real[codes]
    upto = np.concatenate(([0], np.cumsum(keep)))
    return plain, codes[keep], upto[words.offsets.to_numpy() - words.offsets[0].as_py()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (word, n0, n1, t0, t1): a slice's words with their occurrences in texts of either class, and the numbers of such texts."""
    for batch in batches:
        for part in text_slices(batch, "text", 8_000_000):
            words, codes, begins = _words(part.column("text"))
            if not len(codes):
                continue
            toxic = pc.fill_null(part.column("toxic"), 2).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            once = np.unique(text * len(words) + codes)
            count = lambda word, at: [np.bincount(word[toxic[at] == c], minlength=len(words)) for c in (0, 1)]
            columns = [words, *map(pa.array, count(codes, text)), *map(pa.array, count(once % len(words), once // len(words)))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n0", "n1", "t0", "t1"]).filter(pa.array(np.bincount(codes, minlength=len(words)) > 0))


def _string_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs, from those of their words."""
    x = (first * _MIX + second) ^ (second >> np.uint64(29))
    return (x ^ (x >> np.uint64(32))) * _MORE


def _neighbours(words: pa.Array, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word but the first of its text: its place, its pair's hash with the word before, and its text."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.flatnonzero(text[1:] == text[:-1]) + 1
    hashes = _string_hashes(words)
    return at, _pair_hashes(hashes[codes[at - 1]], hashes[codes[at]]) if len(at) else np.zeros(0, np.uint64), text[at]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (pair, first, second, n, t): a slice's pairs of neighbours."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            words, codes, begins = _words(part.column("text"))
            at, pair, text = _neighbours(words, codes, begins)
            keys, where, which, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            t = np.bincount(np.unique(text * np.int64(max(len(keys), 1)) + which) % max(len(keys), 1), minlength=len(keys))
            one = at[where] if len(keys) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), words.take(pa.array(codes[one - 1])), words.take(pa.array(codes[one])), pa.array(n), pa.array(t)], names=["pair", "first", "second", "n", "t"]
            )


def _known_pairs(keys: np.ndarray):
    """(text) to (pair, n, t) for the given pairs (sorted hashes) alone: one row a task for each pair that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                _, pair, text = _neighbours(*_words(part.column("text")))
                place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[place] == pair
                n += np.bincount(place[hit], minlength=len(keys))
                t += np.bincount(np.unique(text[hit] * np.int64(len(keys)) + place[hit]) % len(keys), minlength=len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some]), pa.array(t[some])], names=["pair", "n", "t"])

    return run


def _gain(ones: Column, zeros: Column, of_ones: Column, of_zeros: Column) -> Column:
    """Log-likelihood of so many texts of either class under their own shares over that under the shares of of_ones and of_zeros."""
    share, n = of_ones / (of_ones + of_zeros), ones + zeros
    part = lambda k, q: F.when((k > 0) & (q > 0), k * F.log(k / (n * q))).otherwise(0.0)
    return part(ones, share) + part(zeros, 1 - share)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _marked(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))


def _held_back(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_BACK)) == 0


def counts(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, pairs) as stored tables, from (doc_id, text) and the rows to learn from (doc_id, toxic), at most TRAIN_ROWS.

    words: word, n0, n1 (occurrences in texts of either class), t0, t1 (such texts) of
    all words of the corpus. pairs: first, second and the same of the pairs that LEAST
    toxic texts hold. Of equal labelled texts of a class one is learned from; the
    texts learned from are put aside, so that pairs don't read the corpus again.
    """
    marked = F.broadcast(marked)
    text = F.coalesce("text", F.lit(""))
    own = docs.join(marked, "doc_id").select("doc_id", "toxic", F.xxhash64(text).alias("h"))
    chosen = stored(own.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))  # no more rows than marked has
    rows = docs.join(F.broadcast(chosen), "doc_id", "left").select(text.alias("text"), "toxic")
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    words = stored(rows.mapInArrow(_counted, "word string, n0 long, n1 long, t0 long, t1 long").groupBy("word").agg(*sums("n0", "n1", "t0", "t1")))
    learned = stored(docs.join(F.broadcast(chosen), "doc_id").select(text.alias("text"), "toxic"), "zstd")
    found = learned.where("toxic = 1").select("text").mapInArrow(_pairs, "pair long, first string, second string, n long, t long")
    ones = stored(found.groupBy("pair", "first", "second").agg(F.sum("n").alias("n1"), F.sum("t").alias("t1")).where(F.col("t1") >= LEAST))
    # what so many toxic training texts hold in common is bounded by TRAIN_ROWS, whatever the corpus
    keys = np.sort(ones.select("pair").toPandas()["pair"].to_numpy(np.int64, copy=True).view(np.uint64))
    if len(keys):
        zeros = learned.where("toxic = 0").select("text").coalesce(LEARNERS).mapInArrow(_known_pairs(keys), "pair long, n long, t long").groupBy("pair").agg(F.sum("n").alias("n0"), F.sum("t").alias("t0"))
    else:
        zeros = ones.select("pair", F.col("n1").alias("n0"), F.col("t1").alias("t0"))
    pairs = stored(ones.join(zeros, "pair", "left").select("first", "second", F.coalesce("n0", F.lit(0)).alias("n0"), "n1", F.coalesce("t0", F.lit(0)).alias("t0"), "t1"))
    forget(ones, learned, chosen)
    return words, pairs


def _path(word: Column) -> Column:
    """The keys on the way to a word: its prefixes, and the word with a blank at its end."""
    size = F.length(word)
    prefixes = F.transform(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k < size), lambda k: F.substring(word, F.lit(1), k))
    return F.concat(prefixes, F.array(F.concat(word, F.lit(" "))))


def steps(words: DataFrame) -> DataFrame:
    """key, level, p0, p1, shared, gain and the counts of each known step down the tree of prefixes.

    p0 and p1 are its probabilities after the beginning that it continues: discounted
    counts of the class, and the mass that this leaves by continuation counts of the
    corpus (after how many beginnings of that length what follows stands, of all that
    stands after such beginnings). shared is the same of both classes' counts together.
    """
    way = _path(F.col("word"))
    numbers = ("n0", "n1", "t0", "t1")
    each = words.withColumn("way", way).select(*numbers, F.posexplode("way").alias("i", "key"), "way")
    each = each.withColumn("parent", F.when(F.col("i") == 0, F.lit("")).otherwise(F.get("way", F.col("i") - 1)))
    known = stored(each.groupBy("key", "parent").agg(*(F.sum(c).alias(c) for c in numbers)))
    known = known.withColumns({"depth": F.length("parent"), "follows": F.expr("substring(key, length(parent) + 1)")})
    histories = known.groupBy("depth", "follows").agg(F.count("*").alias("histories"))
    among = known.groupBy("depth").agg(F.count("*").alias("among"))  # one row for each of STEPS and the root
    some = lambda n: F.sum((n > 0).cast("long"))
    below = known.groupBy("parent").agg(*(some(F.col(f"n{c}")).alias(f"kinds{c}") for c in (0, 1)), some(F.col("n0") + F.col("n1")).alias("kinds"))
    up = known.select(F.col("key").alias("parent"), *(F.col(c).alias(f"of_{c}") for c in numbers))
    root = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"of_{c}") for c in numbers)).select(F.lit("").alias("parent"), *(f"of_{c}" for c in numbers))
    known = known.where(F.col("n0") + F.col("n1") >= LEAST).join(below, "parent").join(up.unionByName(root), "parent")
    known = known.join(histories, ["depth", "follows"]).join(F.broadcast(among), "depth")
    continued = F.col("histories") / F.col("among")

    def p(n: Column, of: Column, kinds: str) -> Column:
        return F.when(of > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / of + DISCOUNT * F.col(kinds) / of * continued).otherwise(continued)

    p0, p1 = (p(F.col(f"n{c}"), F.col(f"of_n{c}"), f"kinds{c}") for c in (0, 1))
    shared = p(F.col("n0") + F.col("n1"), F.col("of_n0") + F.col("of_n1"), "kinds")
    gain = F.when((F.col("of_n0") > 0) & (F.col("of_n1") > 0), _gain(F.col("t1"), F.col("t0"), F.col("of_t1"), F.col("of_t0"))).otherwise(0.0)
    level = F.when(F.col("key").endswith(" "), F.lit(max(STEPS) + 1)).otherwise(F.length("key"))
    return known.select("key", level.cast("int").alias("level"), p0.alias("p0"), p1.alias("p1"), shared.alias("shared"), gain.alias("gain"), "n0", "n1", "t0", "t1")


def _along(step: Column, a: Column) -> Column:
    """One step of a way: from (lp0, lp1, rest) with what speaks in either model, and the logarithm of what both share."""
    spoken = F.coalesce(step["gain"] >= F.when(a["lp0"] != a["lp1"], GAIN_BELOW).otherwise(GAIN), F.lit(False))
    return F.struct(
        F.when(spoken, a["lp0"] + F.log(step["p0"])).otherwise(a["lp0"]).alias("lp0"), F.when(spoken, a["lp1"] + F.log(step["p1"])).otherwise(a["lp1"]).alias("lp1"),
        F.when(spoken, a["rest"]).otherwise(a["rest"] + F.log(step["shared"])).alias("rest"),
    )


def _folded(ways: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """key with x, the outcome of _along over the known steps of its way: at most len(STEPS) + 1 rows each."""
    met = ways.select(*key, F.explode("way").alias("step")).join(known.withColumnRenamed("key", "step"), "step")
    line = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("level", "gain", "p0", "p1", "shared"))).alias("line"))
    start = F.struct(F.lit(0.0).alias("lp0"), F.lit(0.0).alias("lp1"), F.lit(0.0).alias("rest"))
    return line.select(*key, F.aggregate("line", start, lambda a, s: _along(s, a)).alias("x"))


def speaking(known: DataFrame) -> DataFrame:
    """key, lp0 and lp1 of the steps that speak: what their way says in either model. Steps that say what they continue says are left out.

    known is a stored table steps(words).
    """
    loud = known.where(F.col("gain") >= GAIN_BELOW)
    word = F.regexp_replace("key", " $", "")
    way = F.concat(F.transform(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k < F.length("key")), lambda k: F.substring(word, F.lit(1), k)), F.array("key"))
    out = _folded(loud.select("key", F.array_distinct(way).alias("way")), ["key"], loud)
    return out.where("x.lp0 != x.lp1").select("key", "x.lp0", "x.lp1")


def speaking_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """first, second, lp0 and lp1 of the pairs that speak, without the factors that both models share.

    P(second | first) is the pair's discounted count by that of the first word, and the
    mass that the first word's known pairs leave times P(second).
    """
    alone = known.where(F.col("key").endswith(" ")).select(F.regexp_replace("key", " $", "").alias("word"), *(F.col(c).alias(f"w_{c}") for c in ("n0", "n1", "t0", "t1")))
    rows = pairs.join(alone.select(F.col("word").alias("first"), F.col("w_n0").alias("of0"), F.col("w_n1").alias("of1")), "first").join(alone.select(F.col("word").alias("second"), "w_t0", "w_t1"), "second")
    taken = lambda c: F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"of{c}"), F.lit(1))
    left = rows.groupBy("first").agg(*(F.greatest(1 - F.sum(taken(c)), F.lit(1e-6)).alias(f"left{c}") for c in (0, 1)))
    seconds = _folded(rows.select("second").distinct().withColumn("way", _path(F.col("second"))), ["second"], known)
    rows = rows.join(left, "first").join(seconds, "second")
    gain = _gain(F.col("t1"), F.col("t0"), F.col("w_t1"), F.col("w_t0"))
    rows = rows.where(gain >= F.when(F.col("x.lp0") != F.col("x.lp1"), GAIN_BELOW).otherwise(GAIN))
    lp = lambda c: F.log(taken(c) * F.exp(-F.col("x.rest")) + F.col(f"left{c}") * F.exp(f"x.lp{c}")).alias(f"lp{c}")
    return rows.select("first", "second", lp(0), lp(1))


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, pairs) that speak, as stored tables of (key, lp0, lp1) and (first, second, lp0, lp1).

    docs: (doc_id, text); labels: (doc_id, toxic). Labels that are neither 0 nor 1
    and rows without a label are left out. Without rows of both classes nothing speaks.
    """
    marked = _marked(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    words, pairs = counts(docs, marked)
    known = stored(steps(words))
    out = stored(speaking(known)), stored(speaking_pairs(pairs, known))
    forget(words, pairs, known)
    return out


class Model:
    """What speaks, as sorted hashes with both models' logarithms; its size is bounded by TRAIN_ROWS, as only what differs in their texts speaks."""

    def __init__(self, words: pd.DataFrame, pairs: pd.DataFrame):
        keys = _string_hashes(pa.array(words["key"].tolist(), pa.string()))
        first, second = (_string_hashes(pa.array(pairs[c].tolist(), pa.string())) for c in ("first", "second"))
        self.words, self.pairs = (self._sorted(k, df) for k, df in ((keys, words), (_pair_hashes(first, second) if len(first) else first, pairs)))

    @staticmethod
    def _sorted(keys: np.ndarray, df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], df[["lp0", "lp1"]].to_numpy(float)[order]

    @staticmethod
    def put(out: np.ndarray, which: np.ndarray, wanted: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> None:
        keys, values = table
        if len(which) and len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[which[hit]] = values[at[hit]]


def word_logs(words: pa.Array, model: Model) -> np.ndarray:
    """Of each word both models' logarithms: those of the longest step of its way that speaks; 0 if none does."""
    out = np.zeros((len(words), 2))
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for k in STEPS:
        which = np.flatnonzero(sizes > k)
        Model.put(out, which, _string_hashes(pc.utf8_slice_codeunits(words.take(pa.array(which)), 0, k)), model.words)
    Model.put(out, np.arange(len(words)), _string_hashes(pc.binary_join_element_wise(words, "", " ")), model.words)
    return out


def worst_windows(texts: pa.Array, model: Model) -> np.ndarray:
    """Of each text both models' log-likelihoods a word, over the words of the WORST windows where they differ most; 0 for a text without words."""
    words, codes, begins = _words(texts)
    out = np.zeros((len(begins) - 1, 2))
    if not len(codes):
        return out
    logs = word_logs(words, model)[codes]
    if len(model.pairs[0]):
        at, pair, _ = _neighbours(words, codes, begins)
        Model.put(logs, at, pair, model.pairs)
    upto = np.concatenate((np.zeros((1, 2)), np.cumsum(logs, axis=0)))
    count = np.diff(begins)
    windows = -(-count // WINDOW)
    doc = np.repeat(np.arange(len(count)), windows)
    first = np.cumsum(windows) - windows
    low = begins[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    high = np.minimum(low + WINDOW, begins[doc + 1])
    said = upto[high] - upto[low]
    # windows of a text by what they say, the worst last
    order = np.lexsort((said[:, 1] - said[:, 0], doc))
    worst = order[np.arange(len(doc)) >= (first + windows)[doc] - WORST]
    np.add.at(out, doc[worst], said[worst])
    scored = np.bincount(doc[worst], weights=(high - low)[worst], minlength=len(out))
    return out / np.maximum(scored, 1)[:, None]


def likelihoods(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ll_toxic and ll_ordinary (a word, in the worst windows) of each row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                logs = worst_windows(part.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(logs[:, 1].copy()), pa.array(logs[:, 0].copy())], names=["doc_id", "ll_toxic", "ll_ordinary"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, ll_toxic double, ll_ordinary double")


def calibrate(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of (ratio, toxic), from counts in bins of a 400th.

    A weak pull towards slope 0 keeps the curve finite where the classes are apart.
    """
    bins = rows.groupBy(F.least(F.greatest(F.round(F.col("ratio") * 400), F.lit(-8000)), F.lit(8000)).cast("int").alias("bin")).agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).toPandas()
    if bins.empty or not bins["n1"].sum() or not bins["n0"].sum():
        return 0.0, -1.0
    x = np.concatenate([bins["bin"], bins["bin"]]).astype(float) / 400
    y = np.repeat([0.0, 1.0], len(bins))
    weight = np.concatenate([bins["n0"], bins["n1"]]).astype(float)
    weight /= weight.sum()
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    pull = np.diag([1e-7, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - pull @ beta
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(curvature, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; ratio, and the log-likelihoods whose difference it is.

    Only labels of rows that aren't held out are used, and of these the model learns
    from all but those held back, on which the logistic curve is fitted (on all of
    them where those held back aren't of both classes). Null and empty texts have
    ratio 0 and get the score of that; without labels of both classes every score is
    below a half. Equal texts have equal scores; rows that share a doc_id are rows
    of their own, and share its label. Other columns are not read.
    """
    used = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = Model(*(df.toPandas() for df in train(docs.select("doc_id", "text"), used.where(~_held_back()))))
    scored = stored(likelihoods(docs, model).withColumn("ratio", F.col("ll_toxic") - F.col("ll_ordinary")))
    mine = scored.join(_marked(used), "doc_id").select("doc_id", "ratio", "toxic")
    back = mine.where(_held_back())
    slope, intercept = calibrate(back if back.select("toxic").distinct().count() == 2 else mine)
    score = 1 / (1 + F.exp(-(slope * F.col("ratio") + intercept)))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "ratio", "ll_toxic", "ll_ordinary")

"""Quality rules: robust multivariate outliers per language and source.

Each text gets a small vector of transformed statistics. For each (language,
source) group the minimum-covariance-determinant estimate is looked for by
concentration steps from several starts: keep the share COVERAGE of the rows that
lie closest to the present centre in Mahalanobis distance, estimate centre and
covariance from them, repeat as long as the determinant falls; of all starts that of
the least determinant counts. Rows beyond the chi-square cut are rejected. All steps
are DataFrame aggregations of at most one row per group, start and histogram bin, so
a group with a third of all rows is combined on the map side like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, forget, join_sized, named, null_safe_key, stored, text_of

#: Share of a group's rows that a concentration step keeps.
COVERAGE = 0.75
#: Steps end where no start's log-determinant falls by more than STEP_GAIN; that they don't in STEPS steps is an error.
STEP_GAIN, STEPS = 1e-4, 200
#: Starts: medians and absolute deviations, all rows, and so many samples of a tenth of the rows each, told by a hash.
SAMPLES = 2
#: Groups with fewer rows share the estimate of the other small groups of their language.
LEAST_ROWS = 50
#: Chance of rejecting a Gaussian row.
TAIL = 1e-9
#: Transformed statistics and the least standard deviation granted to each of them.
FEATURES = {"f_length": 0.08, "f_symbols": 0.3, "f_lines": 0.12, "f_repeats": 0.12}
#: Fixed grid that makes sums exact (and so independent of row order) and medians countable.
GRID = 1000

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(degrees // 2):
        term = term * half / k if k else 1.0
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns STATISTICS and base_failed.

    Null texts count as empty: all statistics are 0 and base_failed is true.
    Columns of the same names are replaced.
    """
    t = F.col("__t")
    df = docs.drop(*STATISTICS, "base_failed").withColumn("__t", text_of(text))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumns({"__w": F.regexp_extract_all(t, F.lit(WORD), 0), "__l": lines})
    w = F.col("__w")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumns({
        "__h": F.coalesce(grams, F.array().cast("array<bigint>")),
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    }).drop("__w", "__l", "__t")
    # windows that occur twice: sort (hash, position) and compare with both neighbours
    h = F.col("__h")
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_features(df: DataFrame) -> DataFrame:
    """The transformed statistics on the fixed grid, as integers, and the group's key.

    Mean word length is a logarithm that is drawn in for short texts; symbols are
    a logarithm of their share; repeated lines and words are shares.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    features = {
        "f_length": F.log(F.greatest(chars, F.lit(1)) / F.greatest(n, F.lit(1)) / 5) * F.sqrt(n / (n + 200.0)),
        "f_symbols": F.log1p(100.0 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        "f_lines": F.col("n_dup_lines") / (F.col("n_dup_lines") + 10.0),
        "f_repeats": F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
    }
    df = df.withColumns({k: F.round(v * GRID).cast("long") for k, v in features.items()})
    return df.withColumns({"__lang": null_safe_key("lang"), "__source": null_safe_key("source")})


def _keyed(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row's estimate: its own group's, or that of its language's small groups."""
    return join_sized(df, groups, ["__lang", "__source"], "left")


def _quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The least binned value that a share q of each group's rows doesn't exceed, from exact counts."""
    counts = df.groupBy(*keys, value).count()
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    counts = counts.withColumns({"__upto": F.sum("count").over(upto), "__all": F.sum("count").over(whole)})
    return counts.where(F.col("__upto") >= q * F.col("__all")).groupBy(*keys).agg(F.min(value).alias("__q"))


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor l_jk."""
    y: list[Column] = []
    names = list(FEATURES)
    for j in range(p):
        v = F.col(names[j]) / GRID - F.col(f"m_{j}")
        for k in range(j):
            v = v - F.col(f"l_{j}_{k}") * y[k]
        y.append(v / F.col(f"l_{j}_{j}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


KEYS = ["__g", "__start"]


def _factored(cov: DataFrame, p: int) -> DataFrame:
    """m_j, the Cholesky factor of the covariances c_j_k, each with its floor added, and the log-determinant."""
    for j in range(p):
        for k in range(j + 1):
            v = F.col(f"c_{j}_{k}") + (list(FEATURES.values())[j] ** 2 if j == k else 0)
            for i in range(k):
                v = v - F.col(f"l_{j}_{i}") * F.col(f"l_{k}_{i}")
            cov = cov.withColumn(f"l_{j}_{k}", F.sqrt(F.greatest(v, F.lit(1e-9))) if j == k else v / F.col(f"l_{k}_{k}"))
    log_det = sum((2 * F.log(f"l_{j}_{j}") for j in range(1, p)), 2 * F.log("l_0_0"))
    return cov.select(*KEYS, *(f"m_{j}" for j in range(p)), *(f"l_{j}_{k}" for j in range(p) for k in range(j + 1)), log_det.alias("log_det"))


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """The estimate of each (group, start) from its rows; covariances are multiplied by scale. Sums are exact."""
    names, p = list(FEATURES), len(FEATURES)
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        *(exact(F.col(x)).alias(f"s_{j}") for j, x in enumerate(names)),
        *(exact(F.col(names[j]) * F.col(names[k])).alias(f"q_{j}_{k}") for j in range(p) for k in range(j + 1)),
    )
    mean = lambda j: F.col(f"s_{j}") / F.col("n")
    return _factored(
        sums.select(
            *KEYS,
            *((mean(j) / GRID).alias(f"m_{j}") for j in range(p)),
            *((scale * (F.col(f"q_{j}_{k}") / F.col("n") - mean(j) * mean(k)) / GRID**2).alias(f"c_{j}_{k}") for j in range(p) for k in range(j + 1)),
        ),
        p,
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Where concentration begins: start 0 from medians and absolute deviations, 1 from all rows, others from samples."""
    names, p = list(FEATURES), len(FEATURES)
    long = lambda df: df.select("__g", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(x).alias("v")) for j, x in enumerate(names)))).alias("x")).select("__g", "x.*")
    medians = stored(_quantile(long(rows), ["__g", "j"], "v", 0.5).groupBy("__g").pivot("j", list(range(p))).agg(F.first("__q")))
    away = join_sized(rows, medians, ["__g"]).select("__g", *(F.abs(F.col(x) - F.col(str(j))).alias(x) for j, x in enumerate(names)))
    mads = _quantile(long(away), ["__g", "j"], "v", 0.5).groupBy("__g").pivot("j", list(range(p))).agg(F.first("__q"))
    robust = medians.select("__g", F.lit(0).alias("__start"), *((F.col(str(j)) / GRID).alias(f"m_{j}") for j in range(p))).join(mads, "__g")
    robust = robust.withColumns({f"c_{j}_{k}": F.pow(1.4826 * F.col(str(j)) / GRID, F.lit(2)) if j == k else F.lit(0.0) for j in range(p) for k in range(j + 1)})
    chance = F.pmod(F.xxhash64(*names), F.lit(10))
    taken = F.array_compact(F.array(F.lit(1), *(F.when(chance == k, k + 2) for k in range(SAMPLES))))
    return _factored(robust, p).unionByName(_moments(rows.withColumn("__start", F.explode(taken)), 1.0))


def fit(statistics: DataFrame) -> DataFrame:
    """Estimates from rows with STATISTICS, lang and source: one row per language and source.

    Rows that fail the base rules take no part. The result has the keys __lang
    and __source, the centre m_j, the Cholesky factor l_j_k, and log_det, the least
    log-determinant that a start came to.
    """
    names, p = list(FEATURES), len(FEATURES)
    rows = with_features(statistics.where(~F.col("base_failed")))
    sizes = rows.groupBy("__lang", "__source").count()
    # the language's length tells where it ends; keys are never empty, so that of a language's small groups is nobody's own
    language = F.concat(F.length("__lang").cast("string"), F.lit(":"), "__lang")
    groups = stored(sizes.withColumn("__g", F.when(F.col("count") >= LEAST_ROWS, F.concat(language, "__source")).otherwise(language)).drop("count"))
    rows = stored(_keyed(rows, groups).select("__g", *names))
    kept = chi_square_quantile(COVERAGE, p)
    consistency = COVERAGE / chi_square(kept, p + 2)
    # a start's determinant is not one of COVERAGE of the rows: the first step always counts
    found = stored(_starts(rows).withColumns({"log_det": F.lit(float("inf")), "live": F.lit(True)}))
    for _ in range(STEPS):
        live = found.where("live")
        if live.limit(1).count() == 0:
            best = F.min_by(F.struct(*(c for c in found.columns if c not in ("live", *KEYS))), F.struct("log_det", "__start"))
            out = stored(groups.join(found.groupBy("__g").agg(best.alias("b")).select("__g", "b.*"), "__g").drop("__g"))
            forget(rows, found)
            return out
        near = join_sized(rows, live.drop("live", "log_det"), ["__g"]).withColumn("__d", F.floor(F.least(F.log2(1 + _distance(p)), F.lit(60.0)) * 64).cast("int")).select(*KEYS, "__d", *names)
        cut = stored(_quantile(near, KEYS, "__d", COVERAGE))
        now = _moments(join_sized(near, cut, KEYS).where(F.col("__d") <= F.col("__q")), consistency)
        both = live.select(F.struct("*").alias("old"), *KEYS).join(now.select(F.struct("*", F.lit(True).alias("live")).alias("new"), *KEYS), KEYS, "left")
        falls = F.coalesce(F.col("new.log_det") < F.col("old.log_det") - STEP_GAIN, F.lit(False))
        value = lambda c: F.when(falls, F.col("new").getField(c)).otherwise(F.col("old").getField(c)) if c != "live" else falls
        moved = both.select(*(value(c).alias(c) for c in found.columns))
        fresh = stored(found.where("not live").unionByName(moved))
        forget(found, cut)
        found = fresh
    raise ArithmeticError(f"determinants still fall after {STEPS} steps")


def judged(statistics: DataFrame, estimates: DataFrame) -> DataFrame:
    """statistics with distance (squared, to its group's centre) and kept.

    A row whose group has no estimate is judged by the base rules alone.
    """
    df = with_features(statistics)
    df = _keyed(df, estimates).withColumn("distance", _distance(len(FEATURES)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(1 - TAIL, len(FEATURES)), F.lit(True))
    return df.withColumn("kept", kept).select(*statistics.columns, "distance", "kept")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, STATISTICS, base_failed, distance and kept of every row of docs.

    Texts are read once; the statistics table (a few numbers a row) is stored and
    all estimation steps read that. An empty table gives an empty report.
    """
    statistics = stored(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(statistics, fit(statistics)).drop("lang", "source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever else they are called.

    Null texts count as empty, and a null language or source is one of its own; equal rows share their verdict. No rows give none.

    Rows are stored with their statistics: the estimation reads the statistics
    alone, and the verdict doesn't compute them again.
    """
    names = docs.columns
    rows = stored(with_statistics(docs.select(F.struct(*named(names)).alias("__row"), "text", "lang", "source")).drop("text"), "zstd")
    judged_ = judged(rows, fit(rows.drop("__row")))
    return judged_.where("kept").select(*(F.col("__row").getField(x).alias(x) for x in names))

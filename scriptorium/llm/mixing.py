"""Mixing sources to target weights by entropy balancing.

A document's rate is how often the mix should take it. Among all rates between 0
and MOST whose words add up to each source's target, entropy balancing takes those
closest to 1 in relative entropy. Their form is known: a document of x mean sizes
has the rate min(MOST, exp(dual * x)) with one dual a source, so long documents are
the first to be repeated or left out. The duals solve a convex problem by Newton
steps, each one distributed aggregation of gradient and curvature over the cells
(source, size bin), kept inside brackets that the least size gives.

Rates are rounded into whole copies along each source's bins, so that the copies add
up to the rates but for one document. Which documents of a bin take one copy more
than others is told by a hash: those up to a threshold, the exact order statistic
that leaves as many as are wanted. So what decides a document's copies is a table
with a row a bin, and texts needn't move to meet it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, WORD, forget, join_sized, null_safe_key, stored, text_of

#: The sources' weights by code point, repeating; the mix's share of all sizes; the most that a document is repeated.
WEIGHTS = [5.0, 2.0, 1.0]
SHARE, MOST = 1.5, 2.0
#: The relative error at which Newton steps end, and the number of steps after which it is an error that they don't.
NEWTON_ERROR, NEWTON_STEPS = 1e-9, 200
#: A bin is a BINS-th of a unit of the logarithm of the size.
BINS = 50
#: Hashes of a bin are split until a part holds about so many.
PART_ROWS = 200_000
CELL = ["__source", "__bin"]


def size_of(text: str = "text") -> Column:
    """The number of words, 0 for a null text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _bin(size: str) -> Column:
    return F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) * BINS).cast("int")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns: rows that share it are equal (or meet by chance). Maps are hashed as text."""
    return F.xxhash64(*(F.to_json(F.struct(name)) if "map<" in kind or kind == "variant" else F.col(f"`{name}`") for name, kind in df.dtypes))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, __source (never null), size, __bin and __hash of each row of docs."""
    df = docs.select("doc_id", "source", null_safe_key("source").alias("__source"), size_of().alias("size"), row_hash(docs).alias("__hash"))
    return df.withColumn("__bin", _bin("size"))


def targets(sizes: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """__source, source_size and target, from (source, __source, source_size), one row a source.

    Targets go by weight and stop at `most` times the source's size; the excess
    goes to the others by weight. That is one level t with
    sum(min(most * size, t * weight)) = share * sum(size): sources are capped in
    order of size by weight, and t follows from the running sums. The windows run
    over the sources (one row each), not over their documents.
    """
    # strings of Spark compare as UTF-8 bytes, which is the order of code points
    order = W.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)))
    df = df.withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "__source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    df = df.withColumn("__all", share * F.sum("source_size").over(whole))
    level = (F.col("__all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    df = df.withColumn("__level", level)
    # the first source in this order that its share doesn't fill sets the level for it and all later ones
    df = df.withColumn("__level", F.min(F.when(F.col("__level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "__source", "__level"))).over(whole)["__level"])
    return df.select("__source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("__level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def tilt(dual: Column, x: Column, most: float = MOST) -> Column:
    """The rate of a document of x mean sizes."""
    return F.exp(F.least(dual * x, F.lit(math.log(most))))


def balance(cells: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """__source and dual: the tilt under which each source's words add up to its target.

    cells: a stored table (__source, x, tokens), any number of rows a source, with
    x > 0; goals: (__source, target). With h(dual) = sum(tokens * tilt(dual, x)), a step
    aggregates h - target and h' = sum(tokens * x * tilt) over the cells below the
    cap. h grows with the dual; as no cell lies below the least x, the root lies
    between 0 and log(target / sum(tokens)) / min(x), or log(most) / min(x) above.
    A step that leaves the bracket, which each step narrows, halves it instead.
    Sources at the cap have an infinite dual, those without words the dual 0.
    """
    log_most = math.log(most)
    sums = cells.groupBy("__source").agg(F.sum("tokens").alias("all"), F.min("x").alias("x0"))
    state = goals.join(sums, "__source", "left").select(
        "__source", "target", F.coalesce("all", F.lit(0.0)).cast("double").alias("all"), F.lit(0.0).alias("dual"),
        F.when(F.col("target") < F.col("all"), F.log(F.col("target") / F.col("all")) / F.col("x0")).otherwise(0.0).alias("low"),
        F.when(F.col("target") < F.col("all"), 0.0).otherwise(log_most / F.col("x0")).alias("high"),
    )
    easy = (F.col("all") <= 0) | (F.col("target") <= 0) | (F.col("target") >= most * F.col("all") * (1 - 1e-12))
    state = stored(state.withColumn("done", F.coalesce(easy, F.lit(True))).withColumn("dual", F.when((F.col("all") > 0) & (F.col("target") >= most * F.col("all") * (1 - 1e-12)), F.lit(float("inf"))).otherwise(0.0)))
    for _ in range(NEWTON_STEPS):
        tried = state.where("not done").select("__source", "dual")
        n = tried.count()
        if n == 0:
            return state.select("__source", "dual")
        now = tilt(F.col("dual"), F.col("x"), most)
        step = cells.join(F.broadcast(tried) if n <= BROADCAST_ROWS else tried, "__source").groupBy("__source").agg(
            F.sum(F.col("tokens") * now).alias("h"), F.sum(F.when(F.col("dual") * F.col("x") < log_most, F.col("tokens") * F.col("x") * now).otherwise(0.0)).alias("slope")
        )
        met = state.join(step, "__source", "left")
        over = F.col("h") - F.col("target")
        narrowed = met.withColumns({
            "high": F.when(over > 0, F.least("high", "dual")).otherwise(F.col("high")), "low": F.when(over < 0, F.greatest("low", "dual")).otherwise(F.col("low")),
            "next": F.when(F.col("slope") > 0, F.col("dual") - over / F.col("slope")), "near": F.abs(over) <= NEWTON_ERROR * F.col("target"),
        })
        narrow = (F.col("high") - F.col("low")) <= 1e-14 * F.greatest(F.abs("high"), F.abs("low"))
        inside = F.coalesce((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.lit(False))
        moved = F.when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        ended = F.coalesce(F.col("near") | narrow, F.lit(True))
        fresh = stored(narrowed.select("__source", "target", "all", F.when(F.col("done") | ended, F.col("dual")).otherwise(moved).alias("dual"), "low", "high", (F.col("done") | ended).alias("done")))
        forget(state)
        state = fresh
    raise ArithmeticError(f"duals not found after {NEWTON_STEPS} steps")


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(goals, cuts) of a stored table sized(docs).

    goals: __source, source_size, target and dual. cuts, a row a cell: rate, base, and
    the hash `cut`: rows with a lower one take base + 1 copies, those with a higher
    one base; of the `equals` rows that have it, `among` take base + 1.
    """
    by_source = stored(rows.groupBy("source", "__source").agg(F.sum("size").alias("source_size")))
    goals = stored(targets(by_source))
    own = W.partitionBy("__source")
    cells = rows.where("size > 0").groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("tokens"))
    # sizes in units of the source's mean keep the exponents small
    cells = stored(cells.withColumn("x", F.col("tokens") / F.col("n") / (F.sum("tokens").over(own) / F.sum("n").over(own))))
    duals = balance(cells, goals)
    goals = stored(goals.join(duals, "__source"))
    cells = cells.join(goals.select("__source", "dual"), "__source").withColumn("rate", tilt(F.col("dual"), F.col("x")))
    wanted = F.sum(F.col("n") * F.col("rate")).over(own.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0))
    upto = F.floor(wanted + 0.5 + 1e-9)
    cells = cells.withColumn("upto", upto).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(own.orderBy("__bin")), F.lit(0)))
    cells = cells.withColumn("base", F.floor(F.col("copies") / F.col("n")))
    cells = stored(cells.select(*CELL, "n", "rate", F.col("base").cast("int").alias("base"), (F.col("copies") - F.col("n") * F.col("base")).alias("more")))
    # the more-th least hash of each cell: first the part of the hashes that holds it, from counts, then its place there
    most = cells.agg(F.max("n")).first()[0] or 0
    shift = 64 - max(0, math.ceil(math.log2(max(1, most / PART_ROWS))))
    part = F.shiftright(F.col("__hash"), shift) if shift < 64 else F.lit(0).cast("long")  # signed, like the hashes
    live = join_sized(rows.where("size > 0").select(*CELL, "__hash", part.alias("part")), cells.where("more > 0").select(*CELL, "more"), CELL)
    counts = live.groupBy(*CELL, "part").agg(F.count("*").alias("n"), F.first("more").alias("more"))
    past = W.partitionBy(*CELL).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0)))
    holds = stored(counts.where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("n"))).select(*CELL, "part", (F.col("more") - F.col("before")).alias("left")))
    same = join_sized(live.drop("more"), holds, [*CELL, "part"]).groupBy(*CELL, "__hash").agg(F.count("*").alias("equals"), F.first("left").alias("left"))
    past = W.partitionBy(*CELL).orderBy("__hash").rowsBetween(W.unboundedPreceding, -1)
    same = same.withColumn("among", F.col("left") - F.coalesce(F.sum("equals").over(past), F.lit(0))).where("among > 0 and among <= equals")
    cuts = cells.select(*CELL, "rate", "base").join(same.select(*CELL, F.col("__hash").alias("cut"), "equals", "among"), CELL, "left")
    return goals, stored(cuts)


def _decided(rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (__source, __bin, size, __hash) with rate and copies; and those that share a cut's hash while only some of them take one more.

    The second table (None if it is empty) has one row for each cut, with equals, among, base and any of its rows.
    """
    df = join_sized(rows, cuts, CELL, "left")
    more = (F.col("__hash") < F.col("cut")) | ((F.col("__hash") == F.col("cut")) & (F.col("among") == F.col("equals")))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("base") + F.coalesce(more, F.lit(False)).cast("int"))
    some = F.coalesce((F.col("__hash") == F.col("cut")) & (F.col("among") < F.col("equals")), F.lit(False)) & (F.col("size") > 0)
    out = df.withColumn("copies", copies)
    if cuts.where("among < equals").limit(1).count() == 0:
        return out, None
    tied = df.where(some).groupBy(*CELL).agg(*(F.first(c).alias(c) for c in df.columns if c not in CELL))
    return out.where(~some), tied


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, and taken: the words that the mix takes of each row; rate and copies.

    Null sources are one source of their own. Rows without words (null and empty
    texts) count 0 and get one copy. Of equal rows some may take one copy more than
    the others. Columns with names that are used here don't clash: none but doc_id,
    text and source is read. An empty table gives no rows.
    """
    rows = stored(sized(docs))
    goals, cuts = plan(rows)
    df, tied = _decided(rows, cuts)
    out = ["doc_id", "__source", "size", "rate", "copies"]
    if tied is not None:
        each = tied.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("equals").cast("int"))))
        df = df.select(*out).unionByName(each.withColumn("copies", F.col("base") + (F.col("__k") <= F.col("among")).cast("int")).select(*out))
    df = join_sized(df, goals, ["__source"])
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.coalesce("rate", F.lit(1.0)).alias("rate"), F.col("copies").cast("int").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its copies, with the columns of docs.

    Rows meet the table of cuts (a few hundred rows a source at most), which is
    broadcast where it is small; neither texts nor ranks are shuffled then.
    """
    names = docs.columns
    cuts = plan(stored(sized(docs)))[1]
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("__doc"), null_safe_key("source").alias("__source"), size_of().alias("size"), row_hash(docs).alias("__hash")).withColumn("__bin", _bin("size"))
    df, tied = _decided(rows, cuts)
    repeated = df.select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    if tied is not None:
        repeated = repeated.unionByName(tied.select("__doc", F.explode(F.array_repeat(F.lit(1), (F.col("base") * F.col("equals") + F.col("among")).cast("int")))))
    return repeated.select(*(F.col("__doc").getField(x).alias(x) for x in names))

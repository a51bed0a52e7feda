"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Both models are first-order chains over the identifier alphabet, learned from
labelled samples. Random strings are the values that the fixed patterns find in the
whole corpus. Ordinary identifiers are the corpus' other tokens, but for those with
letters and digits, which may be what is looked for; in their place stand names that
are composed of the corpus' own words in the usual forms of mixed names (FORMS). A
fifth of all samples, told by a hash, is held out. A token outside the fixed patterns
is a secret if the log-likelihood ratio of the two models passes a threshold a pair
of characters. That is THRESHOLD, however large the corpus is. Who sets LEAST_HELD has
it fitted where there are as many held-out ordinary strings: GROUPS groups of them,
told by the text that they come from, each give the least one that at most
FALSE_SHARE of theirs pass, and the median of these counts.
A string counts once however often it occurs, and one text can move the choice of one
group alone, so that the median goes to a neighbouring group's choice at most.

Only tokens are judged that hold RUN letters and digits in a row, both of them: what
dates, paths, UUIDs and names joined by underscores hold between their separators is
too short to tell chance from habit, and tokens of letters or digits alone are what
ordinary strings were learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, named, stored, text_of

# The patterns of the kinds, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Tokens from TRAINED characters on are samples; those from SCORED on with RUN letters and digits in a row are judged.
TRAINED, SCORED, RUN = 12, 20, 16
TOKEN = r"[A-Za-z0-9+/_-]"
#: The alphabet lies in the code range FIRST .. FIRST + WIDTH - 1, so that a pair has an index.
FIRST, WIDTH = 43, 80
ALPHABET = "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
#: Strength of what stands in for unseen pairs, in counts a character: any character alike after each in random strings,
#: characters as they occur in ordinary ones.
SMOOTH = {"random": 300.0, "ordinary": 200.0}
#: A secret's ratio in nats as a whole, the share of held-out ordinary strings that may pass, the thresholds that are tried
#: for a pair of characters, and that which holds unless one is fitted.
LEAST_RATIO, FALSE_SHARE = 12.0, 0.001
THRESHOLDS, THRESHOLD = [k / 50 for k in range(25, 101)], 0.5
#: A threshold is fitted from so many held-out ordinary strings on, as the median of so many groups: never, unless it is set
#: (with 81,000 nine in a group may pass), so that results don't depend on a corpus' size passing a mark.
LEAST_HELD, GROUPS = math.inf, 9
#: One composed name for so many words of a text.
WORDS_A_NAME = 400
FOLDS = 5

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


@dataclass(frozen=True)
class Model:
    """ratio: the log ratio of each pair of characters, at (first - FIRST) * WIDTH + second - FIRST; threshold: what a pair has to give on average.

    recall and false_share: the shares of held-out random and ordinary strings (those that are judged, each once) that pass;
    None without any. false_most: what the false share is at most, with a confidence of 95 % (Wilson). held: how many random
    and ordinary strings these are; fitted: whether the threshold comes from them.
    """

    ratio: list[float]
    threshold: float
    recall: float | None
    false_share: float | None
    false_most: float | None
    held: tuple[int, int]
    fitted: bool


def _share_at_most(k: int, n: int, z: float = 1.645) -> float:
    """Wilson's upper bound of a share of which k of n were seen."""
    p, q = k / n, z * z / n
    return min(1.0, (p + q / 2 + z * math.sqrt(p * (1 - p) / n + q / (4 * n))) / (1 + q))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is named: a lambda's parameter is not an expression."""
    return F.get(F.transform(F.array(value), then), 0)


def _before(values: Column, both) -> Column:
    """For each element of an array of numbers what both (a sum, a maximum) makes of 0 and those before it.

    In parts of about the square root of their number, as appending to one array copies it each time.
    """
    running = lambda xs, start: F.aggregate(
        xs, F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct(both(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )

    def in_parts(xs: Column) -> Column:
        part = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda k: F.slice(xs, k * n + 1, n))
        total = lambda parts: F.transform(parts, lambda p: F.aggregate(p, F.lit(0), both))
        return _let(_let(part, cut), lambda parts: F.flatten(F.zip_with(parts, running(total(parts), F.lit(0)), running)))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, in_parts(xs)).otherwise(F.array().cast("array<int>")))


def sums_before(lengths: Column) -> Column:
    """For each element of an array the sum of those before it."""
    return _before(lengths, lambda a, x: a + x)


def _found(text: Column, pattern: str, gate: str, kind: str, least: int, value: int = 0) -> Column:
    """Spans of the leftmost, non-overlapping matches whose value has at least `least` characters.

    One lazy pattern yields the gap before each match and the match; their
    lengths add up to positions in code points. gate: a cheaper pattern that
    every text with a wanted match contains.
    """
    lazy = F.lit(rf"(?s)(.*?)({pattern}|\z)")  # the end counts as a match, or what follows the last one would be tried from each of its characters
    groups = [F.transform(F.regexp_extract_all(text, lazy, 1), F.length).alias("gap"), F.regexp_extract_all(text, lazy, 2).alias("hit")]
    parts = F.arrays_zip(*groups, *([F.regexp_extract_all(text, lazy, value).alias("value")] if value else []))
    got = lambda x: x["value"] if value else x["hit"]
    span = lambda x, before: F.struct(
        (before + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (before + x["gap"] + F.length(x["hit"])).alias("end"), got(x).alias("value")
    )
    wide = lambda xs: F.zip_with(xs, sums_before(F.transform(xs, lambda x: x["gap"] + F.length(x["hit"]))), span)
    return F.when(text.rlike(gate), F.filter(_let(parts, wide), lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(SPAN))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __t (the text) and __base: the spans of the fixed patterns by start, then kind."""
    df = docs.withColumn("__t", text_of(text))
    t = F.col("__t")
    return df.withColumn(
        "__base",
        F.sort_array(
            F.concat(
                _found(t, ASSIGN, r"(?i:passw|secret|token|api_?key)", "assign", LEAST["assign"], 4),
                _found(t, ACCESS, r"AKIA[A-Z0-9]{16}", "access", LEAST["access"]),
                _found(t, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", "hex", LEAST["hex"]),
            )
        ),
    )


def _digits(seed: Column, low: int, n: int) -> Column:
    """n digits of a hash."""
    return F.lpad(F.pmod(F.shiftright(seed, low), F.lit(10**n)).cast("string"), n, "0")


def _forms(w: list[Column], seed: Column) -> list[Column]:
    """FORMS: names as programs, files and records have them, of some words and the digits of a hash."""
    join = lambda mark, *parts: F.concat_ws(mark, *parts)
    d = lambda low, n: _digits(seed, low, n)
    day = join("-", F.concat(F.lit("20"), d(0, 2)), F.lpad((F.pmod(seed, F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(seed, F.lit(28)) + 1).cast("string"), 2, "0"))
    h = F.md5(seed.cast("string").cast("binary"))
    return [
        join("_", w[0], w[1], d(3, 3), F.concat(F.lit("v"), d(1, 1)), w[2]),
        join("_", F.upper(w[0]), F.upper(w[1]), F.upper(w[2]), d(5, 2)),
        F.concat(F.lower(w[0]), F.initcap(w[1]), F.initcap(w[2]), F.initcap(w[3]), d(7, 1)),
        join("/", w[0], w[1], w[2], F.concat(F.initcap(w[3]), d(2, 1)), F.initcap(w[1])),
        join("-", F.concat(F.lit("x"), d(4, 2)), w[0], w[1], F.concat(w[2], d(6, 2))),
        join("T", day, join("-", d(8, 2), d(9, 2), d(11, 2), d(13, 6))),
        join("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        join("_", F.upper(w[0]), F.replace(day, F.lit("-"), F.lit("")), d(10, 6), F.concat(w[1], d(12, 1))),
        F.concat(F.initcap(w[0]), F.initcap(w[1]), F.initcap(w[2]), d(15, 4)),
    ]


def samples(docs: DataFrame) -> DataFrame:
    """(random, token, n, h): the labelled strings of all texts, each with its number of occurrences and the least hash of a text with it; random is 1 or 0."""
    df = with_base_spans(docs.select("text"))
    t = F.col("__t")
    plain = t
    for pattern in (ASSIGN[: -len("+)")] + f"{{{LEAST['assign']},}})", ACCESS.replace("+", "{16,}"), HEX.replace("+", "{24,}")):
        plain = F.regexp_replace(plain, pattern, " ")
    known = F.when(F.size("__base") > 0, plain).otherwise(t)
    ordinary = F.filter(F.regexp_extract_all(known, F.lit(rf"{TOKEN}{{{TRAINED},}}"), 0), lambda x: ~(x.rlike("[0-9]") & x.rlike("[A-Za-z]")))
    words = F.regexp_extract_all(known, F.lit("[A-Za-z]{2,12}"), 0)
    df = df.select(F.transform("__base", lambda x: x["value"]).alias("random"), ordinary.alias("ordinary"), words.alias("w"), F.xxhash64("__t").alias("h"))
    starts = F.when(F.size("w") >= 4, F.sequence(F.lit(0), F.size("w") - 4, F.lit(WORDS_A_NAME))).otherwise(F.array().cast("array<int>"))

    def composed(i: Column) -> Column:
        def form(seed: Column) -> Column:
            forms = _forms([F.get("w", i + k) for k in range(4)], seed)
            which = F.pmod(seed, F.lit(len(forms)))
            out = forms[-1]
            for k, x in enumerate(forms[:-1]):
                out = F.when(which == k, x).otherwise(out)
            return out

        return _let(F.abs(F.xxhash64(F.col("h"), i)), form)

    df = df.select("h", F.posexplode(F.array(F.concat("ordinary", F.transform(starts, composed)), F.col("random"))).alias("random", "tokens")).select("random", "h", F.explode("tokens").alias("token"))
    return df.where(F.length("token") >= 2).groupBy("random", "token").agg(F.count("*").alias("n"), F.min("h").alias("h"))


def _held_out(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FOLDS)) == 0


def _judged(token: Column) -> Column:
    return (F.length(token) >= SCORED) & token.rlike(rf"[A-Za-z0-9]{{{RUN}}}") & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def _score(value: Column, ratio: list[float]) -> Column:
    """The log-likelihood ratio of a string of the alphabet."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratio)), ",").cast("array<double>")  # folded into one constant
    at = lambda i: F.ascii(F.substring(value, i, F.lit(1))) - FIRST
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda a, i: a + F.get(table, at(i) * WIDTH + at(i + 1)))


def fit(labelled: DataFrame) -> Model:
    """The model of a stored table samples(docs).

    At most 2 * 65 * 65 counts of pairs and GROUPS * 2 * (len(THRESHOLDS) + 1) counts
    of held-out strings, whatever the input, reach the driver.
    """
    pairs = labelled.where(~_held_out("token")).select("random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counted = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.col("pair").rlike(rf"^{TOKEN}{{2}}$")).groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()}

    def logs(which: int, smooth: float, alone: dict[str, float]) -> dict[str, float]:
        out = {}
        for a in ALPHABET:
            row = [counted.get((which, a + b), 0) + smooth * alone[b] for b in ALPHABET]
            out |= {a + b: math.log(n / sum(row)) for b, n in zip(ALPHABET, row)}
        return out

    seen = {b: sum(counted.get((0, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
    chance = logs(1, SMOOTH["random"], dict.fromkeys(ALPHABET, 1 / len(ALPHABET)))
    usual = logs(0, SMOOTH["ordinary"], {b: n / sum(seen.values()) for b, n in seen.items()})
    ratio = [0.0] * WIDTH**2
    for pair in chance:
        ratio[(ord(pair[0]) - FIRST) * WIDTH + ord(pair[1]) - FIRST] = chance[pair] - usual[pair]
    held = labelled.where(_held_out("token") & _judged(F.col("token")) & F.col("token").rlike(rf"^{TOKEN}+$")).select("random", F.pmod("h", F.lit(GROUPS)).alias("g"), _score(F.col("token"), ratio).alias("s"), (F.length("token") - 1).alias("pairs"))
    passed = held.select("random", "g", F.when(F.col("s") >= LEAST_RATIO, F.size(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: F.col("s") >= t * F.col("pairs")))).otherwise(0).alias("k"))
    upto = {(r["random"], r["g"], r["k"]): r["n"] for r in passed.groupBy("random", "g", "k").agg(F.count("*").alias("n")).collect()}
    total = lambda which, least, group=None: sum(n for (w, g, k), n in upto.items() if w == which and k >= least and group in (None, g))
    size = (total(1, 0), total(0, 0))
    fitted = size[1] >= LEAST_HELD
    at = THRESHOLDS.index(THRESHOLD)
    if fitted:
        fits = [next((k for k in range(len(THRESHOLDS)) if total(0, k + 1, g) <= FALSE_SHARE * total(0, 0, g)), len(THRESHOLDS) - 1) for g in range(GROUPS)]
        at = sorted(fits)[GROUPS // 2]
    passing = (total(1, at + 1), total(0, at + 1))
    shares = [k / n if n else None for k, n in zip(passing, size)]
    return Model(ratio, THRESHOLDS[at], *shares, _share_at_most(passing[1], size[1]) if size[1] else None, size, fitted)


def train(docs: DataFrame) -> Model:
    labelled = stored(samples(docs))
    out = fit(labelled)
    forget(labelled)
    return out


def with_secret_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with __t, __base, and spans: those of the fixed patterns and of the models, in order."""
    df = with_base_spans(docs, text)
    t = F.col("__t")
    df = df.withColumn("__near", F.filter(_found(t, rf"{TOKEN}{{{SCORED},}}", rf"[A-Za-z0-9]{{{RUN}}}", "markov", SCORED), lambda x: _judged(x["value"])))
    base = F.col("__base")
    fresh = F.filter("__near", lambda x: ~F.exists(base, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    df = df.withColumn("__fresh", F.when(F.size("__near") > 0, fresh).otherwise(F.array().cast(SPAN)))
    scored = F.transform("__fresh", lambda x: F.struct(x.alias("x"), _score(x["value"], model.ratio).alias("s")))
    secret = F.filter(scored, lambda y: (y["s"] >= LEAST_RATIO) & (y["s"] >= model.threshold * (F.length(y["x"]["value"]) - 1)))
    found = F.when(F.size("__fresh") > 0, F.transform(secret, lambda y: y["x"])).otherwise(F.array().cast(SPAN))
    return df.withColumn("spans", F.sort_array(F.concat(base, found))).drop("__near", "__fresh")


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, the counts of the fixed kinds, the base spans' digest and all spans.

    Null texts count as empty and have no spans; repeated rows get equal results.
    """
    df = with_secret_spans(docs.select("doc_id", "text"), train(docs))
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("__base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("__base")).cast("long").alias("n_markov"),
    )


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every value that was found replaced by mask, and n_chars (where there is one) brought up to date.

    Rows without a secret stay as they are, null texts included; equal rows stay equal, no rows give none, and other
    columns may have any name.
    """
    names = docs.columns
    df = with_secret_spans(docs.select(F.struct(*named(names)).alias("__row"), "text"), train(docs))
    # what stands between the values stays; a value inside one already masked adds nothing. One join of all pieces: a text is
    # not copied for each span
    low = lambda x: x["end"] - F.length(x["value"])
    df = df.withColumn("__reach", F.when(F.size("spans") > 0, _before(F.transform("spans", lambda x: x["end"]), lambda a, x: F.greatest(a, x))))
    piece = lambda x, at: F.when(low(x) >= at, F.concat(F.substring(F.col("__t"), at + 1, low(x) - at), F.lit(mask))).otherwise("")
    rest = F.substring(F.col("__t"), F.array_max(F.transform("spans", lambda x: x["end"])) + 1, F.length("__t"))
    folded = F.concat(F.array_join(F.zip_with("spans", "__reach", piece), ""), rest)
    masked = F.when(F.size("spans") > 0, folded).otherwise(F.col("__row.text"))
    df = df.withColumn("__masked", masked)
    row = lambda x: F.col("__row").getField(x)
    put = {"text": F.col("__masked"), "n_chars": F.when(F.size("spans") > 0, F.length("__masked").cast("long")).otherwise(row("n_chars")) if "n_chars" in names else None}
    return df.select(*((put[x] if x in put else row(x)).alias(x) for x in names))

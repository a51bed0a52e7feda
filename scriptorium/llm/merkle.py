"""Merkle manifest of a table by nested-struct rollup.

Rows become leaves, which are numbered by rank inside their language. A rank is
written in digits; blocks of a bounded number of leaves are rolled up by
grouping one digit column away after the other, so that each group's struct
nests those of its children together with the hashes of the levels between. The
blocks' own hashes are rolled up in the same way, until one is left. Proofs then
come down: a block and the proof of its hash meet in one group, and a transform
over the nested struct followed by an explode gives each leaf its siblings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_sized, null_safe_key, stored

#: Levels of the binary tree that one digit covers, and digits of a block: blocks have at most 1,024 leaves.
BITS, DIGITS = 5, 2

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of a row's values: each is "-" if it is null, else its UTF-8 byte count, ":" and itself."""
    shown = [c.cast("string") for c in columns.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown])


def ordered_ranks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with rank (0, 1, 2, … inside its group, in the given order) and n, the number of the group's rows.

    Rows are dealt by ranges of (group, order), so a large group spreads over many tasks; a row's number in its
    task is then moved by what earlier tasks hold of its group, a table of one row for each group of a task.
    df is a stored table; rows that are equal in group and order may change places.
    """
    tie = df.withColumn("__tie", F.monotonically_increasing_id())  # lets equal rows be dealt over several tasks
    keys = [group, *order, "__tie"]
    placed = stored(tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    task, row = F.shiftright("__at", 33).alias("__task"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    runs = placed.groupBy(group, task).agg(F.min(row).alias("__first"), F.count("*").alias("__rows"))
    upto = W.partitionBy(group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    moved = runs.select(
        group, "__task", (F.coalesce(F.sum("__rows").over(upto), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(W.partitionBy(group)).alias("n"),
    )
    found = join_sized(placed.withColumn("__task", task), stored(moved), [group, "__task"])
    return found.withColumn("rank", row + F.col("__shift")).drop("__at", "__task", "__shift")


def _merges(n: Column, level: Column) -> Column:
    """Whether a tree of n nodes still has several of them at a level."""
    return n > F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _levels(kids: Column, n: Column, low: int, bits: int) -> Column:
    """Hashes of the kids and of each level above them, the last of which is a single hash."""

    def up(levels: Column, j: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int"))
        merged = F.transform(pairs, lambda i: digest(F.get(last, i * 2), F.coalesce(F.get(last, i * 2 + 1), F.lit(""))))
        return F.concat(levels, F.array(F.when(_merges(n, j + low), merged).otherwise(last)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.array(F.transform(kids, lambda k: k["node"]["hash"])), up)


def rolled_up(nodes: DataFrame, bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """(g, block, n, node) of nodes (g, rank, n, hash, payload): one nested struct for each block of 2^(bits * digits) ranks.

    After rows are dealt by (g, block), all groupings take place where they are.
    """
    names = [f"d{k}" for k in range(digits)]
    cut = [F.shiftright("rank", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(names[k]) for k in range(digits)]
    df = nodes.select("g", F.shiftright("rank", bits * digits).alias("block"), "n", *cut, F.struct("hash", "payload").alias("node")).repartition("g", "block")
    for k in range(digits):
        keys = ["g", "block", "n", *names[k + 1 :]]
        df = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(names[k]).alias("digit"), "node"))).alias("kids"))
        df = df.withColumn("levels", _levels(F.col("kids"), F.col("n"), bits * k, bits))
        df = df.select(*keys, F.struct(F.get(F.element_at("levels", -1), 0).alias("hash"), "levels", "kids").alias("node"))
    return df


def _steps(levels: Column, digit: Column, n: Column, low: int, bits: int) -> Column:
    """Siblings of a kid on its way to its parent's hash; a step without a sibling has two nulls."""

    def step(j: Column) -> Column:
        at = F.call_function("shiftright", digit, j)
        other, right = F.get(F.get(levels, j), at.bitwiseXOR(F.lit(1))), at.bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(right, other).alias("left"), F.when(~right, other).alias("right"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda j: _merges(n, j + low)), step)


def _emitted(node: Column, n: Column, above: Column, k: int, bits: int) -> Column:
    """(payload, proof) of all that a node nests."""

    def of(kid: Column) -> Column:
        proof = F.concat(_steps(node["levels"], kid["digit"], n, bits * k, bits), above)
        return _emitted(kid["node"], n, proof, k - 1, bits) if k else F.struct(kid["node"]["payload"].alias("payload"), proof.alias("proof"))

    found = F.transform(node["kids"], of)
    return F.flatten(found) if k else found


def _met(blocks: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys as one row: each side has one row a key, and columns of its own."""
    missing = lambda df, other: [F.lit(None).cast(t).alias(c) for c, t in other.dtypes if c not in keys and c not in df.columns]
    both = blocks.select("*", *missing(blocks, proofs)).unionByName(proofs.select("*", *missing(proofs, blocks)))
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in keys])


def proved(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """(g, payload, proof) of each node, and further columns of what `above` makes of the trees' tops.

    nodes: (g, rank, n, hash, payload), stored. above takes (g, hash), one row a tree, and returns (g, proof, …).
    """
    size, most = bits * digits, nodes.agg(F.max("n")).first()[0] or 0
    blocks = stored(rolled_up(nodes, bits, digits))
    if most > 1 << size:
        ranked = blocks.select("g", F.col("block").alias("rank"), F.ceil(F.col("n") / (1 << size)).alias("n"), "node.hash", F.col("block").alias("payload"))
        proofs = proved(ranked, above, bits, digits).withColumnRenamed("payload", "block")
    else:
        proofs = stored(above(blocks.select("g", "node.hash")).withColumn("block", F.lit(0).cast("long")))
    met, rest = _met(blocks, proofs, ["g", "block"]), [c for c in proofs.columns if c not in ("g", "block", "proof")]
    each = F.explode(_emitted(F.col("node"), F.col("n"), F.col("proof"), digits - 1, bits)).alias("__e")
    return met.select("g", *rest, each).select("g", *rest, "__e.payload", "__e.proof")


def manifest(leaves: DataFrame, group: str, order: list[str], bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """payload, proof, subroot and root of stored leaves (group, order, leaf, payload).

    Each group's leaves, in the given order, form a binary tree, whose nodes are the hashes of two consecutive ones
    (the last perhaps of one); its top is subroot. The subroots in order of their group, null first and then by
    bytes, form the tree of root. proof has a leaf's steps from below, each with the sibling to its left or right, if any.
    """

    def languages(tops: DataFrame) -> DataFrame:
        tops = stored(tops)
        ranked = stored(ordered_ranks(tops.withColumn("__all", F.lit(0)), "__all", ["g"]))
        nodes = ranked.select(F.col("__all").alias("g"), "rank", "n", "hash", F.struct("g", F.col("hash").alias("subroot")).alias("payload"))
        whole = proved(nodes, lambda top: top.select("g", F.col("hash").alias("root"), F.array().cast(PROOF).alias("proof")), bits, digits)
        return whole.select("payload.g", "payload.subroot", "root", "proof")

    keyed = stored(leaves.withColumn("g", null_safe_key(group)))  # "-" for null comes before "=" and a value
    nodes = ordered_ranks(keyed, "g", order).select("g", "rank", "n", F.col("leaf").alias("hash"), "payload")
    return proved(nodes, languages, bits, digits).drop("g")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.coalesce(s["left"], F.lit("")), h, F.coalesce(s["right"], F.lit(""))))


def verified(rows: DataFrame) -> Column:
    """Whether leaf, proof and root of a row agree."""
    return folded(F.col("leaf"), F.col("proof")) == F.col("root")


def manifest_report(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, and the outcome of a tampering of each document; see the contract of op11.

    Nulls are values of their own, in the language too; a null doc_id comes first in its language and is never tampered
    with. Rows with equal doc_id (in any number) are leaves of their own, in the order of their hashes; rows equal in all
    five columns may change places. A lone leaf is its language's subroot, a lone language's subroot the root, with
    nothing hashed. Other columns are not read. No rows give no rows.
    """
    cols = {c: F.col(c) for c in FIELDS}
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")  # the largest long can be added to
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select("doc_id", "lang", leaf_hash(cols).alias("leaf"), F.when(hit, leaf_hash(cols | {"n_chars": more})).alias("tampered"))
    leaves = rows.select("lang", F.col("doc_id").alias("__order"), "leaf", F.struct("doc_id", "leaf", "tampered").alias("payload"))
    found = manifest(leaves, "lang", ["__order", "leaf"]).select("payload.*", "subroot", "root", "proof")
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
    out = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

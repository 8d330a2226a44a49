"""A Merkle manifest of a dataset: one tree a partition of the rows, and one over the trees' roots.

Trees are built over concatenated levels. ``fanout ** LEVELS`` consecutive nodes are an aligned block; a block keeps
each of its levels as one string of hexadecimal digests. A parent is the hash of a fixed-width substring of the level
below, a node's siblings are the two substrings that flank it inside its run, and the tops of all blocks are
the nodes of the next round, until a tree is one block. What a leaf needs above its block is found
once a block and joined down, so a leaf's own work is what lies inside its block.

Only DataFrame functions. Rows are numbered by a range sort over (tree, order, digest, row), so neither one tree that holds
nearly all rows nor one order value that many rows share comes into one task; a block is never longer than
its fixed number of nodes, and no list of digests passes through the driver, which sees counts only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.session import cut_lineage

WIDTH = 64  # hexadecimal digits of a digest
BLOCK = 256  # nodes of a block at most; the largest power of the fan-out up to it is taken
ROWS_A_RANGE = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbouring fields cannot run into each other; null is ``-``."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to: at each level the siblings left of it, itself, those right of it."""
    return F.aggregate(proof, start, lambda low, run: F.sha2(F.concat(run["left"], low, run["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


def _parents(level: Column, fanout: int) -> Column:
    run = WIDTH * fanout
    last = ((F.octet_length(level) - 1) / run).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256))
    return F.array_join(hashed, "").cast("binary")


def _levels(nodes: Column, depth: Column, fanout: int) -> Column:
    """All levels of a block, the lowest first, ``depth`` above it, each one binary string."""
    first = F.array(F.array_join(nodes, "").cast("binary"))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, first, lambda below, _: F.concat(below, F.array(_parents(F.element_at(below, -1), fanout))))


def _siblings(levels: Column, depth: Column, at: Column, fanout: int) -> Column:
    """The flanking substrings of a node's run on each level below the block's top."""

    def flanks(level: Column, height: Column) -> Column:
        me = (at / F.pow(F.lit(fanout), height)).cast("int")
        start = me - F.pmod(me, F.lit(fanout))
        after = F.least(start + fanout, (F.octet_length(level) / WIDTH).cast("int"))
        left = F.substring(level, start * WIDTH + 1, (me - start) * WIDTH)
        right = F.substring(level, (me + 1) * WIDTH + 1, (after - me - 1) * WIDTH)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), depth), flanks)


def _block_levels(fanout: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of each row in its tree, and ``nodes``, the tree's size; rows have ``tree`` and ``row``.

    A range sort deals the rows into pieces, a piece's rows are counted per tree, and the pieces'
    counts before give the offsets: no window holds more than the list of pieces of one tree.
    """
    by = ["tree", *order, "row"]
    parts = max(1, -(-rows.count() // ROWS_A_RANGE))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = cut_lineage(dealt.withColumn("row", F.monotonically_increasing_id()))
    piece = F.shiftright("row", 33)
    counted = dealt.groupBy("tree", piece.alias("piece")).agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("tree", "piece", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("nodes"))
    placed = dealt.withColumn("piece", piece).join(counted, ["tree", "piece"])
    return placed.withColumn("at", F.col("row") + F.col("shift")).drop("piece", "shift", "row")


def _blocks(nodes: DataFrame, fanout: int, payload: list[str]) -> DataFrame:
    """One row a block: its nodes in order with their payload, how many levels it has, and its top."""
    levels = _block_levels(fanout)
    size = F.lit(fanout**levels)
    item = F.struct("at", "digest", *payload)
    rows = nodes.withColumn("block", F.floor(F.col("at") / size)).groupBy("tree", "block")
    rows = rows.agg(F.first("nodes").alias("nodes"), F.sort_array(F.collect_list(item)).alias("items"))
    depth = sum((F.when(F.col("nodes") > fanout**i, 1).otherwise(0) for i in range(levels)), F.lit(0))
    rows = rows.withColumn("depth", depth)
    tops = _levels(F.col("items.digest"), F.col("depth"), fanout)
    return cut_lineage(rows.withColumn("top", F.element_at(tops, -1).cast("string")))


def _inside(fanout: int, *payload: str) -> Column:
    """An array with each node of a block and its proof up to the block's top and on from there.

    The levels are bound to a lambda variable: they are computed once a block and not read out of a row for each node.
    """
    items, depth, above = F.col("items"), F.col("depth"), F.col("above")

    def nodes(levels: Column) -> Column:
        def node(item: Column, i: Column) -> Column:
            proof = F.concat(_siblings(levels, depth, i, fanout), above)
            return F.struct(item["at"].alias("at"), item["digest"].alias("digest"), *[item[p].alias(p) for p in payload], proof.alias("proof"))

        return F.transform(items, node)

    return F.transform(F.array(_levels(F.col("items.digest"), depth, fanout)), nodes)[0]


_NO_PROOF = "array<struct<left:string,right:string>>"


def _above(blocks: DataFrame, biggest: int, fanout: int) -> DataFrame:
    """(tree, block, root, above): the root of each block's tree and what the block's top needs to reach it."""
    size = fanout ** _block_levels(fanout)
    tops = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("nodes") / size).alias("nodes"), F.col("top").alias("digest"))
    if biggest <= size:
        return tops.select("tree", F.col("at").alias("block"), F.col("digest").alias("root"), F.array().cast(_NO_PROOF).alias("above"))
    higher = _blocks(tops, fanout, [])
    found = higher.join(_above(higher, -(-biggest // size), fanout), ["tree", "block"])
    return cut_lineage(found.select("tree", "root", F.explode(_inside(fanout)).alias("n")).select("tree", F.col("n.at").alias("block"), "root", F.col("n.proof").alias("above")))


def _trees(nodes: DataFrame, fanout: int, payload: list[str]) -> DataFrame:
    """Blocks of all trees with the root of their tree and the way to it."""
    blocks = _blocks(nodes, fanout, payload)
    biggest = blocks.agg(F.max("nodes")).first()[0] or 0
    return blocks.join(_above(blocks, biggest, fanout), ["tree", "block"])


def manifest(
    docs: DataFrame,
    *,
    fields: tuple[str, ...] = FIELDS,
    tree: str = "lang",
    order: str = "doc_id",
    claimed: dict[str, Column] | None = None,
    fanout: int = 2,
) -> DataFrame:
    """One row per input row: the order column, leaf, subroot, root, proof, folded_root, verified.

    ``leaf`` is the digest of the row's fields, ``subroot`` that of its tree (one per value of ``tree``, null is a value and the
    first), ``root`` that of all subroots. ``proof`` is an array of (left, right), the siblings on each level from the
    leaf over the subroot to the root; ``fold(leaf, proof)`` is the root. ``claimed`` replaces fields by what
    somebody says they are: ``folded_root`` starts from the leaf so claimed, ``verified`` says if it is the root.

    Rows of a tree stand in ascending order, null first; rows of one order value by their digests, so the root does not
    depend on how the rows came in, and repeated rows are leaves of their own. A run of fewer nodes than
    ``fanout``, even a single one, is hashed like any other; a tree of one leaf is that leaf. Null fields are ``-``, which
    no value is, as values have their length in front. An empty table has no rows and no root. Other columns play no part.
    """
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    leaf = digest(*[field(F.col(f)) for f in fields])
    said = digest(*[field((claimed or {}).get(f, F.col(f))) for f in fields]) if claimed else F.lit(None).cast("string")
    # a tree's name that is never null and sorts as the values do: null, then by bytes
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = docs.select(name.alias("tree"), F.col(order).alias("key"), leaf.alias("digest"), said.alias("said"))
    rows = rows.withColumn("said", F.when(F.col("said") != F.col("digest"), F.col("said")))
    leaves = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))

    trees = _trees(_numbered(leaves, ["key", "digest"]), fanout, ["key", "said"])
    trees = trees.withColumnsRenamed({"root": "subroot", "above": "inner"})
    subroots = trees.where(F.col("block") == 0).select("tree", F.col("subroot").alias("digest"))
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(0).cast("long").alias("row"))
    forest = _trees(_numbered(cut_lineage(forest), ["name"]), fanout, ["name"])
    forest = forest.select("root", F.explode(_inside(fanout, "name")).alias("n")).select(F.col("n.name").alias("tree"), "root", F.col("n.proof").alias("outer"))

    found = trees.join(cut_lineage(forest), "tree").withColumn("above", F.concat("inner", "outer"))
    found = found.select("subroot", "root", F.explode(_inside(fanout, "key", "said")).alias("n"))
    found = found.select(F.col("n.key").alias(order), F.col("n.digest").alias("leaf"), "subroot", "root", F.col("n.proof").alias("proof"), F.coalesce("n.said", "n.digest").alias("_start"))
    found = found.withColumn("folded_root", fold(F.col("_start"), F.col("proof"))).drop("_start")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

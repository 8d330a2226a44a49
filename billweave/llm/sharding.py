"""Shards by a hierarchical weighted hash tree.

A key descends region, rack and shard: at each node every child draws ``-ln(u) / weight``
with u a hash of key and child in (0, 1), and the smallest draw wins, so a child gets keys
in proportion to its weight. Draws of a child depend on the key, its own name and weight
only: a change of weights in one subtree moves keys between that subtree and the rest and
leaves all other placements alone. A shard that is added as a region of its own takes keys
into itself and moves none between old shards.

All column expressions. Equal rows are counted first, and stand as one row with a number of
copies until the end. Slots are numbered inside hash blocks of key, checksum and size, whose number
follows that of the rows, and the blocks' offsets are added afterwards: no task holds a whole
shard, or all rows of one key. Copies are given their slots in runs of ``RUN``, dealt anew.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.session import cut_lineage

SLOT_BLOCKS = 1024
ROWS_A_BLOCK = 1 << 16
RUN = 4096


@dataclass(frozen=True)
class Node:
    """An inner node has children; a leaf has a shard number and a weight of its own."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """Shards 0 .. n-1 dealt over regions and racks; every shard has weight 1."""
    groups: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        region = s * regions // shards
        rack = (s - region * shards // regions) * racks * regions // shards
        groups.setdefault(region, {}).setdefault(rack, []).append(Node(f"r{region}/k{rack}/s{s}", shard=s))
    return Node("root", tuple(Node(f"r{r}", tuple(Node(f"r{r}/k{k}", tuple(leaves)) for k, leaves in ks.items())) for r, ks in groups.items()))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, as a region and rack of its own: no other subtree's weight changes."""
    name = f"r-{shard}"
    leaf = Node(f"{name}/k0/s{shard}", shard=shard, own_weight=weight)
    return Node(tree.name, (*tree.children, Node(name, (Node(f"{name}/k0", (leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(child.name), key), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(child.weight)


def place(key: Column, tree: Node) -> Column:
    """The shard of a key. Null is a key like any other; children without weight get nothing."""
    if not tree.children:
        return F.lit(tree.shard)
    children = [c for c in tree.children if c.weight > 0]
    if len(children) == 1:
        return place(key, children[0])
    draws = F.array(*[_draw(key, c) for c in children])
    winner = F.array_position(draws, F.array_min(draws)).cast("int")
    choice = F
    for k, child in enumerate(children, 1):
        choice = choice.when(winner == k, place(key, child))
    return choice


def assign_shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, tree: Node | None = None, slot_blocks: int = SLOT_BLOCKS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text (null: none) plus 1; the checksum of a null text is that of
    nothing, 0. Null keys share one placement. Slots run from 0 without gaps in each shard, by
    hash block, key, checksum and size; which of two equal rows comes first does not matter.
    Rows with one key share a shard, as the law says. Other columns play no part.
    ``slot_blocks``: hash blocks at least; more where a block would have over ``ROWS_A_BLOCK`` rows.
    """
    tree = tree or even_tree(shards)
    new = 1 + max(_shards(tree))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    same = cut_lineage(rows.groupBy("doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("_n")))
    blocks = max(slot_blocks, -(-same.count() // ROWS_A_BLOCK))
    block = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int")
    placed = same.select("*", place(F.col("doc_id"), tree).alias("shard"), block.alias("_block"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
    offsets = offsets.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_rank", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = numbered.join(offsets, ["shard", "_block"]).withColumn("_first", F.col("_offset") + F.col("_rank"))
    # single rows stay where they are; only long groups of copies are cut into runs and dealt over the tasks
    few = first.where(F.col("_n") <= RUN).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    cut = first.where(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    cut = cut.withColumns({"_last": F.least(F.col("_first") + (F.col("_run") + 1) * RUN, F.col("_first") + F.col("_n")) - 1, "_start": F.col("_first") + F.col("_run") * RUN})
    columns = ["doc_id", "size", "text_crc32", "shard", "_last"]
    runs = few.select(*columns, F.col("_first").alias("_start")).union(cut.select(*columns, "_start").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return runs.withColumn("slot", F.explode(F.sequence("_start", "_last"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        place(F.col("doc_id"), grown(tree, new)).alias("grown_shard"),
    )


def _shards(node: Node) -> list[int]:
    return [s for c in node.children for s in _shards(c)] if node.children else [node.shard]

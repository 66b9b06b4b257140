"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Only DataFrame expressions run here.  At each level a row draws u in (0, 1) for every child from
md5(row key : child name) and takes the child with the largest ln(u) / weight, so a change of one
child's weight moves rows only into or out of that child's subtree.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.llm.common import stored

DRAW_HEX = 13  # 52 bits of md5
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf has a shard number and a weight, an inner node weighs what its children weigh."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple["Node", ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced_tree(shards: int, per_rack: int = 2, racks: int = 2, first: int = 0) -> tuple[Node, ...]:
    """Regions of `racks` racks of `per_rack` equal shards, numbered from `first`."""
    leaves = [Node(f"shard{s}", s) for s in range(first, first + shards)]
    rows = [tuple(leaves[i : i + per_rack]) for i in range(0, shards, per_rack)]
    rack = [Node(f"rack{r[0].shard}", children=r) for r in rows]
    return tuple(Node(f"region{g[0].children[0].shard}", children=g) for g in (tuple(rack[i : i + racks]) for i in range(0, len(rack), racks)))


def grown(tree: tuple[Node, ...], shard: int, weight: float = 1.0) -> tuple[Node, ...]:
    """One more shard in a region of its own: every draw among the old children is as before, so
    rows move into the new shard and nowhere else."""
    leaf = Node(f"shard{shard}", shard, weight)
    return (*tree, Node(f"region{shard}", children=(Node(f"rack{shard}", children=(leaf,)),)))


def _draw(key: Column, node: Node) -> Column:
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node.name}")).cast("binary")), 1, DRAW_HEX), 16, 10).cast("double")
    return F.log((number + 0.5) / float(16**DRAW_HEX)) / F.lit(float(node.weight))


def _choose(key: Column, children: tuple[Node, ...]) -> Column:
    def below(n: Node) -> Column:
        return F.lit(n.shard) if n.shard is not None else _choose(key, n.children)

    if len(children) == 1:
        return below(children[0])
    best = F.greatest(*[_draw(key, c) for c in children])
    return reduce(lambda rest, c: F.when(_draw(key, c) == best, below(c)).otherwise(rest), list(reversed(children))[1:], below(children[-1]))


def place(key: Column, tree: tuple[Node, ...]) -> Column:
    """The shard of a row key (cast to string; null is the key 'null')."""
    return _choose(F.coalesce(key.cast("string"), F.lit("null")), tree).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: tuple[Node, ...] | None = None) -> DataFrame:
    """One row per document with its shard, its slot there, and its shard once there is one more.

    Null texts have size 1 and crc of nothing; a null id is the key 'null'; ids are of any type; repeated
    rows all get slots of their own; an empty table gives no rows; other columns are not looked at.
    Slots are numbered within (shard, bucket of id and text) and shifted by the sizes of the buckets
    before, so no shard is one task, nor are many rows of one id or without one.
    """
    tree = tree or balanced_tree(shards)
    key = F.col(id_col)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree).alias("shard"),
        place(key, grown(tree, shards)).alias("grown_shard"),
        F.pmod(F.xxhash64(key, body), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"),
    )
    thin = stored(thin, "shards")
    counts = thin.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most (shards) * SLOT_BUCKETS rows whatever the input: a proven bound.
    shifts = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    placed = thin.withColumn("nth", F.row_number().over(within)).join(shifts, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("shift") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
